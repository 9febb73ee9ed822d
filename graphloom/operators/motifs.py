"""Connected induced subgraphs: enumeration, exact labelled classes, matching, fingerprints."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graphs import adjacency, degrees

UNIT, GROUP = "\x1f", "\x1e"  # between labels, and between nodes and edges of a code
MAX_SIZE = 5  # permutations are literals of the plan


def enumerate_sets(nodes: DataFrame, edges: DataFrame, size: int, within: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """(graph_id, nodes): every connected node set of ``size`` once, sorted.

    ``within`` (graph_id, node_id) restricts the graph to an induced subgraph; ``start`` keeps the sets that
    hold a start node. Sets of three come from wedges, closed ones from their least node alone, so nothing
    is made twice; larger sets grow by one neighbour and are made distinct at each size.
    """
    if within is not None:
        nodes = nodes.join(within, ["graph_id", "node_id"], "left_semi")
        for end in ("u", "v"):
            edges = edges.join(within.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    if size == 1:
        sets = nodes.select("graph_id", F.array("node_id").alias("nodes"))
    elif size == 2:
        sets = edges.select("graph_id", F.array("u", "v").alias("nodes"))
    else:
        adj = adjacency(edges).select("graph_id", "u", "v")
        side = lambda x: adj.select("graph_id", F.col("u").alias("c"), F.col("v").alias(x))
        wedges = side("a").join(side("b"), ["graph_id", "c"]).filter("a < b")
        closing = edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("closed"))
        sets = wedges.join(closing, ["graph_id", "a", "b"], "left").filter("closed is null or c < a").select("graph_id", F.array_sort(F.array("a", "b", "c")).alias("nodes"))
        for _ in range(size - 3):
            grown = sets.withColumn("u", F.explode("nodes")).join(adj, ["graph_id", "u"]).filter(~F.array_contains("nodes", F.col("v")))
            sets = grown.select("graph_id", F.array_sort(F.array_append("nodes", F.col("v"))).alias("nodes")).distinct()
    if start is not None:
        hit = sets.withColumn("node_id", F.explode("nodes")).join(start, ["graph_id", "node_id"], "left_semi").select("graph_id", "nodes").distinct()
        return hit
    return sets


def described(sets: DataFrame, nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """Adds labels (in node order), inner (edges among the nodes: i, j, label) and ext (edge ends that leave the set)."""
    known = nodes.select("graph_id", "node_id", "label").join(degrees(nodes, edges), ["graph_id", "node_id"])
    each = sets.select("graph_id", "nodes", F.posexplode("nodes").alias("i", "node_id")).join(known, ["graph_id", "node_id"])
    each = each.groupBy("graph_id", "nodes").agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("l"), F.sum("degree").alias("ends"))
    each = each.select("graph_id", "nodes", F.col("l.label").alias("labels"), "ends")
    if size == 1:
        return each.select("graph_id", "nodes", "labels", F.array().cast("array<struct<i:int,j:int,label:string>>").alias("inner"), F.col("ends").alias("ext"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("nodes", F.lit(i)).alias("u"), F.get("nodes", F.lit(j)).alias("v")) for i, j in combinations(range(size), 2)])
    inner = sets.select("graph_id", "nodes", F.inline(pairs)).join(edges.select("graph_id", "u", "v", "label"), ["graph_id", "u", "v"])
    inner = inner.groupBy("graph_id", "nodes").agg(F.array_sort(F.collect_list(F.struct("i", "j", "label"))).alias("inner"))
    return each.join(inner, ["graph_id", "nodes"]).select("graph_id", "nodes", "labels", "inner", (F.col("ends") - 2 * F.size("inner")).alias("ext"))


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``described`` for the sets of three, from the wedges themselves: every node brings its label and degree along, so nothing is regrouped.

    A centre of degree d has d (d - 1) / 2 wedges, all on its key: a hub's are as many as its sets.
    """
    known = nodes.select("graph_id", "node_id", "label").join(degrees(nodes, edges), ["graph_id", "node_id"])
    far = adjacency(edges).join(known.select("graph_id", F.col("node_id").alias("v"), F.col("label").alias("vl"), F.col("degree").alias("vd")), ["graph_id", "v"])
    side = lambda x: far.select("graph_id", F.col("u").alias("c"), *[F.col(f).alias(x + t) for f, t in (("v", ""), ("vl", "_label"), ("vd", "_degree"), ("label", "_edge"))])
    centre = known.select("graph_id", F.col("node_id").alias("c"), F.col("label").alias("c_label"), F.col("degree").alias("c_degree"))
    wedges = side("a").join(side("b"), ["graph_id", "c"]).filter("a < b").join(centre, ["graph_id", "c"])
    closing = edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b"), F.col("label").alias("ab_edge"), F.lit(True).alias("closed"))
    sets = wedges.join(closing, ["graph_id", "a", "b"], "left").filter("closed is null or c < a")
    members = F.array_sort(F.array(*[F.struct(F.col(x).alias("node"), F.col(f"{x}_label").alias("label")) for x in "abc"]))
    place = lambda x: (F.array_position("nodes", F.col(x)) - 1).cast("int")
    edge = lambda x, y, label: F.struct(F.least(place(x), place(y)).alias("i"), F.greatest(place(x), place(y)).alias("j"), F.col(label).alias("label"))
    two = F.array(edge("a", "c", "a_edge"), edge("b", "c", "b_edge"))
    inner = F.array_sort(F.when(F.col("closed").isNull(), two).otherwise(F.array_append(two, edge("a", "b", "ab_edge"))))
    rows = sets.withColumn("m", members).withColumn("nodes", F.col("m.node")).withColumn("inner", inner)
    return rows.select("graph_id", "nodes", F.col("m.label").alias("labels"), "inner", (F.col("a_degree") + F.col("b_degree") + F.col("c_degree") - 2 * F.size("inner")).alias("ext"))


def coded(rows: DataFrame, size: int) -> DataFrame:
    """Adds code, equal exactly for isomorphic labelled subgraphs, and mapping: the nodes in the code's order, the least tuple of several."""
    if size > MAX_SIZE:
        raise ValueError(f"sizes up to {MAX_SIZE}")
    cell = lambda i, j: F.coalesce(F.get(F.filter("inner", lambda e: (e["i"] == min(i, j)) & (e["j"] == max(i, j))), F.lit(0))["label"], F.lit(""))
    matrix = rows.withColumn("cells", F.array(*[cell(i, j) for i, j in combinations(range(size), 2)])) if size > 1 else rows.withColumn("cells", F.array().cast("array<string>"))
    place = {p: k for k, p in enumerate(combinations(range(size), 2))}

    def variant(p: tuple[int, ...]) -> Column:
        labels = F.concat_ws(UNIT, *[F.get("labels", F.lit(i)) for i in p])
        cells = F.concat_ws(UNIT, *[F.get("cells", F.lit(place[min(p[a], p[b]), max(p[a], p[b])])) for a, b in combinations(range(size), 2)])
        return F.struct(F.concat(labels, F.lit(GROUP), cells).alias("code"), F.array(*[F.get("nodes", F.lit(i)) for i in p]).alias("mapping"))

    best = F.array_min(F.array(*[variant(p) for p in permutations(range(size))]))
    return matrix.withColumn("best", best).select("graph_id", F.lit(size).alias("size"), "nodes", "best.code", "best.mapping", F.size("inner").alias("n_edges"), F.col("ext").cast("long").alias("ext"))


def occurrences(nodes: DataFrame, edges: DataFrame, sizes: tuple[int, ...] = (3,), **limits: DataFrame) -> DataFrame:
    """(graph_id, size, nodes, code, mapping, n_edges, ext) of every connected induced subgraph of the sizes."""
    one = lambda k: triples(nodes, edges) if k == 3 and not limits else described(enumerate_sets(nodes, edges, k, **limits), nodes, edges, k)
    found = [coded(one(k), k) for k in sorted(set(sizes))]
    return reduce(DataFrame.unionByName, found)


@dataclass
class Rule:
    """A motif of the dictionary. Edges and automorphisms are in the order of the code."""

    rank: int
    code: str
    labels: list[str] = field(default_factory=list)
    edges: list[tuple[int, int, str]] = field(default_factory=list)
    autos: list[tuple[int, ...]] = field(default_factory=list)

    @classmethod
    def of(cls, rank: int, code: str) -> Rule:
        head, _, tail = code.partition(GROUP)
        labels = head.split(UNIT)
        k = len(labels)
        cells = dict(zip(combinations(range(k), 2), tail.split(UNIT) if k > 1 else [], strict=True))
        cell = lambda i, j: cells[min(i, j), max(i, j)]
        autos = [p for p in permutations(range(k)) if [labels[i] for i in p] == labels and all(cell(p[a], p[b]) == c for (a, b), c in cells.items())]
        return cls(rank, code, labels, [(a, b, c) for (a, b), c in cells.items() if c], autos)

    @property
    def size(self) -> int:
        return len(self.labels)

    @property
    def orbit_sizes(self) -> list[int]:
        return sorted(len(o) for o in {frozenset(p[i] for p in self.autos) for i in range(self.size)})

    @property
    def fixed_points(self) -> list[int]:
        return [sum(p[i] == i for i in range(self.size)) for p in self.autos]

    def topology(self) -> str:
        """Name of the shape without labels."""
        n, m = self.size, len(self.edges)
        deg = sorted(sum(i in e[:2] for e in self.edges) for i in range(n))
        if n == 0:
            return "empty"
        if n == 1:
            return "singleton"
        if n == 2:
            return "edge"
        if n == 3 and m == 3:
            return "triangle"
        if m == n * (n - 1) // 2:
            return f"clique-K{n}"
        if m == n - 1:
            return f"path-P{n}" if deg[-1] <= 2 else f"star-S{n - 1}" if deg[-1] == n - 1 else "tree"
        if m == n and deg[0] == deg[-1] == 2:
            return f"cycle-C{n}"
        side = {0: 0}
        for _ in range(n):
            for a, b, _ in self.edges:
                for x, y in ((a, b), (b, a)):
                    if x in side:
                        side.setdefault(y, 1 - side[x])
        return "bipartite" if all(side[a] != side[b] for a, b, _ in self.edges) else "connected"


RULES = "rank int, code string, m_edges int, m_size int, autos array<array<int>>, fixed array<int>, aut_order int"


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.rank, r.code, len(r.edges), r.size, [list(p) for p in r.autos], r.fixed_points, len(r.autos)) for r in rules], RULES)


def motif_support(occ: DataFrame) -> DataFrame:
    """(code, size, graph_support, occurrences); counts per graph come first, so a frequent motif is pre-aggregated."""
    per = occ.groupBy("code", "size", "graph_id").agg(F.count("*").alias("n"))
    return per.groupBy("code", "size").agg(F.count("*").alias("graph_support"), F.sum("n").alias("occurrences"))


def top_motifs(support: DataFrame, k: int, min_support: int = 1, min_occurrences: int = 1) -> DataFrame:
    return support.filter((F.col("graph_support") >= min_support) & (F.col("occurrences") >= min_occurrences)).orderBy(F.desc("graph_support"), F.desc("occurrences"), "code").limit(k)


def fingerprint(occ: DataFrame) -> DataFrame:
    return occ.groupBy("graph_id", "size", "code").agg(F.count("*").alias("n"))


def nodewise_fingerprint(occ: DataFrame) -> DataFrame:
    return occ.withColumn("node_id", F.explode("nodes")).groupBy("graph_id", "node_id", "size", "code").agg(F.count("*").alias("n"))


def bit_info(occ: DataFrame) -> DataFrame:
    """The node sets behind each fingerprint entry, sorted."""
    return occ.groupBy("graph_id", "size", "code").agg(F.array_sort(F.collect_list("nodes")).alias("sets"))


class GraphletVocabulary:
    """Fingerprints to a frozen, sorted vocabulary; what it does not know is counted apart."""

    def fit(self, occ: DataFrame) -> GraphletVocabulary:
        from graphloom.operators.graphs import ordinal

        keys = occ.select("size", "code").distinct()
        self.vocabulary = ordinal(keys, [F.col("size"), F.col("code")], "col")
        return self

    def transform(self, occ: DataFrame) -> DataFrame:
        """(graph_id, col, value) of known keys."""
        self._check()
        return fingerprint(occ).join(self.vocabulary, ["size", "code"]).select("graph_id", "col", F.col("n").alias("value"))

    def unseen(self, occ: DataFrame) -> DataFrame:
        """(graph_id, size, code, n) of keys that fit did not meet."""
        self._check()
        return fingerprint(occ).join(self.vocabulary, ["size", "code"], "left_anti")

    def unseen_share(self, occ: DataFrame) -> DataFrame:
        """Per graph: occurrences, unseen ones, their share (0 of none)."""
        self._check()
        f = fingerprint(occ).join(self.vocabulary.withColumn("seen", F.lit(1)), ["size", "code"], "left")
        g = f.groupBy("graph_id").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("seen").isNull(), F.col("n"))), F.lit(0)).alias("unseen"))
        return g.withColumn("share", F.when(F.col("total") > 0, F.col("unseen") / F.col("total")).otherwise(0.0))

    def fit_transform(self, occ: DataFrame) -> DataFrame:
        return self.fit(occ).transform(occ)

    def feature_names(self) -> DataFrame:
        self._check()
        return self.vocabulary.select("col", F.concat_ws(":", F.col("size").cast("string"), "code").alias("name"))

    def _check(self) -> None:
        if not hasattr(self, "vocabulary"):
            raise RuntimeError("fit first")
