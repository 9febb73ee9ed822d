"""Graph tables: checks, normalisation, complexity, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.runtime import store


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, from one pass over the edges."""
    way = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    return edges.select("graph_id", "label", F.inline(F.array(way("u", "v"), way("v", "u")))).select("graph_id", "u", "v", "label")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node, isolated ones included; parallel edges count each."""
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))
    return nodes.select("graph_id", "node_id").join(ends, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, problem, n) for self-loops, unknown ends, repeated edges or nodes, and missing labels; empty if all is well."""
    loops = edges.filter("u = v").select("graph_id", F.lit("self-loop").alias("problem"))
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")
    twice = edges.groupBy("graph_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).count().filter("count > 1")
    again = nodes.groupBy("graph_id", "node_id").count().filter("count > 1")
    bare = nodes.filter("label is null").select("graph_id").unionByName(edges.filter("label is null").select("graph_id"))
    found = [loops, *[d.select("graph_id", F.lit(p).alias("problem")) for d, p in ((ends, "unknown end"), (twice, "repeated edge"), (again, "repeated node"), (bare, "missing label"))]]
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out.groupBy("graph_id", "problem").agg(F.count("*").alias("n"))


def check(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises ValueError with the first problems."""
    if rows := violations(nodes, edges).orderBy("graph_id", "problem").limit(5).collect():
        raise ValueError("; ".join(f"graph {r.graph_id}: {r.n} x {r.problem}" for r in rows))


def normalize(nodes: DataFrame, edges: DataFrame, order: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """Node ids become 0..n-1 in each graph, by ``order``; the old id stays as ``source_id``."""
    ids = nodes.withColumn("source_id", F.col("node_id")).withColumn("node_id", (F.row_number().over(W.partitionBy("graph_id").orderBy(order)) - 1).cast("long"))
    at = ids.select("graph_id", F.col("source_id").alias("u"), F.col("node_id").alias("nu"))
    to = at.withColumnsRenamed({"u": "v", "nu": "nv"})
    moved = edges.join(at, ["graph_id", "u"]).join(to, ["graph_id", "v"])
    return ids.select("graph_id", "node_id", "label", "source_id"), moved.select("graph_id", F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"), "label")


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each pair; its label is the sorted multiset of the labels."""
    return edges.groupBy("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.concat_ws("+", F.array_sort(F.collect_list("label"))).alias("label"))


def complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, largest degree and wedges of each graph."""
    d = degrees(nodes, edges).groupBy("graph_id").agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"), F.sum((F.col("degree") * (F.col("degree") - 1) / 2).cast("long")).alias("wedges"), F.sum("degree").alias("ends"))
    return d.select("graph_id", "nodes", (F.col("ends") / 2).cast("long").alias("edges"), "max_degree", "wedges")


def within_caps(sizes: DataFrame, nodes: int | None = None, edges: int | None = None, max_degree: int | None = None, wedges: int | None = None) -> DataFrame:
    keep = F.lit(True)
    for name, cap in (("nodes", nodes), ("edges", edges), ("max_degree", max_degree), ("wedges", wedges)):
        if cap is not None:
            keep = keep & (F.col(name) <= cap)
    return sizes.filter(keep)


ROWS_PER_RANGE = 200_000
MOST_RANGES = 10_000


def dealt(df: DataFrame, keys: list[Column], label: str = "ordered") -> tuple[DataFrame, int]:
    """``df``, stored, with ``_range``: ranges of the order of all ``keys``, so ties in the first of them do not meet; and how many ranges there are, MOST_RANGES at most."""
    rows = store(df, label)
    n = min(MOST_RANGES, -(-rows.count() // ROWS_PER_RANGE))
    if n <= 1:
        return rows.withColumn("_range", F.lit(0)), 1
    return store(rows.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), label), n


def ordinal(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """0-based position of every row in a total order, without sorting all rows in one task: a position in a range, and the sizes of the ranges before."""
    rows, n = dealt(df, keys)
    out = rows.withColumn(name, (F.row_number().over(W.partitionBy("_range").orderBy(*keys)) - 1).cast("long"))
    if n == 1:
        return out.drop("_range")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return out.join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def running(df: DataFrame, group: list[str], keys: list[Column], sums: dict[str, Column]) -> DataFrame:
    """k, the position (from 1), and running sums of each group in order, range by range: no task holds a whole group."""
    rows, n = dealt(df, [*[F.col(g) for g in group], *keys], "running")
    w = W.partitionBy(*group, "_range").orderBy(*keys)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("k", F.row_number().over(w).cast("long")).withColumns({s: F.sum(c).over(upto) for s, c in sums.items()})
    if n == 1:
        return out.drop("_range")
    names = ["k", *sums]
    total = rows.groupBy(*group, "_range").agg(F.count("*").alias("_t_k"), *[F.sum(c).alias(f"_t_{s}") for s, c in sums.items()])
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    total = total.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in names])
    same = F.col("_range") == F.col("_r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return out.join(total, same).withColumns({s: F.col(s) + F.col(f"_b_{s}") for s in names}).drop("_range", "_r", *[f"_g_{g}" for g in group], *[f"_b_{s}" for s in names])


def size_bins(sizes: DataFrame, bins: int = 3) -> DataFrame:
    """Equal shares by size; bin = position * bins / graphs, rounded down."""
    n = sizes.count()
    keys = [F.col(c) for c in ("nodes", "edges", "max_degree", "wedges", "graph_id")]
    return ordinal(sizes, keys, "position").withColumn("bin", F.least(F.floor(F.col("position") * bins / max(n, 1)), F.lit(bins - 1)).cast("long"))


def stratified_sample(binned: DataFrame, count: int, seed: int = 0, bins: int = 3) -> DataFrame:
    """``count`` graphs, dealt evenly over bins, the remainder to the first; chosen by the MD5 of seed and id. Bins that fall short are filled from the rest."""
    return _sampled(binned, count, seed, bins).select(binned.columns)


def _sampled(binned: DataFrame, count: int, seed: int, bins: int) -> DataFrame:
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("graph_id").cast("string")))
    quota = F.lit(count // bins) + F.when(F.col("bin") < count % bins, 1).otherwise(0)
    ranked = running(binned.withColumn("_h", order), ["bin"], [F.col("_h"), F.col("graph_id")], {}).withColumn("_spare", (F.col("k") > quota).cast("int"))
    return ranked.orderBy("_spare", "_h", "graph_id").limit(count)


def sample_manifest(sizes: DataFrame, dataset: str, fit: int, evaluate: int, seed: int = 0, bins: int = 3, **caps: int) -> DataFrame:
    """A sample of graphs within the caps, even over bins of size, dealt to fit and eval, with what is known of each.

    Raises ValueError if fewer graphs are eligible than asked for. The sample itself is small: it is one task's.
    """
    if fit < 1 or evaluate < 1:
        raise ValueError("fit and evaluate from 1")
    total, eligible = sizes.count(), within_caps(sizes, **caps)
    n = eligible.count()
    if n < fit + evaluate:
        span = lambda d: ", ".join(f"{c}={r[0]}..{r[1]}" for c in ("nodes", "edges", "max_degree", "wedges") for r in [d.agg(F.min(c), F.max(c)).first()])
        raise ValueError(f"{fit + evaluate} graphs wanted, {n} eligible under {caps or 'no caps'}; all: {span(sizes)}; eligible: {span(eligible)}")
    picked = _sampled(size_bins(eligible, bins), fit + evaluate, seed, bins)
    at = F.row_number().over(W.orderBy("_spare", "_h", "graph_id")) - 1
    rows = picked.withColumn("at", at).withColumn("split", F.when(F.col("at") < fit, "fit").otherwise("eval")).withColumn("sample_position", F.when(F.col("at") < fit, F.col("at")).otherwise(F.col("at") - fit).cast("long"))
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(seed).alias("seed"), "split", "sample_position", "graph_id", F.col("bin").alias("size_bin"), "nodes", "edges", "max_degree", "wedges", F.lit(n).cast("long").alias("eligible_graphs"), F.lit(total).cast("long").alias("all_graphs"))


def topology_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Density, mean, deviation and maximum of degrees, triangles, transitivity and mean clustering of each graph."""
    deg = degrees(nodes, edges)
    adj = adjacency(edges)
    closed = adj.select("graph_id", F.col("u").alias("c"), F.col("v").alias("a")).join(adj.select("graph_id", F.col("u").alias("c"), F.col("v").alias("b")), ["graph_id", "c"]).filter("a < b")
    closed = closed.join(edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b")), ["graph_id", "a", "b"], "left_semi").groupBy("graph_id", F.col("c").alias("node_id")).agg(F.count("*").alias("t"))
    each = deg.join(closed, ["graph_id", "node_id"], "left").withColumn("t", F.coalesce("t", F.lit(0))).withColumn("w", F.col("degree") * (F.col("degree") - 1) / 2)
    g = each.groupBy("graph_id").agg(
        F.count("*").alias("nodes"), (F.sum("degree") / 2).alias("m"), F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("std_degree"), F.max("degree").alias("max_degree"),
        F.sum("t").alias("corners"), F.sum("w").alias("wedges"), F.avg(F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0)).alias("clustering"),
    )
    density = F.when(F.col("nodes") > 1, 2 * F.col("m") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return g.select(
        "graph_id", "nodes", F.col("m").cast("long").alias("edges"), density.alias("density"), "mean_degree", "std_degree", "max_degree", (F.col("corners") / 3).cast("long").alias("triangles"),
        F.when(F.col("wedges") > 0, F.col("corners") / F.col("wedges")).otherwise(0.0).alias("transitivity"), "clustering",
    )


def connected_components(nodes: DataFrame, edges: DataFrame, store) -> DataFrame:
    """(graph_id, node_id, component): the least node reached; labels spread along edges, each round written by ``store``."""
    adj = adjacency(edges).select("graph_id", "u", "v")
    now = store(nodes.select("graph_id", "node_id", F.col("node_id").alias("component")))
    while True:
        got = adj.join(now.select("graph_id", F.col("node_id").alias("v"), F.col("component").alias("c")), ["graph_id", "v"]).groupBy("graph_id", F.col("u").alias("node_id")).agg(F.min("c").alias("c"))
        new = now.join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.least("component", "c").alias("component"))
        # a component is a node itself: its own label is a shorter way
        jump = new.select("graph_id", F.col("node_id").alias("component"), F.col("component").alias("j"))
        new = store(new.join(jump, ["graph_id", "component"]).select("graph_id", "node_id", F.least("component", "j").alias("component")))
        if new.join(now.withColumnRenamed("component", "was"), ["graph_id", "node_id"]).filter("component != was").isEmpty():
            return new
        now = new


def structural_features(nodes: DataFrame, edges: DataFrame, motif_rank: Column | None = None) -> DataFrame:
    """1, log1p of the degree, share of the largest degree, whether the node is a motif, log1p of its rank."""
    most = F.max("degree").over(W.partitionBy("graph_id"))
    d = degrees(nodes, edges).join(nodes, ["graph_id", "node_id"]).withColumn("most", most)
    rank = F.lit(None).cast("double") if motif_rank is None else motif_rank.cast("double")
    return d.select("graph_id", "node_id", F.lit(1.0).alias("one"), F.log1p("degree").alias("log_degree"), (F.col("degree") / F.greatest("most", F.lit(1))).alias("degree_share"), rank.isNotNull().cast("double").alias("is_motif"), F.coalesce(F.log1p(rank), F.lit(0.0)).alias("log_rank"))


def message_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both directions and a loop for every node."""
    loops = nodes.select("graph_id", F.col("node_id").alias("u"), F.col("node_id").alias("v"))
    return adjacency(edges).select("graph_id", "u", "v").unionByName(loops)


def gcn_aggregate(messages: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Symmetric-normalised sum of a column over message edges: one convolution without its weights."""
    size = messages.groupBy("graph_id", F.col("u").alias("node_id")).agg(F.count("*").alias("d"))
    v = values.join(size, ["graph_id", "node_id"]).select("graph_id", F.col("node_id").alias("v"), (F.col(column) / F.sqrt("d")).alias("x"))
    got = messages.join(v, ["graph_id", "v"]).groupBy("graph_id", F.col("u").alias("node_id")).agg(F.sum("x").alias("x"))
    return got.join(size, ["graph_id", "node_id"]).select("graph_id", "node_id", (F.col("x") / F.sqrt("d")).alias(column))
