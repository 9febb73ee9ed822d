"""Minimum-description-length dictionaries of motifs: fit, frozen transform, prefixes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import costs, graphs, motifs, rewriting
from graphloom.operators.motifs import Rule
from graphloom.runtime import exists, store

SELECTORS = ("sparse", "per_graph", "all_eligible")
SELECTIONS = ("best", "best_nonempty", "fixed")


def corpus_digest(nodes: DataFrame, edges: DataFrame) -> str:
    """The same for the same rows in any order: counts and sums of 64-bit hashes, so a cache is trusted as far as those."""
    one = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.xxhash64(F.lit(1), *d.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return hashlib.sha1(repr([tuple(map(int, one(d))) for d in (nodes, edges)]).encode()).hexdigest()


def positive_bits(n: int) -> float:
    n = max(n, 1)
    return log2(n) + log2(n + 1)


@dataclass
class Result:
    """Lazy tables of one evaluated corpus."""

    rules: list[Rule]
    per_graph: DataFrame
    report: DataFrame
    curve: DataFrame
    carrier_nodes: DataFrame
    carrier_edges: DataFrame
    packed: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def model_graphs(self, force_rewrite: bool = False) -> tuple[DataFrame, DataFrame]:
        """Nodes (graph_id, cid, kind, label) and edges of carriers where used, else of the originals."""
        use = self.per_graph.filter("eligible" if force_rewrite else "use_rewrite").select("graph_id")
        plain = lambda n: F.concat(F.lit("n"), F.col(n).cast("string"))
        n = self.carrier_nodes.join(use, "graph_id", "left_semi").select("graph_id", "cid", "kind", "label").unionByName(self.nodes.join(use, "graph_id", "left_anti").select("graph_id", plain("node_id").alias("cid"), F.lit("data").alias("kind"), "label"))
        none = F.lit(None).cast("int")
        e = self.carrier_edges.join(use, "graph_id", "left_semi").drop("eval_id").unionByName(self.edges.join(use, "graph_id", "left_anti").select("graph_id", plain("u").alias("src"), plain("v").alias("dst"), "label", none.alias("src_port"), none.alias("dst_port")))
        return n, e

    def decoded(self) -> tuple[DataFrame, DataFrame]:
        spark = self.nodes.sparkSession
        table = spark.createDataFrame([(r.rank, r.labels, [{"a": a, "b": b, "label": c} for a, b, c in r.edges]) for r in self.rules], "rank int, labels array<string>, medges array<struct<a:int,b:int,label:string>>")
        return rewriting.decode(self.carrier_nodes, self.carrier_edges, self.packed, table)

    def decode_failures(self) -> DataFrame:
        return rewriting.mismatches(self.nodes, self.edges, *self.decoded())


@dataclass
class MotifCompressor:
    """Learns a dictionary of motifs; see the fields for its settings."""

    graphlet_sizes: tuple[int, ...] = (3,)
    n_rules: int = 5
    min_graph_support: int = 2
    min_occurrences: int = 2
    max_candidates: int = 100
    selector: str = "sparse"
    model_choice_bits: float = 1.0
    min_rule_savings_bits: float = 0.0
    dictionary_selection: str = "best"
    topology_only: bool = False
    validate: bool = True
    cache_dir: str | None = None  # occurrences of a corpus met before are read from here
    rules: list[Rule] | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        self.graphlet_sizes = tuple(sorted(set(self.graphlet_sizes)))
        if not self.graphlet_sizes or self.graphlet_sizes[0] < 2 or self.graphlet_sizes[-1] > motifs.MAX_SIZE:
            raise ValueError(f"sizes from 2 to {motifs.MAX_SIZE}")
        if self.n_rules < 0 or self.max_candidates < 1:
            raise ValueError("n_rules from 0, max_candidates from 1")
        if self.selector not in SELECTORS or self.dictionary_selection not in SELECTIONS:
            raise ValueError("unknown selector or dictionary selection")

    # inputs

    def _prepared(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        nodes, edges = nodes.select("graph_id", "node_id", "label"), edges.select("graph_id", "u", "v", "label")
        if self.topology_only:
            nodes, edges = nodes.withColumn("label", F.lit("_")), edges.withColumn("label", F.lit("_"))
        if self.validate:
            graphs.check(nodes, edges)
        return nodes, edges, self._occurrences(nodes, edges)

    def _occurrences(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        occ = motifs.occurrences(nodes, edges, self.graphlet_sizes)
        if self.cache_dir is None:
            return store(occ, "occurrences")
        path = f"{self.cache_dir}/occurrences-{'-'.join(map(str, self.graphlet_sizes))}-{corpus_digest(nodes, edges)}"
        if not exists(nodes.sparkSession, f"{path}/_SUCCESS"):
            occ.write.mode("overwrite").parquet(path)
        return nodes.sparkSession.read.schema(occ.schema).parquet(path)

    def _check(self) -> None:
        if self.rules is None:
            raise RuntimeError("fit first")

    # evaluation of many dictionaries in one plan

    def _evaluate(self, nodes: DataFrame, edges: DataFrame, occ: DataFrame, base: DataFrame, use: DataFrame, rules: list[Rule], sizes: dict[int, int], dictionary: dict[int, float]):
        """``base``: baseline bits; ``use``: (eval_id, rank, code); ``sizes``: rules of each eval. Returns per graph and eval costs, carriers, packing, totals."""
        spark = nodes.sparkSession
        table = motifs.rule_table(spark, rules)
        cands = occ.select("graph_id", "code", "mapping", "ext").join(F.broadcast(use), "code").join(F.broadcast(table.select("rank", "m_edges", "m_size")), "rank")
        packed = store(rewriting.pack(cands.select("eval_id", "graph_id", "ext", "m_edges", "m_size", "rank", "mapping")), "packed")
        cn, ce = rewriting.contract(nodes, edges, packed)
        cn, ce = store(cn, "carrier-nodes"), store(ce, "carrier-edges")
        n_rules = F.lit(0)
        for e, n in sizes.items():
            n_rules = F.when(F.col("eval_id") == e, n).otherwise(n_rules)
        if len(set(sizes.values())) == 1:
            n_rules = F.lit(next(iter(sizes.values())))
        cost = costs.rewrite_costs(cn, ce, table, n_rules, self.node_alphabet, self.edge_alphabet)
        picked = packed.groupBy("eval_id", "graph_id").agg(F.count("*").alias("n_occurrences"))
        per = cost.join(picked, ["eval_id", "graph_id"]).join(base, "graph_id")
        per = store(per.withColumn("gain", F.col("bits") - F.col("template") - F.col("boundary")), "costs")
        n = base.count()
        total = spark.createDataFrame([(e, n, float(dictionary[e])) for e in sizes], "eval_id int, n_graphs long, dictionary double")
        return per, cn, ce, packed, total

    def _baseline(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return store(costs.baseline_bits(nodes, edges, self.node_alphabet, self.edge_alphabet), "baseline")

    def _nets(self, per: DataFrame, total: DataFrame) -> tuple[dict, dict]:
        """What each eval selects, free and forced."""
        curve = store(costs.sparse_curve(per, total, self.model_choice_bits), "curve") if self.selector == "sparse" else None
        return tuple({r.eval_id: r for r in costs.select_graphs(per, total, self.selector, self.model_choice_bits, forced, curve).collect()} for forced in (False, True))

    def _rule_bits(self, spark: SparkSession, rules: list[Rule]) -> list[float]:
        """Bits of each motif as a graph."""
        if not rules:
            return []
        n = spark.createDataFrame([(r.rank, i, x) for r in rules for i, x in enumerate(r.labels)], "graph_id long, node_id long, label string")
        e = spark.createDataFrame([(r.rank, a, b, x) for r in rules for a, b, x in r.edges], "graph_id long, u long, v long, label string")
        got = {r.graph_id: r.bits for r in costs.baseline_bits(n, e, self.node_alphabet, self.edge_alphabet).collect()}
        return [got[r.rank] for r in rules]

    # estimator

    def fit(self, nodes: DataFrame, edges: DataFrame) -> MotifCompressor:
        spark = nodes.sparkSession
        nodes, edges, occ = self._prepared(nodes, edges)
        self.node_alphabet = nodes.select("label").distinct().count()
        self.edge_alphabet = edges.select("label").distinct().count()
        support = store(motifs.motif_support(occ), "support")
        self.seen = support.select("code")
        top = motifs.top_motifs(support, self.max_candidates, self.min_graph_support, self.min_occurrences).collect()  # max_candidates rows
        found = [Rule.of(i, r.code) for i, r in enumerate(top)]
        base = self._baseline(nodes, edges) if found else None
        self._candidates, ranked = [], []
        if found:
            bits = self._rule_bits(spark, found)
            one = {r.rank: positive_bits(1) + b for r, b in zip(found, bits, strict=True)}
            use = spark.createDataFrame([(r.rank, r.rank, r.code) for r in found], "eval_id int, rank int, code string")
            per, _, _, _, total = self._evaluate(nodes, edges, occ, base, use, found, {r.rank: 1 for r in found}, one)
            free, forced = self._nets(per, total)
            kept = {r.eval_id: r for r in per.groupBy("eval_id").agg(F.sum("n_occurrences").alias("n"), F.count("*").alias("g"), F.sum("gain").alias("gain"), F.sum("boundary").alias("boundary")).collect()}
            for r, t in zip(found, top, strict=True):
                k = kept.get(r.rank)
                self._candidates.append(
                    {"code": r.code, "size": r.size, "n_edges": len(r.edges), "topology": r.topology(), "graph_support": t.graph_support, "occurrences": t.occurrences, "contractions": k.n if k else 0, "eligible_graphs": k.g if k else 0,
                     "gross_gain_bits": k.gain if k else 0.0, "boundary_bits": k.boundary if k else 0.0, "dictionary_bits": one[r.rank], "single_rule_savings_bits": free[r.rank].net, "forced_savings_bits": forced[r.rank].net, "forced_graphs": forced[r.rank].n_selected}
                )
            self._candidates.sort(key=lambda c: (-round(c["forced_savings_bits"], 9), -c["graph_support"], -c["occurrences"], c["code"]))
            for i, c in enumerate(self._candidates):
                c |= {"rank": i + 1, "motif_id": f"M{i + 1:03d}", "passes": c["forced_savings_bits"] >= self.min_rule_savings_bits}
            ranked = [Rule.of(i, c["code"]) for i, c in enumerate(self._candidates[: self.n_rules])]
        self.ranked = ranked
        self._path = [{"n_rules": 0, "dictionary_bits": 0.0, "n_selected": 0, "net_savings_bits": -float(self.model_choice_bits), "forced_savings_bits": -float(self.model_choice_bits), "eligible": True}]
        allowed = sum(1 for c in self._candidates[: self.n_rules] if c["passes"]) if ranked else 0
        if ranked:
            bits = self._rule_bits(spark, ranked)
            dictionary = {k: positive_bits(k) + sum(bits[:k]) for k in range(1, len(ranked) + 1)}
            use = spark.createDataFrame([(k, r.rank, r.code) for k in dictionary for r in ranked[:k]], "eval_id int, rank int, code string")
            per, _, _, _, total = self._evaluate(nodes, edges, occ, base, use, ranked, {k: k for k in dictionary}, dictionary)
            free, forced = self._nets(per, total)
            for k in dictionary:
                self._path.append({"n_rules": k, "dictionary_bits": dictionary[k], "n_selected": free[k].n_selected, "net_savings_bits": free[k].net, "forced_savings_bits": forced[k].net, "eligible": k <= allowed})
        options = [p for p in self._path if p["eligible"]]
        if self.dictionary_selection == "fixed":
            n = options[-1]["n_rules"]
        else:
            if self.dictionary_selection == "best_nonempty" and len(options) > 1:
                options = options[1:]
            n = max(options, key=lambda p: (round(p["net_savings_bits"], 9), -p["n_rules"]))["n_rules"]
        self.rules = ranked[:n]
        return self

    def transform(self, nodes: DataFrame, edges: DataFrame, n_rules: int | None = None, forced: bool = False) -> Result:
        """Evaluates a corpus with the frozen dictionary, or its first ``n_rules`` ranked rules."""
        self._check()
        spark = nodes.sparkSession
        rules = self.rules if n_rules is None else self.rule_prefix(n_rules)
        nodes, edges, occ = self._prepared(nodes, edges)
        use = spark.createDataFrame([(0, r.rank, r.code) for r in rules], "eval_id int, rank int, code string")
        dictionary = positive_bits(len(rules)) + sum(self._rule_bits(spark, rules)) if rules else 0.0
        base = self._baseline(nodes, edges)
        per, cn, ce, packed, total = self._evaluate(nodes, edges, occ, base, use, rules, {0: len(rules)}, {0: dictionary})
        chosen = store(costs.select_graphs(per, total, self.selector, self.model_choice_bits, forced), "chosen")
        flagged = costs.used(per, chosen)
        met = occ.groupBy("graph_id").agg(F.count("*").alias("graphlets"))
        new = occ.join(self.seen, "code", "left_anti").groupBy("graph_id").agg(F.count("*").alias("unseen"))
        cols = flagged.select("graph_id", "carrier_nodes", "carrier_edges", "template", "boundary", "gain", "n_occurrences", "use_rewrite", F.lit(True).alias("eligible"))
        per_graph = base.withColumnRenamed("bits", "baseline").join(cols, "graph_id", "left").join(met, "graph_id", "left").join(new, "graph_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        per_graph = per_graph.withColumns({"use_rewrite": F.coalesce("use_rewrite", F.lit(False)), "eligible": F.coalesce("eligible", F.lit(False)), "graphlets": zero("graphlets"), "unseen": zero("unseen")})
        per_graph = per_graph.withColumn("unseen_fraction", F.when(F.col("graphlets") > 0, F.col("unseen") / F.col("graphlets")).otherwise(0.0))
        part = F.when(F.col("use_rewrite"), 1)
        sums = per_graph.agg(
            F.count("*").alias("n_graphs"), F.sum("baseline").alias("baseline_bits"), F.coalesce(F.sum(part * F.col("gain")), F.lit(0.0)).alias("gross_gain_bits"), F.coalesce(F.sum(part * F.col("template")), F.lit(0.0)).alias("template_bits"),
            F.coalesce(F.sum(part * F.col("boundary")), F.lit(0.0)).alias("boundary_bits"), F.count(part).alias("graphs_rewritten"), F.count(F.when(F.col("eligible"), 1)).alias("graphs_eligible"),
        )
        report = sums.crossJoin(F.broadcast(chosen.select(F.col("net").alias("net_savings_bits")))).withColumn("n_rules", F.lit(len(rules))).withColumn("dictionary_bits", F.lit(float(dictionary)))
        report = report.withColumn("encoded_bits", F.col("baseline_bits") - F.col("net_savings_bits")).withColumn("bits_per_graph", F.col("net_savings_bits") / F.col("n_graphs"))
        result = Result(rules, per_graph, report, costs.sparse_curve(per, total, self.model_choice_bits), cn, ce, packed, nodes, edges)
        if self.validate and rules and not result.decode_failures().isEmpty():
            raise ValueError("a decoded graph differs from its original")
        return result

    def fit_transform(self, nodes: DataFrame, edges: DataFrame) -> Result:
        return self.fit(nodes, edges).transform(nodes, edges)

    def rule_prefix(self, n: int) -> list[Rule]:
        self._check()
        if not 0 <= n <= len(self.ranked):
            raise ValueError(f"0 to {len(self.ranked)} rules")
        return self.ranked[:n]

    # tables

    def candidate_frame(self, spark: SparkSession) -> DataFrame:
        self._check()
        chosen = {r.code for r in self.rules}
        rows = [c | {"is_selected": c["code"] in chosen} for c in self._candidates]
        schema = "rank int, motif_id string, code string, size int, n_edges int, topology string, graph_support long, occurrences long, contractions long, eligible_graphs long, gross_gain_bits double, boundary_bits double, dictionary_bits double, single_rule_savings_bits double, forced_savings_bits double, forced_graphs long, passes boolean, is_selected boolean"
        return spark.createDataFrame(rows, schema)

    def dictionary_frame(self, spark: SparkSession) -> DataFrame:
        self._check()
        return spark.createDataFrame([(r.rank, r.code, r.size, len(r.edges), r.topology(), len(r.autos), r.orbit_sizes) for r in self.rules], "rank int, code string, size int, n_edges int, topology string, aut_order int, orbit_sizes array<int>")

    def path_frame(self, spark: SparkSession) -> DataFrame:
        self._check()
        return spark.createDataFrame(self._path, "n_rules int, dictionary_bits double, n_selected long, net_savings_bits double, forced_savings_bits double, eligible boolean")

    # model directory

    def save(self, path: str, spark: SparkSession) -> None:
        """Dictionary, candidates, path and seen codes as tables under ``path``."""
        for name, df in (("dictionary", self.dictionary_frame(spark)), ("candidates", self.candidate_frame(spark)), ("path", self.path_frame(spark)), ("seen", self.seen)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        settings = [(len(self.rules), self.node_alphabet, self.edge_alphabet, self.selector, float(self.model_choice_bits), self.topology_only, list(self.graphlet_sizes), [r.code for r in self.ranked])]
        spark.createDataFrame(settings, "n int, node_alphabet long, edge_alphabet long, selector string, choice double, topology_only boolean, sizes array<int>, ranked array<string>").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> MotifCompressor:
        s = spark.read.parquet(f"{path}/settings").first()
        self = cls(graphlet_sizes=tuple(s.sizes), selector=s.selector, model_choice_bits=s.choice, topology_only=s.topology_only)
        self.node_alphabet, self.edge_alphabet = s.node_alphabet, s.edge_alphabet
        self.ranked = [Rule.of(i, c) for i, c in enumerate(s.ranked)]
        self.rules = self.ranked[: s.n]
        self.seen = spark.read.parquet(f"{path}/seen")
        self._candidates = [r.asDict() for r in spark.read.parquet(f"{path}/candidates").orderBy("rank").collect()]
        self._path = [r.asDict() for r in spark.read.parquet(f"{path}/path").orderBy("n_rules").collect()]
        return self
