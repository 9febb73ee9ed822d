"""Analysis of a fitted dictionary: splits, motif tables, intervals, reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.stats import bootstrap, unpivot
from graphloom.operators.graphs import ordinal, running
from graphloom.operators.motifs import Rule
from graphloom.plans.compressor import MotifCompressor, Result
from graphloom.runtime import store
from graphloom.sources.sinks import markdown, write_bundle, write_json


@dataclass
class AnalysisConfig:
    fit_graphs: int = 200
    eval_graphs: int = 100
    seed: int = 0
    replicates: int = 1000
    level: float = 0.95

    def __post_init__(self) -> None:
        if self.fit_graphs < 1 or self.eval_graphs < 0 or self.replicates < 0 or not 0 < self.level < 1:
            raise ValueError("fit_graphs from 1, eval_graphs and replicates from 0, level between 0 and 1")


def hash_order(seed: int, key: str = "graph_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def split(graphs: DataFrame, fit: int, evaluate: int, seed: int = 0) -> DataFrame:
    """graphs with split: the first ``fit`` by hash are 'fit', the next 'eval', others null."""
    at = ordinal(graphs.withColumn("_h", F.conv(F.substring(hash_order(seed), 1, 12), 16, 10).cast("long")), [F.col("_h"), F.col("graph_id")], "_at")
    return at.withColumn("split", F.when(F.col("_at") < fit, "fit").when(F.col("_at") < fit + evaluate, "eval")).drop("_h", "_at")


def stratified_holdout(graphs: DataFrame, share: float, seed: int = 0, label: str = "label") -> DataFrame:
    """graphs with held_out: of each class the rounded share by hash, at least one and not all where the class has two."""
    size = graphs.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    ranked = running(graphs.withColumn("_h", hash_order(seed)), [label], [F.col("_h"), F.col("graph_id")], {}).join(size, F.col(label).eqNullSafe(F.col("_l")))
    n = F.col("_n")
    take = F.when(n > 1, F.least(F.greatest(F.round(n * share), F.lit(1)), n - 1)).otherwise(0)
    return ranked.withColumn("held_out", F.col("k") <= take).select(*graphs.columns, "held_out")


def coalesced_columns(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Canonical names first, aliases fill their nulls; the aliases go."""
    for name, others in aliases.items():
        have = [c for c in (name, *others) if c in rows.columns]
        if have:
            rows = rows.withColumn(name, F.coalesce(*have)).drop(*[c for c in have if c != name])
    return rows


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def motif_table(candidates: DataFrame, n_graphs: int) -> DataFrame:
    """Derived columns of candidates, in the order selected, forced savings, savings, occurrences."""
    rows = candidates.withColumns({
        "support_fraction": F.col("graph_support") / F.lit(max(n_graphs, 1)), "bits_per_occurrence": ratio("gross_gain_bits", "occurrences"), "forced_bits_per_contraction": ratio("forced_savings_bits", "contractions"),
        "boundary_bits_per_contraction": ratio("boundary_bits", "contractions"), "overlap_retention": ratio("contractions", "occurrences"), "savings_per_supporting_graph": ratio("single_rule_savings_bits", "graph_support"),
    })
    return rows.orderBy(F.desc("is_selected"), F.desc("forced_savings_bits"), F.desc("single_rule_savings_bits"), F.desc("occurrences"), "code")


def descriptors(spark, codes: list[str]) -> DataFrame:
    """One row for each motif code (a dictionary's, so few): shape, degrees, density, flags, label patterns, fingerprint."""
    import hashlib
    import json
    from collections import Counter

    out = []
    for c in codes:
        r = Rule.of(0, c)
        n, m = r.size, len(r.edges)
        deg = sorted((sum(i in e[:2] for e in r.edges) for i in range(n)), reverse=True)
        shape = r.topology()
        multiset = lambda xs: ", ".join(f"{k} x{v}" if v > 1 else k for k, v in sorted(Counter(xs).items()))
        text = "; ".join(f"{a}-{b}" + (f" [{x}]" if x else "") for a, b, x in r.edges)
        mark = hashlib.sha256(json.dumps([r.labels, r.edges]).encode()).hexdigest()[:16]
        out.append((c, shape, n, m, ",".join(map(str, deg)), 2 * m / (n * (n - 1)) if n > 1 else 0.0, m == n - 1, shape.startswith("cycle") or shape == "triangle", m == n * (n - 1) // 2, multiset(r.labels), multiset(e[2] for e in r.edges), text if len(text) <= 80 else text[:79] + "…", len(r.autos), mark))
    return spark.createDataFrame(out, "code string, shape string, n_nodes int, n_edges int, degrees string, density double, is_tree boolean, is_cycle boolean, is_clique boolean, node_labels string, edge_labels string, edges string, automorphisms int, fingerprint string")


def enrich(table: DataFrame, more: DataFrame, key: str = "code") -> DataFrame:
    """Columns of ``more`` added; where both have one, values that are there win."""
    both = [c for c in more.columns if c in table.columns and c != key]
    j = table.join(more.withColumnsRenamed({c: f"_more_{c}" for c in both}), key, "left")
    return j.withColumns({c: F.coalesce(c, f"_more_{c}") for c in both}).drop(*[f"_more_{c}" for c in both])


def forced_costs(table: DataFrame) -> DataFrame:
    """Gross gain, boundary and dictionary bits of each candidate, one row for each component."""
    return unpivot(table, ["motif_id", "code"], ["gross_gain_bits", "boundary_bits", "dictionary_bits"])


def cost_pivot(costs: DataFrame, components: list[str]) -> DataFrame:
    return costs.groupBy("motif_id").pivot("component", components).agg(F.sum("bits"))


def corpus_digest(occ: DataFrame) -> DataFrame:
    """SHA-256 of a corpus' occurrences: of each graph's sorted rows first, then of the sorted graphs' hashes in 256 groups."""
    per = occ.groupBy("graph_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("size", "code", "nodes")))), 256).alias("h"))
    groups = per.withColumn("g", F.substring("h", 1, 2)).groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("graph_id").cast("string"), "h"))), ","), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("g", "h"))), ","), 256).alias("digest"))


def graphs_with(occ: DataFrame, code: str) -> DataFrame:
    return occ.filter(F.col("code") == code).select("graph_id").distinct()


def ladder_features(sizes: DataFrame, fingerprints: DataFrame, columns: list[str], topology: DataFrame | None = None) -> DataFrame:
    """One row for each graph with a fixed set of columns: sizes, the counts of ``columns``, metrics if exposed, 0 where a graph has none."""
    # sums with a condition, not a filter: that one is moved below the count and there made of copies of all that a code is computed from
    wide = fingerprints.groupBy("graph_id").agg(*[F.sum(F.when(F.col("code") == c, F.col("n"))).alias(f"motif_{i}") for i, c in enumerate(columns)])
    out = sizes.join(wide, "graph_id", "left")
    if topology is not None:
        out = out.join(topology.select("graph_id", *[c for c in topology.columns if c not in sizes.columns]), "graph_id", "left")
    return out.na.fill(0, [c for c in out.columns if c != "graph_id"])


def rewrite_audit(per_graph: DataFrame, split_col: str) -> DataFrame:
    """For each split: eligible and rewritten graphs, and node and edge reductions where available and where selected."""
    cut = lambda a, b: F.col(a) - F.col(b)
    s = lambda flag, c: F.coalesce(F.sum(F.when(F.col(flag), c)), F.lit(0))
    return per_graph.groupBy(split_col).agg(
        F.count("*").alias("graphs"), F.count_if("eligible").alias("eligible"), F.count_if("use_rewrite").alias("rewritten"), s("eligible", cut("nodes", "carrier_nodes")).alias("available_nodes"), s("eligible", cut("edges", "carrier_edges")).alias("available_edges"),
        s("use_rewrite", cut("nodes", "carrier_nodes")).alias("selected_nodes"), s("use_rewrite", cut("edges", "carrier_edges")).alias("selected_edges"),
    )


@dataclass
class Analysis:
    motifs: DataFrame
    costs: DataFrame
    per_graph: DataFrame
    intervals: DataFrame
    fit: Result
    evaluated: Result | None
    summary: dict

    def save(self, path: str, fmt: str = "parquet") -> None:
        """Tables through Spark, the summary as JSON and Markdown where ``path`` is a local folder."""
        write_bundle(path, {"motifs": self.motifs, "costs": self.costs, "per_graph": self.per_graph, "intervals": self.intervals}, fmt)
        if "://" not in path:
            write_json(f"{path}/summary.json", self.summary)
            with open(f"{path}/summary.md", "w", encoding="utf-8") as f:
                f.write(markdown([{"quantity": k, "value": v} for k, v in self.summary.items()], ["quantity", "value"]) + "\n")


def run_analysis(nodes: DataFrame, edges: DataFrame, model: MotifCompressor, config: AnalysisConfig | None = None) -> Analysis:
    """Fits on one part of the graphs, evaluates on another, and describes both."""
    config = config or AnalysisConfig()
    parts = store(split(nodes.select("graph_id").distinct(), config.fit_graphs, config.eval_graphs, config.seed), "split")
    of = lambda d, s: d.join(parts.filter(F.col("split") == s).select("graph_id"), "graph_id", "left_semi")
    fit = model.fit(of(nodes, "fit"), of(edges, "fit")).transform(of(nodes, "fit"), of(edges, "fit"))
    evaluated = model.transform(of(nodes, "eval"), of(edges, "eval")) if config.eval_graphs else None
    spark = nodes.sparkSession
    candidates = model.candidate_frame(spark)
    table = enrich(motif_table(candidates, config.fit_graphs), descriptors(spark, [c["code"] for c in model._candidates]).drop("n_edges"))
    per = fit.per_graph.withColumn("split", F.lit("fit"))
    if evaluated is not None:
        per = per.unionByName(evaluated.per_graph.withColumn("split", F.lit("eval")))
    per = store(per, "per-graph")
    target = per.filter(F.col("split") == ("eval" if evaluated is not None else "fit"))
    metrics = {"gain": F.coalesce(F.when(F.col("use_rewrite"), F.col("gain")), F.lit(0.0)), "unseen_fraction": F.col("unseen_fraction"), "rewrite_fraction": F.col("use_rewrite").cast("double")}
    intervals = []
    for name, c in metrics.items():
        v = ordinal(target.select("graph_id", c.alias("value")), [F.col("graph_id")], "pos")
        intervals.append(bootstrap(v.select("pos", "value"), config.replicates, config.level, config.seed).withColumn("metric", F.lit(name)))
    summary = {f"fit_{k}": v for k, v in fit.report.first().asDict().items()}
    if evaluated is not None:
        summary |= {f"eval_{k}": v for k, v in evaluated.report.first().asDict().items()}
    return Analysis(table, forced_costs(candidates), per, reduce(DataFrame.unionByName, intervals), fit, evaluated, summary)
