"""Code lengths of graphs, carriers and dictionaries, and the selectors of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.codelength import dirichlet_multinomial_bits, log2_choose_fast, log2_factorial, orbit_bits_log2, positive_integer_bits, sum_log2
from graphloom.operators.graphs import running
from graphloom.operators.rewriting import KEYS, boundaries


def graph_bits(keys: list[str], labels: DataFrame, edge_labels: DataFrame, degree_rows: DataFrame, node_alphabet: Column, edge_alphabet: Column) -> DataFrame:
    """(keys, nodes, edges, bits) from rows (keys, label), (keys, label) and (keys, degree).

    Each part is counted before it is gathered, so a key holds arrays of distinct labels and degrees only.
    """
    count = lambda d, c, name: d.groupBy(*keys, c).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.collect_list("n").alias(name))
    deg = degree_rows.groupBy(*keys, "degree").agg(F.count("*").alias("n")).groupBy(*keys)
    deg = deg.agg(
        F.sum("n").alias("nodes"), (F.sum(F.col("degree") * F.col("n")) / 2).cast("long").alias("edges"), F.max("degree").cast("int").alias("top"),
        F.sum(F.col("n") * log2_factorial(F.col("degree").cast("int"))).alias("each"), F.collect_list("n").alias("degree_counts"),
    )
    rows = deg.join(count(labels, "label", "label_counts"), keys, "left").join(count(edge_labels, "label", "edge_counts"), keys, "left")
    none = F.array().cast("array<bigint>")
    m = F.col("edges").cast("int")
    topology = F.when(m == 0, F.lit(0.0)).otherwise(log2_factorial(2 * m) - log2_factorial(m) - m - F.col("each"))
    bits = (
        topology + dirichlet_multinomial_bits(F.coalesce("label_counts", none), node_alphabet) + dirichlet_multinomial_bits(F.coalesce("edge_counts", none), edge_alphabet)
        + positive_integer_bits(F.col("nodes")) + positive_integer_bits(F.col("top")) + dirichlet_multinomial_bits(F.col("degree_counts"), F.col("top") + 1)
    )
    return rows.select(*keys, "nodes", "edges", bits.alias("bits"))


def baseline_bits(nodes: DataFrame, edges: DataFrame, node_alphabet: int, edge_alphabet: int) -> DataFrame:
    """(graph_id, nodes, edges, bits) of the original graphs."""
    from graphloom.operators.graphs import degrees

    return graph_bits(["graph_id"], nodes.select("graph_id", "label"), edges.select("graph_id", "label"), degrees(nodes, edges).select("graph_id", "degree"), F.lit(node_alphabet), F.lit(edge_alphabet))


def template_bits(carrier_nodes: DataFrame, carrier_edges: DataFrame, n_rules: Column, node_alphabet: int, edge_alphabet: int) -> DataFrame:
    """(eval_id, graph_id, carrier_nodes, carrier_edges, template) of the carriers' incidence graphs, which are never built.

    An incidence graph has a node of degree 2 for each edge, labelled with it, and unlabelled edges.
    ``n_rules``: a column expression over eval_id.
    """
    labels = carrier_nodes.select(*KEYS, F.concat_ws("\x1f", "kind", "label").alias("label")).unionByName(carrier_edges.select(*KEYS, F.concat(F.lit("edge\x1f"), F.col("label")).alias("label")))
    ends = carrier_edges.select(*KEYS, F.explode(F.array("src", "dst")).alias("cid")).groupBy(*KEYS, "cid").agg(F.count("*").alias("degree"))
    degree = carrier_nodes.select(*KEYS, "cid").join(ends, [*KEYS, "cid"], "left").select(*KEYS, F.coalesce("degree", F.lit(0)).alias("degree"))
    degree = degree.unionByName(carrier_edges.select(*KEYS, F.lit(2).cast("long").alias("degree")))
    unlabelled = carrier_edges.select(*KEYS, F.lit("").alias("label"))
    bits = graph_bits(KEYS, labels, unlabelled, degree, F.lit(node_alphabet) + n_rules + F.lit(edge_alphabet), F.lit(1))
    n_edges = (F.col("edges") / 2).cast("long")  # two incidence edges for each
    return bits.select(*KEYS, (F.col("nodes") - n_edges).alias("carrier_nodes"), n_edges.alias("carrier_edges"), F.col("bits").alias("template"))


def boundary_bits(bounds: DataFrame, rules: DataFrame, raw: bool = False) -> DataFrame:
    """(eval_id, graph_id, boundary): signatures of supernodes with equal rule, boundary size and context share a code. ``raw``: without the automorphisms, of n^b signatures."""
    group = [*KEYS, "rank", "b", "context"]
    counts = bounds.groupBy(*group, "raw_signature" if raw else "signature").agg(F.count("*").alias("n")).groupBy(*group).agg(F.collect_list("n").alias("counts"), F.sum("n").cast("int").alias("total"))
    rows = counts.join(F.broadcast(rules.select("rank", "fixed", "aut_order", "m_size")), "rank")
    rows = rows.withColumn("log_orbits", F.col("b") * F.log2(F.col("m_size").cast("double")) if raw else orbit_bits_log2(F.col("fixed"), F.col("aut_order"), F.col("b")))
    each = F.aggregate("counts", F.lit(0.0), lambda a, c: a + sum_log2(F.lit(0.5), c.cast("int")))
    huge = F.col("total") * (F.col("log_orbits") - 1) - each  # where n symbols more do not change the logarithm
    exact = dirichlet_multinomial_bits(F.col("counts"), F.greatest(F.floor(F.pow(F.lit(2.0), F.col("log_orbits")) + 1e-6), F.lit(1)))
    return rows.groupBy(*KEYS).agg(F.sum(F.when(F.col("log_orbits") > 50, huge).otherwise(exact)).alias("boundary"))


def rewrite_costs(carrier_nodes: DataFrame, carrier_edges: DataFrame, rules: DataFrame, n_rules: Column, node_alphabet: int, edge_alphabet: int) -> DataFrame:
    """(eval_id, graph_id, carrier_nodes, carrier_edges, template, boundary)."""
    t = template_bits(carrier_nodes, carrier_edges, n_rules, node_alphabet, edge_alphabet)
    b = boundary_bits(boundaries(carrier_nodes, carrier_edges, rules), rules)
    return t.join(b, KEYS, "left").withColumn("boundary", F.coalesce("boundary", F.lit(0.0)))


def sparse_curve(per_graph: DataFrame, total: DataFrame, choice_bits: float) -> DataFrame:
    """(eval_id, k, graph_id, gain_sum, net): the k graphs of largest gain are rewritten; k = 0 costs the choice alone.

    ``per_graph``: eval_id, graph_id, gain of eligible graphs; ``total``: eval_id, n_graphs, dictionary, one row for each eval.
    """
    rows = running(per_graph.select("eval_id", "graph_id", "gain"), ["eval_id"], [-F.col("gain"), F.col("graph_id")], {"gain_sum": F.col("gain")}).join(F.broadcast(total), "eval_id")
    net = F.col("gain_sum") - F.col("dictionary") - positive_integer_bits(F.col("k")) - log2_choose_fast(F.col("n_graphs"), F.col("k")) - choice_bits
    zero = total.select("eval_id", F.lit(0).cast("long").alias("k"), F.lit(None).cast("long").alias("graph_id"), F.lit(0.0).alias("gain_sum"), F.lit(-float(choice_bits)).alias("net"))
    return rows.select("eval_id", "k", F.col("graph_id").cast("long").alias("graph_id"), "gain_sum", net.alias("net")).unionByName(zero)


def select_graphs(per_graph: DataFrame, total: DataFrame, selector: str = "sparse", choice_bits: float = 1.0, forced: bool = False, curve: DataFrame | None = None) -> DataFrame:
    """(eval_id, n_selected, least_gain, last_graph, net): one row for each eval.

    A graph is used if it is eligible and comes no later than (least_gain, last_graph) in the order of
    falling gain. ``forced`` demands a rewrite where one exists, and charges the dictionary for per_graph
    and all_eligible even if no graph has one. ``curve``: sparse_curve of the same, where the caller has it.
    """
    if selector == "sparse":
        curve = sparse_curve(per_graph, total, choice_bits) if curve is None else curve
        if forced:
            has = per_graph.select("eval_id").distinct().withColumn("has", F.lit(True))
            curve = curve.join(has, "eval_id", "left").filter("has is null or k > 0").drop("has")
        best = curve.groupBy("eval_id").agg(F.max(F.struct(F.round("net", 9).alias("r"), (-F.col("k")).alias("k"), "net", "graph_id")).alias("b"))
        best = best.select("eval_id", (-F.col("b.k")).alias("n_selected"), F.col("b.graph_id").alias("last_graph"), F.col("b.net").alias("net"))
        gain = per_graph.select("eval_id", F.col("graph_id").alias("last_graph"), F.col("gain").alias("least_gain"))
        return best.join(gain, ["eval_id", "last_graph"], "left").select("eval_id", "n_selected", "least_gain", "last_graph", "net")
    if selector not in ("per_graph", "all_eligible"):
        raise ValueError(f"unknown selector {selector!r}")
    flags = F.col("n_graphs") if selector == "per_graph" else F.lit(0)
    use = per_graph if selector == "all_eligible" else per_graph.filter("gain > 0")
    if forced and selector == "per_graph":  # where no gain is positive, the best graph is taken
        top = per_graph.groupBy("eval_id").agg(F.max(F.struct("gain", (-F.col("graph_id")).alias("g"))).alias("t"))
        use = per_graph.join(F.broadcast(top), "eval_id").filter((F.col("gain") > 0) | ((F.col("gain") == F.col("t.gain")) & (F.col("graph_id") == -F.col("t.g")))).select(per_graph.columns)
    got = use.groupBy("eval_id").agg(F.count("*").alias("n_selected"), F.sum("gain").alias("gain_sum"), F.min(F.struct("gain", (-F.col("graph_id")).alias("g"))).alias("edge"))
    rows = F.broadcast(total).join(got, "eval_id", "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))
    charged = F.when((F.col("n_selected") > 0) | F.lit(forced), F.col("dictionary")).otherwise(0.0)
    net = F.coalesce("gain_sum", F.lit(0.0)) - charged - flags - choice_bits
    return rows.select("eval_id", "n_selected", F.col("edge.gain").alias("least_gain"), (-F.col("edge.g")).alias("last_graph"), net.alias("net"))


def used(per_graph: DataFrame, chosen: DataFrame) -> DataFrame:
    """``per_graph`` with use_rewrite."""
    c = F.broadcast(chosen.select("eval_id", "n_selected", "least_gain", "last_graph"))
    use = (F.col("n_selected") > 0) & ((F.col("gain") > F.col("least_gain")) | ((F.col("gain") == F.col("least_gain")) & (F.col("graph_id") <= F.col("last_graph"))))
    return per_graph.join(c, "eval_id", "left").withColumn("use_rewrite", F.coalesce(use, F.lit(False))).drop("n_selected", "least_gain", "last_graph")
