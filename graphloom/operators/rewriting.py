"""Packing of occurrences, contraction to carrier graphs with boundary ports, and exact decoding.

Everything is keyed by (eval_id, graph_id): one plan evaluates many dictionaries at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["eval_id", "graph_id"]


def pack(candidates: DataFrame) -> DataFrame:
    """(eval_id, graph_id, cid, rank, mapping): a maximal set of disjoint occurrences for each key.

    ``candidates``: eval_id, graph_id, ext, m_edges, m_size, rank, mapping. Greedy by that order; a graph's
    candidates are folded in one row, so the work is bounded by the graph, not the corpus.
    """
    item = F.struct("ext", "m_edges", "m_size", "rank", "mapping")
    kind = dict(candidates.select(item.alias("x")).dtypes)["x"]
    zero = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))
    fold = lambda a, c: F.when(F.arrays_overlap(a["used"], c["mapping"]), a).otherwise(F.struct(F.concat(a["used"], c["mapping"]).alias("used"), F.concat(a["kept"], F.array(c)).alias("kept")))
    rows = candidates.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("all"))
    kept = rows.select(*KEYS, F.posexplode(F.aggregate("all", zero, fold)["kept"]).alias("at", "c"))
    return kept.select(*KEYS, F.concat(F.lit("m"), F.col("at").cast("string")).alias("cid"), "c.rank", "c.mapping")


def members(packed: DataFrame) -> DataFrame:
    """(eval_id, graph_id, node_id, cid, port, rank)."""
    return packed.select(*KEYS, "cid", "rank", F.posexplode("mapping").alias("port", "node_id"))


def contract(nodes: DataFrame, edges: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Carrier nodes (cid, kind, label) and edges (src, dst, label, src_port, dst_port) of graphs with an occurrence.

    Edges inside an occurrence go; parallel edges stay. A port is null at plain nodes.
    """
    evals = packed.select(*KEYS).distinct()
    inside = members(packed)
    plain = evals.join(nodes, "graph_id").join(inside.select(*KEYS, "node_id"), [*KEYS, "node_id"], "left_anti")
    plain = plain.select(*KEYS, F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("cid"), F.lit("data").alias("kind"), "label")
    carrier = plain.unionByName(packed.select(*KEYS, "cid", F.lit("motif").alias("kind"), F.col("rank").cast("string").alias("label")))
    at = lambda end, c, p: inside.select(*KEYS, F.col("node_id").alias(end), F.col("cid").alias(c), F.col("port").alias(p))
    e = evals.join(edges, "graph_id").join(at("u", "cu", "src_port"), [*KEYS, "u"], "left").join(at("v", "cv", "dst_port"), [*KEYS, "v"], "left")
    e = e.filter("cu is null or cv is null or cu != cv")
    name = lambda c, n: F.coalesce(F.col(c), F.concat(F.lit("n"), F.col(n).cast("string")))
    return carrier, e.select(*KEYS, name("cu", "u").alias("src"), name("cv", "v").alias("dst"), "label", "src_port", "dst_port")


def boundaries(carrier_nodes: DataFrame, carrier_edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(eval_id, graph_id, cid, rank, b, context, signature) of every supernode; also those without a boundary edge.

    Boundary edges are grouped by neighbour and label. The context is each group's neighbour kind and label,
    edge label and size; the signature its ports, the least over the motif's automorphisms, the raw one its
    ports as they are.
    """
    one = carrier_edges.filter("src_port is not null").select(*KEYS, F.col("src").alias("cid"), F.col("src_port").alias("port"), F.col("dst").alias("other"), F.col("label").alias("edge_label"))
    two = carrier_edges.filter("dst_port is not null").select(*KEYS, F.col("dst").alias("cid"), F.col("dst_port").alias("port"), F.col("src").alias("other"), F.col("label").alias("edge_label"))
    near = carrier_nodes.select(*KEYS, F.col("cid").alias("other"), F.col("kind").alias("other_kind"), F.col("label").alias("other_label"))
    sides = one.unionByName(two).join(near, [*KEYS, "other"])
    groups = sides.groupBy(*KEYS, "cid", "other", "other_kind", "other_label", "edge_label").agg(F.array_sort(F.collect_list("port")).alias("ports"))
    item = F.struct("other_kind", "other_label", "edge_label", F.size("ports").alias("n"), "other", "ports")
    groups = groups.groupBy(*KEYS, "cid").agg(F.array_sort(F.collect_list(item)).alias("groups"))
    supers = carrier_nodes.filter("kind = 'motif'").select(*KEYS, "cid", F.col("label").try_cast("int").alias("rank"))
    rows = supers.join(groups, [*KEYS, "cid"], "left").join(F.broadcast(rules.select("rank", "autos")), "rank")
    context = F.transform("groups", lambda g: F.concat_ws("\x1f", g["other_kind"], g["other_label"], g["edge_label"], g["n"].cast("string")))
    moved = F.transform("autos", lambda a: F.transform("groups", lambda g: F.array_sort(F.transform(g["ports"], lambda p: F.get(a, p)))))
    ports = F.coalesce(F.array_min(moved), F.array().cast("array<array<int>>"))
    return rows.select(*KEYS, "cid", "rank", F.size(F.flatten(ports)).alias("b"), F.coalesce(F.concat_ws("\x1e", context), F.lit("")).alias("context"), F.to_json(ports).alias("signature"), F.to_json(F.coalesce(F.col("groups.ports"), F.array().cast("array<array<int>>"))).alias("raw_signature"))


def decode(carrier_nodes: DataFrame, carrier_edges: DataFrame, packed: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the original graphs, from the carrier, the dictionary and the occurrences' nodes. ``rules``: rank, labels, medges."""
    plain = carrier_nodes.filter("kind = 'data'").select(*KEYS, F.substring("cid", 2, 30).cast("long").alias("node_id"), "label")
    known = packed.join(F.broadcast(rules.select("rank", "labels", "medges")), "rank")
    inner = known.select(*KEYS, F.explode(F.arrays_zip(F.col("mapping").alias("node_id"), F.col("labels").alias("label"))).alias("x")).select(*KEYS, "x.node_id", "x.label")
    end = lambda m, i: F.get(m, F.col(i))
    own = known.select(*KEYS, "mapping", F.inline("medges")).select(*KEYS, end("mapping", "a").alias("x"), end("mapping", "b").alias("y"), "label")
    at = lambda c, p, n: members(packed).select(*KEYS, F.col("cid").alias(c), F.col("port").alias(p), F.col("node_id").alias(n))
    e = carrier_edges.join(at("src", "src_port", "hu"), [*KEYS, "src", "src_port"], "left").join(at("dst", "dst_port", "hv"), [*KEYS, "dst", "dst_port"], "left")
    back = lambda h, c: F.coalesce(F.col(h), F.substring(c, 2, 30).cast("long"))
    outer = e.select(*KEYS, back("hu", "src").alias("x"), back("hv", "dst").alias("y"), "label")
    edges = own.unionByName(outer).select(*KEYS, F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "label")
    return plain.unionByName(inner), edges


def decode_fresh(carrier_nodes: DataFrame, carrier_edges: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs equal to the originals but for their ids, from carrier and dictionary alone: a node inside a supernode is named by it and its port. ``rules``: rank, labels, medges."""
    name = lambda c, p: F.when(p.isNull(), c).otherwise(F.concat(c, F.lit(":"), p.cast("string")))
    known = carrier_nodes.filter("kind = 'motif'").select(*KEYS, "cid", F.col("label").try_cast("int").alias("rank")).join(F.broadcast(rules.select("rank", "labels", "medges")), "rank")
    inner = known.select(*KEYS, "cid", F.posexplode("labels").alias("port", "label")).select(*KEYS, name(F.col("cid"), F.col("port")).alias("node_id"), "label")
    own = known.select(*KEYS, "cid", F.inline("medges")).select(*KEYS, name(F.col("cid"), F.col("a")).alias("x"), name(F.col("cid"), F.col("b")).alias("y"), "label")
    outer = carrier_edges.select(*KEYS, name(F.col("src"), F.col("src_port")).alias("x"), name(F.col("dst"), F.col("dst_port")).alias("y"), "label")
    nodes = carrier_nodes.filter("kind = 'data'").select(*KEYS, F.col("cid").alias("node_id"), "label").unionByName(inner)
    return nodes, own.unionByName(outer).select(*KEYS, F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "label")


def mismatches(nodes: DataFrame, edges: DataFrame, got_nodes: DataFrame, got_edges: DataFrame) -> DataFrame:
    """(eval_id, graph_id, problem, n): rows of decoded graphs that differ from the originals; none if decoding is exact."""
    evals = got_nodes.select(*KEYS).distinct()
    want_n, want_e = evals.join(nodes.select("graph_id", "node_id", "label"), "graph_id").select(got_nodes.columns), evals.join(edges.select("graph_id", "u", "v", "label"), "graph_id").select(got_edges.columns)
    return differences(want_n, got_nodes, "node").unionByName(differences(want_e, got_edges, "edge")).groupBy(*KEYS, "problem").agg(F.sum("n").alias("n"))


def differences(want: DataFrame, got: DataFrame, what: str) -> DataFrame:
    """(eval_id, graph_id, problem, n): rows that one side has more often than the other, by one aggregation."""
    both = want.withColumn("_d", F.lit(1)).unionByName(got.withColumn("_d", F.lit(-1))).groupBy(*want.columns).agg(F.sum("_d").alias("_d")).filter("_d != 0")
    return both.select(*KEYS, F.when(F.col("_d") > 0, f"{what} lost").otherwise(f"{what} made up").alias("problem"), F.abs("_d").alias("n"))


def port_histogram(carrier_edges: DataFrame, carrier_nodes: DataFrame) -> DataFrame:
    """(rank, port, n) over both ends of all carrier edges."""
    rank = carrier_nodes.filter("kind = 'motif'").select(*KEYS, "cid", F.col("label").try_cast("int").alias("rank"))
    ends = carrier_edges.select(*KEYS, F.explode(F.array(F.struct(F.col("src").alias("cid"), F.col("src_port").alias("port")), F.struct(F.col("dst").alias("cid"), F.col("dst_port").alias("port")))).alias("x")).select(*KEYS, "x.cid", "x.port").filter("port is not null")
    return ends.join(rank, [*KEYS, "cid"]).groupBy("rank", "port").agg(F.count("*").alias("n"))
