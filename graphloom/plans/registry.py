"""Registered queries: each applies operators to a corpus of sources/corpora.py or to plain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import accounting, codelength, stats, summaries
from graphloom.operators import costs, graphs, hashing, motifs, rewriting
from graphloom.operators.motifs import GROUP, UNIT, Rule
from graphloom.plans import analysis, oracle
from graphloom.plans.compressor import MotifCompressor, positive_bits
from graphloom.runtime import scratch_path, store
from graphloom.sources import corpora, files, sinks
from graphloom.sources.corpora import co_purchase, event_chain, event_flow, order_supplier, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def bits(c: Column | str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def pattern3(code: Column) -> Column:
    """A code of size 3 as text: ends and centre of a path, or the labels of a triangle."""
    labels, cells = F.split(F.split(code, GROUP)[0], UNIT), F.split(F.split(code, GROUP)[1], UNIT, -1)
    centre = F.when(cells[2] == "", 0).when(cells[1] == "", 1).when(cells[0] == "", 2)
    ends = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i != centre), lambda i: F.get(labels, i)))
    return F.when(centre.isNull(), F.concat(F.lit("triangle:"), F.array_join(F.array_sort(labels), "-"))).otherwise(F.concat_ws("-", ends[0], F.get(labels, centre), ends[1]))


def topology_only(g: corpora.Graphs) -> corpora.Graphs:
    return g[0].withColumn("label", F.lit("_")), g[1].withColumn("label", F.lit("_"))


def path_packing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, Rule]:
    """The event chains without labels, packed with three-node paths."""
    nodes, edges = topology_only(event_chain(spark, sf_dir))
    occ = motifs.occurrences(nodes, edges, (3,))
    rule = Rule.of(0, f"_{UNIT}_{UNIT}_{GROUP}{UNIT}_{UNIT}_")
    cands = occ.select(F.lit(0).alias("eval_id"), "graph_id", "ext", F.lit(2).alias("m_edges"), F.lit(3).alias("m_size"), F.lit(0).alias("rank"), "mapping")
    return nodes, edges, store(rewriting.pack(cands), "packed"), rule


# graph tables


@query
def graph_complexity(spark, sf_dir):
    return graphs.complexity(*order_supplier(spark, sf_dir))


@query
def degree_histogram(spark, sf_dir):
    return graphs.degrees(*co_purchase(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("n"))


@query
def complexity_caps(spark, sf_dir):
    return graphs.within_caps(graphs.complexity(*order_supplier(spark, sf_dir)), nodes=40, edges=60, max_degree=8, wedges=120)


@query
def size_bins(spark, sf_dir):
    return graphs.size_bins(graphs.complexity(*order_supplier(spark, sf_dir)), 3).select("graph_id", "position", "bin")


@query
def stratified_sample(spark, sf_dir):
    return graphs.stratified_sample(graphs.size_bins(graphs.complexity(*order_supplier(spark, sf_dir)), 3), 50, seed=7).select("graph_id", "bin")


@query
def graph_violations(spark, sf_dir):
    nodes, edges = order_supplier(spark, sf_dir)
    loops = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("graph_id"), F.col("l_suppkey").alias("u"), F.col("l_suppkey").alias("v"), F.lit("_").alias("label"))
    return graphs.violations(nodes, edges.unionByName(loops.join(nodes.select("graph_id").distinct(), "graph_id", "left_semi")))


@query
def label_alphabet(spark, sf_dir):
    return co_purchase(spark, sf_dir)[0].groupBy("label").agg(F.count("*").alias("n"))


@query
def normalize_ids(spark, sf_dir):
    return graphs.normalize(*order_supplier(spark, sf_dir))[1].select("graph_id", "u", "v")


@query
def collapse_parallel(spark, sf_dir):
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("graph_id"), (F.col("l_orderkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"), F.col("l_returnflag").alias("label"))
    return graphs.collapse_parallel(e)


@query
def topology_metrics(spark, sf_dir):
    m = graphs.topology_metrics(*event_flow(spark, sf_dir))
    return m.select("graph_id", "nodes", "edges", bits("density").alias("density"), bits("mean_degree").alias("mean_degree"), bits("std_degree").alias("std_degree"), "max_degree", "triangles", bits("transitivity").alias("transitivity"), bits("clustering").alias("clustering"))


@query
def connected_components(spark, sf_dir):
    nodes, edges = order_supplier(spark, sf_dir)
    return graphs.connected_components(nodes, edges, store).groupBy("graph_id").agg(F.count_distinct("component").alias("components"), F.sum("component").alias("labels"))


@query
def structural_features(spark, sf_dir):
    f = graphs.structural_features(*event_flow(spark, sf_dir))
    return f.select("graph_id", "node_id", "one", bits("log_degree").alias("log_degree"), bits("degree_share").alias("degree_share"), "is_motif", "log_rank")


@query
def message_edges(spark, sf_dir):
    return graphs.message_edges(*event_flow(spark, sf_dir)).groupBy("graph_id").agg(F.count("*").alias("n"), F.sum(F.col("u") * 10 + F.col("v")).alias("key"))


@query
def gcn_layer(spark, sf_dir):
    nodes, edges = event_flow(spark, sf_dir)
    x = graphs.degrees(nodes, edges).withColumn("x", F.col("degree").cast("double"))
    return graphs.gcn_aggregate(graphs.message_edges(nodes, edges), x, "x").select("graph_id", "node_id", bits("x").alias("x"))


@query
def dependency_trees(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))).alias("x"))
    heads = F.transform("x", lambda y, i: F.floor(i / 2).cast("int"))
    s = li.select(F.col("l_orderkey").alias("graph_id"), heads.alias("heads"), F.col("x.l_linestatus").alias("pos"), F.col("x.l_returnflag").alias("dep"))
    return files.dependency_trees(s)[1]


@query
def tu_round_trip(spark, sf_dir):
    """Written as TU text, read again."""
    nodes, edges = order_supplier(spark, sf_dir)
    ids = nodes.select("graph_id").distinct().withColumn("label", (F.col("graph_id") % 2).cast("int"))
    marker = store(ids, "tu-graphs")
    root = scratch_path(spark, "tu")
    sinks.write_tu(root, "C", marker, nodes, edges)
    t = files.load_tu(spark, root, "C")
    n = t["nodes"].groupBy("graph_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "S").alias("suppliers"))
    e = t["edges"].groupBy("graph_id").agg(F.count("*").alias("edges"))
    return n.join(e, "graph_id", "left").join(t["graphs"], "graph_id").select("nodes", "suppliers", F.coalesce("edges", F.lit(0)).alias("edges"), "label")


# motifs


def per_graph_count(sets: DataFrame) -> DataFrame:
    return sets.groupBy("graph_id").agg(F.count("*").alias("n"))


@query
def enum_size2(spark, sf_dir):
    return per_graph_count(motifs.enumerate_sets(*co_purchase(spark, sf_dir), 2))


@query
def enum_size3(spark, sf_dir):
    nodes, edges = co_purchase(spark, sf_dir)
    return per_graph_count(motifs.enumerate_sets(nodes, edges, 3))


@query
def enum_size3_triangles(spark, sf_dir):
    nodes, edges = event_flow(spark, sf_dir)
    occ = motifs.occurrences(nodes, edges, (3,)).filter("n_edges = 3")
    return occ.select("graph_id", *[F.get("nodes", F.lit(i)).alias(c) for i, c in enumerate("abc")], "ext")


@query
def enum_size4(spark, sf_dir):
    sets = motifs.enumerate_sets(*event_flow(spark, sf_dir), 4)
    return sets.select("graph_id", F.array_join("nodes", "-").alias("nodes"))


@query
def enum_size5(spark, sf_dir):
    return per_graph_count(motifs.enumerate_sets(*event_flow(spark, sf_dir), 5))


@query
def enum_whitelist(spark, sf_dir):
    nodes, edges = event_flow(spark, sf_dir)
    allowed = nodes.filter("label != 'view'").select("graph_id", "node_id")
    return per_graph_count(motifs.enumerate_sets(nodes, edges, 3, within=allowed, start=nodes.filter("node_id <= 1").select("graph_id", "node_id")))


@query
def fingerprint_counts(spark, sf_dir):
    f = motifs.fingerprint(motifs.occurrences(*event_chain(spark, sf_dir), (3,)))
    return f.select("graph_id", pattern3(F.col("code")).alias("pattern"), "n")


@query
def nodewise_fingerprint(spark, sf_dir):
    f = motifs.nodewise_fingerprint(motifs.occurrences(*event_flow(spark, sf_dir), (3,)))
    return f.groupBy("graph_id", "node_id").agg(F.sum("n").alias("n"), F.count("*").alias("patterns"))


@query
def motif_support(spark, sf_dir):
    s = motifs.motif_support(motifs.occurrences(*event_chain(spark, sf_dir), (3,)))
    return s.select(pattern3(F.col("code")).alias("pattern"), "graph_support", "occurrences")


@query
def motif_topk(spark, sf_dir):
    s = motifs.motif_support(motifs.occurrences(*event_chain(spark, sf_dir), (3,))).withColumn("code", pattern3(F.col("code")))
    return motifs.top_motifs(s, 20, 2, 2).select(F.col("code").alias("pattern"), "graph_support", "occurrences")


@query
def canonical_classes_k4(spark, sf_dir):
    """Labelled classes of four nodes; types are unlike in a graph, so a class is its types and their edges."""
    occ = motifs.occurrences(*event_flow(spark, sf_dir), (4,))
    labels, cells = F.split(F.split("code", GROUP)[0], UNIT), F.split(F.split("code", GROUP)[1], UNIT, -1)
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    one = [F.when(cells[k] != "", F.concat_ws("-", F.array_sort(F.array(labels[i], labels[j])))) for k, (i, j) in enumerate(pairs)]
    name = F.concat_ws(",", F.array_sort(F.array_compact(F.array(*one))))
    return occ.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("graph_id").alias("graphs")).select(name.alias("pattern"), "n", "graphs")


@query
def seen_unseen_split(spark, sf_dir):
    occ = motifs.occurrences(*event_chain(spark, sf_dir), (3,))
    v = motifs.GraphletVocabulary().fit(occ.filter("graph_id % 10 = 0"))
    return v.unseen_share(occ.filter("graph_id % 10 != 0")).withColumn("share", bits("share"))


@query
def feature_matrix(spark, sf_dir):
    occ = motifs.occurrences(*event_chain(spark, sf_dir), (3,))
    v = motifs.GraphletVocabulary().fit(occ)
    return v.transform(occ).groupBy("graph_id").agg(F.count("*").alias("columns"), F.sum("value").alias("total"), F.max("value").alias("most"))


@query
def external_degree(spark, sf_dir):
    d = motifs.triples(*co_purchase(spark, sf_dir))
    return d.groupBy("graph_id", F.size("inner").alias("edges")).agg(F.count("*").alias("n"), F.sum("ext").alias("ext"))


@query
def motif_shapes(spark, sf_dir):
    """Names of the shapes of the classes met."""
    codes = motifs.occurrences(*topology_only(event_flow(spark, sf_dir)), (2, 3, 4)).groupBy("size", "code", "n_edges").agg(F.count("*").alias("n")).collect()  # one row for each shape
    return spark.createDataFrame([(r.size, r.n_edges, Rule.of(0, r.code).topology(), len(Rule.of(0, r.code).autos), r.n) for r in codes], "size int, n_edges int, shape string, automorphisms int, n long")


# rewriting


@query
def greedy_packing(spark, sf_dir):
    _, _, packed, _ = path_packing(spark, sf_dir)
    return packed.select("graph_id", F.get("mapping", F.lit(2)).alias("centre"))


@query
def carrier_sizes(spark, sf_dir):
    nodes, edges, packed, _ = path_packing(spark, sf_dir)
    cn, ce = rewriting.contract(nodes, edges, packed)
    n = cn.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "motif").alias("motifs"))
    return n.join(ce.groupBy("graph_id").agg(F.count("*").alias("edges")), "graph_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


@query
def boundary_sizes(spark, sf_dir):
    nodes, edges, packed, rule = path_packing(spark, sf_dir)
    cn, ce = rewriting.contract(nodes, edges, packed)
    b = rewriting.boundaries(cn, ce, motifs.rule_table(spark, [rule]))
    return b.groupBy("graph_id", "b").agg(F.count("*").alias("n"))


@query
def decode_mismatch_count(spark, sf_dir):
    nodes, edges, packed, rule = path_packing(spark, sf_dir)
    cn, ce = rewriting.contract(nodes, edges, packed)
    table = spark.createDataFrame([(0, rule.labels, [{"a": a, "b": b, "label": c} for a, b, c in rule.edges])], "rank int, labels array<string>, medges array<struct<a:int,b:int,label:string>>")
    return rewriting.mismatches(nodes, edges, *rewriting.decode(cn, ce, packed, table)).agg(F.count("*").alias("n"))


@query
def port_histogram(spark, sf_dir):
    nodes, edges, packed, _ = path_packing(spark, sf_dir)
    cn, ce = rewriting.contract(nodes, edges, packed)
    return rewriting.port_histogram(ce, cn).agg(F.sum("n").alias("n"))


@query
def size_comparison(spark, sf_dir):
    nodes, edges, packed, _ = path_packing(spark, sf_dir)
    cn, ce = rewriting.contract(nodes, edges, packed)
    raw = graphs.complexity(nodes, edges).select("graph_id", "nodes", "edges")
    token = cn.groupBy("graph_id").agg(F.count("*").alias("token_nodes")).join(ce.groupBy("graph_id").agg(F.count("*").alias("token_edges")), "graph_id", "left")
    j = raw.join(token, "graph_id").withColumn("token_edges", F.coalesce("token_edges", F.lit(0)))
    share = lambda a, b: F.when(F.col(a) > 0, (F.col(a) - F.col(b)) / F.col(a)).otherwise(0.0)
    return j.select("graph_id", "nodes", "token_nodes", "edges", "token_edges", bits(share("nodes", "token_nodes")).alias("node_reduction"), bits(share("edges", "token_edges")).alias("edge_reduction"))


# code lengths


@query
def base_bits(spark, sf_dir):
    nodes, edges = order_supplier(spark, sf_dir)
    return costs.baseline_bits(nodes, edges, 6, 1).select("graph_id", "nodes", "edges", bits("bits").alias("bits"))


@query
def template_bits(spark, sf_dir):
    nodes, edges, packed, _ = path_packing(spark, sf_dir)
    cn, ce = rewriting.contract(nodes, edges, packed)
    t = costs.template_bits(cn, ce, F.lit(1), 1, 1)
    return t.select("graph_id", "carrier_nodes", "carrier_edges", bits("template").alias("template"))


@query
def label_bits(spark, sf_dir):
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.collect_list("n").alias("c"))
    return counts.select("o_custkey", bits(codelength.dirichlet_multinomial_bits(F.col("c"), F.lit(5))).alias("bits"))


@query
def dictionary_bits(spark, sf_dir):
    """Bits of the dictionary of all event-chain classes that two graphs have."""
    occ = motifs.occurrences(*event_chain(spark, sf_dir), (3,))
    top = motifs.motif_support(occ).filter("graph_support >= 2").orderBy("code").collect()  # classes of the few event types
    m = MotifCompressor()
    m.node_alphabet, m.edge_alphabet = 5, 1
    rules = [Rule.of(i, r.code) for i, r in enumerate(top)]
    return spark.createDataFrame([(len(rules), round(positive_bits(len(rules)) + sum(m._rule_bits(spark, rules)), 4))], "n_rules int, bits double")


@query
def integer_codes(spark, sf_dir):
    p = read(spark, sf_dir, "part").filter("p_partkey > 0")
    n = F.col("p_partkey")
    return p.select("p_partkey", codelength.elias_delta_bits(n).cast("long").alias("delta"), codelength.elias_delta_nonnegative_bits(n).cast("long").alias("delta0"), codelength.symbol_width(n).cast("long").alias("width"), codelength.ceil_log2(n).cast("long").alias("ceil_log2"), bits(codelength.positive_integer_bits(n)).alias("analytic"))


@query
def integer_graph_bits(spark, sf_dir):
    sizes = graphs.complexity(*order_supplier(spark, sf_dir)).select("graph_id", "nodes", "edges")
    return accounting.graph_bits(sizes, F.lit(6), F.lit(1))


@query
def multigrain_costs(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderkey").alias("raw"), (F.col("o_orderkey") % 1000).alias("packed"))
    return accounting.split_summary(o, "o_orderstatus", "raw", "packed", 500)


# selectors, on gains made from account balances


def gains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers with orders are the eligible graphs."""
    c = read(spark, sf_dir, "customer")
    ordered = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"))
    per = c.select((F.col("c_nationkey") % 3).alias("eval_id"), F.col("c_custkey").alias("graph_id"), F.round(F.col("c_acctbal") / 100 - 20, 4).alias("gain")).join(ordered, "graph_id", "left_semi").select("eval_id", "graph_id", "gain")
    total = c.groupBy((F.col("c_nationkey") % 3).alias("eval_id")).agg(F.count("*").alias("n_graphs")).withColumn("dictionary", F.lit(12.5) * (F.col("eval_id") + 1))
    return per, total


@query
def selector_curve_sparse(spark, sf_dir):
    c = costs.sparse_curve(*gains(spark, sf_dir), 1.0)
    return c.select("eval_id", "k", bits("gain_sum").alias("gain_sum"), bits("net").alias("net"))


def _selected(spark, sf_dir, selector: str, forced: bool = False) -> DataFrame:
    s = costs.select_graphs(*gains(spark, sf_dir), selector, 1.0, forced)
    return s.select("eval_id", "n_selected", bits("net").alias("net"))


@query
def selector_sparse(spark, sf_dir):
    return _selected(spark, sf_dir, "sparse")


@query
def selector_per_graph(spark, sf_dir):
    return _selected(spark, sf_dir, "per_graph")


@query
def selector_all_eligible(spark, sf_dir):
    return _selected(spark, sf_dir, "all_eligible", True)


@query
def selector_sparse_forced(spark, sf_dir):
    return _selected(spark, sf_dir, "sparse", True)


@query
def selector_per_graph_forced(spark, sf_dir):
    """Gains below zero alone: the best graph is taken nevertheless."""
    per, total = gains(spark, sf_dir)
    s = costs.select_graphs(per.filter("gain < 0"), total, "per_graph", 1.0, True)
    return s.select("eval_id", "n_selected", "last_graph", bits("net").alias("net"))


@query
def candidate_ranking(spark, sf_dir):
    """Classes by support, with ranks and motif names."""
    s = motifs.motif_support(motifs.occurrences(*event_chain(spark, sf_dir), (3,))).withColumn("pattern", pattern3(F.col("code")))
    r = graphs.ordinal(s, [-F.col("graph_support"), -F.col("occurrences"), F.col("pattern")], "at")
    return r.select((F.col("at") + 1).alias("rank"), F.format_string("M%03d", F.col("at") + 1).alias("motif_id"), "pattern", "graph_support", "occurrences")


@query
def cost_decomposition(spark, sf_dir):
    o = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("template"), F.count("*").cast("double").alias("boundary"), F.sum("l_linenumber").cast("double").alias("dictionary"))
    return stats.unpivot(o, ["l_returnflag"], ["template", "boundary", "dictionary"]).withColumn("fraction", bits("fraction"))


@query
def compressor_path(spark, sf_dir):
    """Fitted dictionary prefixes of the event flows."""
    nodes, edges = event_flow(spark, sf_dir)
    return MotifCompressor(n_rules=3, min_rule_savings_bits=float("-inf")).fit(nodes, edges).path_frame(spark)


@query
def frozen_transform(spark, sf_dir):
    """Fitted on even users, applied to odd ones; decoding is verified."""
    nodes, edges = event_flow(spark, sf_dir)
    even = lambda d: d.filter("graph_id % 2 = 0")
    odd = lambda d: d.filter("graph_id % 2 = 1")
    model = MotifCompressor(n_rules=2, min_rule_savings_bits=float("-inf"), dictionary_selection="fixed").fit(even(nodes), even(edges))
    return model.transform(odd(nodes), odd(edges), forced=True).per_graph


# statistics


@query
def confusion_matrix(spark, sf_dir):
    return stats.confusion(_predicted(spark, sf_dir), "actual", "predicted")


def _predicted(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("actual"), F.when(F.col("o_totalprice") > 200_000, "1-URGENT").when(F.col("o_orderkey") % 3 == 0, "3-MEDIUM").otherwise(F.col("o_orderpriority")).alias("predicted"))


@query
def class_metrics(spark, sf_dir):
    m = stats.class_metrics(stats.confusion(_predicted(spark, sf_dir), "actual", "predicted"))
    return m.select("c", *[bits(x).alias(x) for x in ("precision", "recall", "f1")], "support", F.col("predicted").alias("n_predicted"))


@query
def macro_f1(spark, sf_dir):
    return stats.macro_f1(stats.confusion(_predicted(spark, sf_dir), "actual", "predicted")).withColumn("macro_f1", bits("macro_f1"))


@query
def majority_baseline(spark, sf_dir):
    return stats.majority_baseline(_predicted(spark, sf_dir), "actual").withColumn("accuracy", bits("accuracy"))


@query
def class_codes(spark, sf_dir):
    return stats.class_codes(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type")


@query
def run_summary(spark, sf_dir):
    s = stats.run_summary(read(spark, sf_dir, "events"), ["event_type"], "value")
    return s.select("event_type", *[bits(c).alias(c) for c in ("median", "q1", "q3", "iqr", "least", "most")], "n")


@query
def fold_mean_sem(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("fold", F.col("c_custkey") % 5)
    f = stats.fold_means(c, ["c_mktsegment"], "fold", "c_acctbal")
    return f.select("c_mktsegment", bits("mean").alias("mean"), bits("sem").alias("sem"), "folds")


def _both_sides(spark, sf_dir) -> Column:
    """Customers 2p and 2p+1 are a pair; ends that stand alone go."""
    low, high = read(spark, sf_dir, "customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return (F.col("c_custkey") >= low + low % 2) & (F.col("c_custkey") <= high - 1 + high % 2)


@query
def paired_speedup(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("pair", F.floor(F.col("c_custkey") / 2)).filter(_both_sides(spark, sf_dir)).withColumn("seconds", F.col("c_acctbal") + 2000)
    p = stats.paired(c.filter("c_custkey % 2 = 1"), c.filter("c_custkey % 2 = 0"), ["pair"], "seconds")
    return p.agg(bits(F.median("speedup")).alias("median_speedup"), bits(F.median("saved")).alias("median_saved"), F.count_if(F.col("saved") > 0).alias("faster"), F.count("*").alias("n"))


@query
def tradeoff(spark, sf_dir):
    n = read(spark, sf_dir, "part").filter("p_size > 0")
    return n.select("p_partkey", *stats.tradeoff(F.col("p_size").cast("double"), F.lit(25.0), F.lit(45.0))).select("p_partkey", bits("speedup").alias("speedup"), bits("seconds_saved").alias("seconds_saved"), bits(F.when(F.col("break_even") < 1e300, F.col("break_even"))).alias("break_even"))


@query
def pareto_frontier(spark, sf_dir):
    return stats.pareto(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice", "p_partkey").select("p_partkey", "on_frontier")


@query
def sign_test(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 4500).alias("s"), F.count("*").alias("n"))
    return c.select("c_nationkey", "s", "n", bits(stats.sign_test(F.col("s"), F.col("n"))).alias("p"))


@query
def bootstrap_ci(spark, sf_dir):
    v = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).alias("pos"), F.col("s_acctbal").alias("value"))
    b = stats.bootstrap(v, 200, 0.95, 3)
    return b.select(*[F.round(c, 4).alias(c) for c in ("estimate", "lower", "upper")])


@query
def task_manifest(spark, sf_dir):
    return stats.task_manifest(spark, [0, 1, 2, 3], 2, 10)


@query
def manifest_faults(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("task_id")).limit(0)
    got = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("task_id")).filter("task_id between 3 and 9")
    twice = got.filter("task_id = 5")
    return stats.manifest_faults(stats.task_manifest(spark, [0, 1, 2, 3], 2, 10), got.unionByName(twice).unionByName(e))


@query
def gain_histogram(spark, sf_dir):
    h = sinks.histogram(read(spark, sf_dir, "customer"), "c_acctbal")
    return h.select(F.col("bin").cast("long").alias("bin"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


# analysis


@query
def split_graphs(spark, sf_dir):
    g = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"))
    return analysis.split(g, 80, 40, 1)


@query
def stratified_holdout(spark, sf_dir):
    g = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_mktsegment").alias("label"))
    return analysis.stratified_holdout(g, 0.2, 3)


@query
def ladder_features(spark, sf_dir):
    """Sizes, counts of the two commonest chain classes and graph metrics, one row for each graph."""
    nodes, edges = event_chain(spark, sf_dir)
    f = motifs.fingerprint(motifs.occurrences(nodes, edges, (3,))).withColumn("code", pattern3(F.col("code")))
    rows = analysis.ladder_features(graphs.complexity(nodes, edges), f, ["click-click-click", "view-view-view"])
    return rows.withColumnsRenamed({"motif_0": "clicks", "motif_1": "views"})


@query
def alias_columns(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("gain"), F.lit(1.5).alias("net_gain"))
    return analysis.coalesced_columns(c, {"gain": ("net_gain",)})


# hashes, samples, summaries


@query
def hash_classes(spark, sf_dir):
    """Sizes of the classes that the recursive hash makes of three-node sets."""
    sets = hashing.hashed_sets(*event_chain(spark, sf_dir), 3).filter("size = 3")
    return sets.groupBy("hash").agg(F.count_distinct("graph_id").alias("graph_support"), F.count("*").alias("occurrences")).drop("hash")


@query
def enum_exhaustive(spark, sf_dir):
    return per_graph_count(hashing.exhaustive_sets(*event_flow(spark, sf_dir), 3))


@query
def enumeration_totals(spark, sf_dir):
    return summaries.enumeration_totals(motifs.occurrences(*event_chain(spark, sf_dir), (3,)))


@query
def sample_manifest(spark, sf_dir):
    return graphs.sample_manifest(graphs.complexity(*order_supplier(spark, sf_dir)), "orders", 12, 8, 5, 3, nodes=40, edges=60, max_degree=8, wedges=120)


@query
def fresh_decode(spark, sf_dir):
    """Sizes and leaves of the graphs decoded from carriers and dictionary alone."""
    nodes, edges, packed, rule = path_packing(spark, sf_dir)
    cn, ce = rewriting.contract(nodes, edges, packed)
    table = spark.createDataFrame([(0, rule.labels, [{"a": a, "b": b, "label": c} for a, b, c in rule.edges])], "rank int, labels array<string>, medges array<struct<a:int,b:int,label:string>>")
    n, e = rewriting.decode_fresh(cn, ce, table)
    e = e.select("graph_id", F.col("u"), F.col("v"), "label")
    d = graphs.degrees(n.select("graph_id", "node_id"), e)
    return d.groupBy("graph_id").agg(F.count_distinct("node_id").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.count_if(F.col("degree") == 1).alias("leaves"))


@query
def port_counts(spark, sf_dir):
    """Boundary edges at each port of the packed paths."""
    nodes, edges, packed, _ = path_packing(spark, sf_dir)
    cn, ce = rewriting.contract(nodes, edges, packed)
    return rewriting.port_histogram(ce, cn).select("rank", F.col("port").cast("int").alias("port"), "n")


@query
def null_aware_deltas(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "plain").otherwise("token").alias("side"), F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal")).alias("a"), F.col("c_acctbal").alias("b"))
    d = summaries.deltas(c, ["c_nationkey"], "side", "plain", "token", ["a", "b"])
    return d.select("c_nationkey", *[bits(x).alias(x) for x in ("a_before", "a_after", "a_delta", "b_before", "b_after", "b_delta")])


@query
def tradeoff_points(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("x"), (F.lit(100000.0) + (F.col("o_orderkey") % 7) * 10000).alias("y"), (F.col("o_orderkey") % 3).alias("p"), (F.col("o_custkey") % 3).alias("q"))
    t = summaries.tradeoff_points(o, ["o_orderpriority"], "x", "y", "p", "q")
    return t.select("o_orderpriority", *[bits(x).alias(x) for x in ("median_before", "median_after", "ratio_of_medians", "median_speedup", "least_speedup", "most_speedup")], "faster", "slower", "better", "equal", "worse", "n")


@query
def preservation(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_mktsegment", (F.col("c_custkey") % 5).alias("fold"), "c_acctbal", ((F.col("c_acctbal") + 2000) / 1000).alias("speedup"))
    r = summaries.preservation(c, ["c_mktsegment"], "fold", "c_acctbal", "speedup")
    return r.select("c_mktsegment", bits("mean").alias("mean"), bits("sem").alias("sem"), "folds", bits("median_speedup").alias("median_speedup"))


@query
def merged_metrics(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 2).alias("side")).agg(F.count("*").alias("n"), F.max("c_acctbal").alias("best"))
    m = summaries.merge_metrics(c.filter("side = 1").drop("side"), c.filter("side = 0").drop("side"), ["c_nationkey"], ["n", "best"])
    return m.select("c_nationkey", "n", "original_n", bits("n_kept").alias("n_kept"), bits("best_kept").alias("best_kept"))


@query
def top_by_value(spark, sf_dir):
    return summaries.top_by(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 10, "p_partkey")


@query
def accountant_comparison(spark, sf_dir):
    n = read(spark, sf_dir, "part").filter("p_size > 0").select(F.col("p_size").cast("long").alias("n")).distinct()
    return n.select("n", *summaries.accountant_comparison(F.col("n"))).withColumns({c: bits(c) for c in ("analytic", "analytic_topology")})


@query
def broken_rules(spark, sf_dir):
    rules = {"quantity is positive": F.col("l_quantity") > 0, "few lines": F.col("l_linenumber") <= 3, "known flag": F.col("l_returnflag").isin("A", "N")}
    return summaries.validated(read(spark, sf_dir, "lineitem"), rules)


ORACLE_SQL = {k: v for k, v in oracle.SQL.items() if k in QUERIES}
