import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import motifs
from graphloom.plans import analysis, registry
from graphloom.plans.compressor import MotifCompressor
from tests.test_compressor import graphs, path, triangles


def test_run(spark, tmp_path):
    nodes, edges = graphs(spark, [triangles(n) for n in (10, 11, 12, 13, 14)])
    a = analysis.run_analysis(nodes, edges, MotifCompressor(n_rules=1), analysis.AnalysisConfig(fit_graphs=3, eval_graphs=2, replicates=20))
    rows = a.motifs.collect()
    assert [r["shape"] for r in rows] == ["triangle"] and rows[0].is_selected and rows[0].support_fraction == 1
    assert {r.metric: r.estimate for r in a.intervals.collect()}["rewrite_fraction"] == 1
    assert a.per_graph.groupBy("split").count().count() == 2
    a.save(str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "summary.json").read_text())["fit_n_rules"] == 1
    audit = {r.split: r for r in analysis.rewrite_audit(a.per_graph, "split").collect()}
    assert audit["fit"].graphs == audit["fit"].rewritten == 3 and audit["eval"].selected_nodes == audit["eval"].available_nodes > 0


def test_splits(spark):
    g = spark.range(100).select(F.col("id").alias("graph_id"), (F.col("id") % 3).alias("label"))
    s = {r.split: r["count"] for r in analysis.split(g, 20, 30, 5).groupBy("split").count().collect()}
    assert s == {"fit": 20, "eval": 30, None: 50}
    h = {r.label: r.n for r in analysis.stratified_holdout(g, 0.2, 1).filter("held_out").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert h == {0: 7, 1: 7, 2: 7}


def test_columns(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, 7, 9)], "key int, gain int, net_gain int")
    assert [tuple(r) for r in analysis.coalesced_columns(rows, {"gain": ("net_gain", "other")}).orderBy("key").collect()] == [(1, 5), (2, 7)]


def test_table_and_costs(spark):
    cand = spark.createDataFrame([("M001", "c", 8, 20, 8, 50.0, 4.0, 2.0, 8.0, 24.0, False)], "motif_id string, code string, graph_support long, occurrences long, contractions long, gross_gain_bits double, boundary_bits double, dictionary_bits double, single_rule_savings_bits double, forced_savings_bits double, is_selected boolean")
    r = analysis.motif_table(cand, 10).first()
    assert (r.support_fraction, r.bits_per_occurrence, r.forced_bits_per_contraction, r.savings_per_supporting_graph) == (0.8, 2.5, 3.0, 1.0)
    costs = analysis.forced_costs(cand)
    assert sum(x.fraction for x in costs.collect()) == pytest.approx(1)
    assert analysis.cost_pivot(costs, ["boundary_bits", "dictionary_bits"]).first().boundary_bits == 4


def test_digest_and_features(spark):
    nodes, edges = graphs(spark, [path(4), triangles(2)])
    occ = motifs.occurrences(nodes, edges, (3,))
    one, two = (analysis.corpus_digest(d).first().digest for d in (occ, occ.repartition(7)))
    assert one == two and one != analysis.corpus_digest(occ.filter("graph_id = 0")).first().digest
    codes = sorted({r.code for r in occ.collect()})
    f = analysis.ladder_features(nodes.groupBy("graph_id").count(), motifs.fingerprint(occ), codes).orderBy("graph_id").collect()
    assert [tuple(r) for r in f] in ([(0, 4, 2, 0), (1, 6, 0, 2)], [(0, 4, 0, 2), (1, 6, 2, 0)])
    assert analysis.graphs_with(occ, codes[0]).count() == 1


def test_ladder_computes_a_code_once(spark):
    nodes, edges = graphs(spark, [path(4), triangles(2)])
    f = motifs.fingerprint(motifs.occurrences(nodes, edges, (3,))).withColumn("code", registry.pattern3(F.col("code")))
    names = sorted(r.code for r in f.select("code").distinct().collect())
    assert len(names) == 2 and names[1].startswith("triangle:")
    rows = analysis.ladder_features(nodes.groupBy("graph_id").count(), f, names)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("array_min") == 1
    assert [tuple(r) for r in rows.orderBy("graph_id").collect()] == [(0, 4, 2, 0), (1, 6, 0, 2)]


def test_ladder_keeps_a_null_graph(spark):
    sizes = spark.createDataFrame([(None, 3), (0, 4)], "graph_id long, nodes long")
    f = spark.createDataFrame([(0, "a", 2), (0, "b", 1)], "graph_id long, code string, n long")
    assert {tuple(r) for r in analysis.ladder_features(sizes, f, ["a", "c"]).collect()} == {(None, 3, 0, 0), (0, 4, 2, 0)}
