"""Sources, sinks, manifests and the streaming extension on small files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import accounting, stats
from graphloom.operators import graphs, motifs
from graphloom.plans.compressor import MotifCompressor, store
from graphloom.sources import files, sinks
from graphloom.streaming import frozen


def tu(path, name="TINY", legacy=False, labels="6\n6\n8\n6\n7\n", edges="1, 2\n2, 1\n2, 3\n3, 2\n4, 5\n5, 4\n"):
    ends = {"A": ".edges", "graph_indicator": ".graph_idx", "graph_labels": ".graph_labels", "node_labels": ".node_labels"}
    path.mkdir(parents=True, exist_ok=True)
    for role, text in (("A", edges), ("graph_indicator", "1\n1\n1\n2\n2\n"), ("graph_labels", "-1\n1\n"), ("node_labels", labels)):
        if text:
            (path / (f"{name}{ends[role]}" if legacy else f"{name}_{role}.txt")).write_text(text)


def test_tu(spark, tmp_path):
    tu(tmp_path / "TINY" / "raw")
    t = files.load_tu(spark, str(tmp_path), "TINY")
    assert [tuple(r) for r in t["graphs"].orderBy("graph_id").collect()] == [(1, -1), (2, 1)]
    assert [tuple(r) for r in t["nodes"].orderBy("node_id").select("graph_id", "node_id", "label").collect()] == [(1, 0, "6"), (1, 1, "6"), (1, 2, "8"), (2, 3, "6"), (2, 4, "7")]
    assert [tuple(r) for r in t["edges"].orderBy("u").collect()] == [(1, 0, 1, "_"), (1, 1, 2, "_"), (2, 3, 4, "_")]


def test_tu_legacy_names_and_degrees(spark, tmp_path):
    tu(tmp_path / "deep" / "er", legacy=True, labels="", edges="0 1\n1 0\n1 2\n2 1\n3 4\n4 3\n")
    t = files.load_tu(spark, str(tmp_path), "TINY", node_labels="degree")
    assert [r.label for r in t["nodes"].orderBy("node_id").collect()] == ["1", "2", "1", "1", "1"]


def test_numbers_go_through_the_files_of_a_folder(spark, tmp_path):
    (tmp_path / "t").mkdir()
    lines = [f"{i}, {i % 7}" for i in range(500)]
    for k, (a, b) in enumerate([(0, 3), (3, 400), (400, 420), (420, 500)]):
        (tmp_path / "t" / f"part-{k}.txt").write_text("\n".join(lines[a:b]) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = files.numbered(spark, str(tmp_path / "t")).orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.n for r in got] == list(range(500)) and [r.cells for r in got] == [x.split(", ") for x in lines]


@pytest.mark.parametrize("edges", ["1, 1\n", "1, 4\n", "7, 8\n"])
def test_tu_faults(spark, tmp_path, edges):
    tu(tmp_path, edges=edges)
    with pytest.raises(ValueError):
        files.load_tu(spark, str(tmp_path), "TINY")
    with pytest.raises(FileNotFoundError):
        files.load_tu(spark, str(tmp_path / "none"), "TINY")


def test_jsonl(spark, tmp_path):
    good = {"num_nodes": 3, "node_feat": [[6], [6], [8]], "edge_index": [[0, 1, 1, 2, 0, 2], [1, 0, 2, 1, 2, 0]], "edge_attr": [[1], [1], [2], [2], [1], [1]], "y": [0.5]}
    tall = good | {"edge_index": [[0, 1], [1, 0], [1, 2], [2, 1]], "edge_attr": [[1], [1], [2], [2]]}
    bad = good | {"edge_index": [[0, 1, 1], [1, 1, 5]], "edge_attr": [[1], [1], [2]], "num_nodes": 4}
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, (good, tall, bad))))
    t = files.load_jsonl(spark, str(tmp_path / "m.jsonl"))
    faults = {(r.graph_id, r.fault): r.n for r in files.arc_faults(t["graphs"], t["nodes"], t["arcs"]).collect()}
    assert {g for g, _ in faults} == {2}
    assert {f for _, f in faults} >= {"range", "loop", "no reverse", "not twice", "node count"}
    two = files.pick_graphs(t, spark.range(2).withColumnRenamed("id", "graph_id"))
    edges = files.arcs_to_edges(two["arcs"])
    assert edges.groupBy("graph_id").count().orderBy("graph_id").collect()[0]["count"] == 3
    graphs.check(two["nodes"], edges)
    with pytest.raises(ValueError):
        files.pick_graphs(t, spark.range(9).withColumnRenamed("id", "graph_id"))


def test_tables(spark):
    rows = spark.createDataFrame([("C", 1), ("CC", 2), ("C", 3)], "smiles string, row int")
    assert {tuple(r) for r in files.molecule_table(rows).collect()} == {("C", 1, 2), ("CC", 2, 1)}
    with pytest.raises(ValueError):
        files.molecule_table(spark.createDataFrame([(None, 1)], rows.schema))
    assert files.normalized_header(rows.withColumnRenamed("smiles", "SMILES"), limit=1).columns == ["smiles", "row"]
    s = spark.createDataFrame([(0, [1, 1, 1], ["D", "V", "N"], ["det", "ROOT", "obj"])], "graph_id long, heads array<int>, pos array<string>, dep array<string>")
    assert {tuple(r) for r in files.dependency_trees(s)[1].collect()} == {(0, 0, 1, "det"), (0, 1, 2, "obj")}


def test_sinks(spark, tmp_path):
    sinks.write_json(str(tmp_path / "x.json"), {"a": math.nan, "b": math.inf, "c": [-math.inf, 1.5]})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": None, "b": "Infinity", "c": ["-Infinity", 1.5]}
    sinks.write_bundle(str(tmp_path / "b"), {"t": spark.range(3)})
    assert spark.read.parquet(str(tmp_path / "b" / "t")).count() == 3
    xml = sinks.graphml(["a<b", "c"], [(0, 1, "x")])
    assert "a&lt;b" in xml and xml.count("<edge ") == 1
    assert sinks.markdown([{"a": 1, "b": None}], ["a", "b"]).splitlines()[2] == "| 1 |  |"
    assert r"\_" in sinks.latex([{"a_b": 1.0}], ["a_b"])


def test_statistics(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(stats.sign_test(F.lit(5), F.lit(5))) == pytest.approx(0.03125)
    assert one(stats.sign_test(F.lit(0), F.lit(0))) is None
    assert [one(c) for c in stats.tradeoff(F.lit(10.0), F.lit(6.0), F.lit(20.0))] == [pytest.approx(10 / 6), 4, 5]
    assert one(stats.non_inferior(F.lit(-0.02), 0.02))
    v = spark.createDataFrame([(i, 1 + (i + 1) / 10) for i in range(5)], "pos long, value double")
    r = stats.bootstrap(v, 100, stat="median").first()
    assert r.estimate == pytest.approx(1.3) and r.lower <= 1.3 <= r.upper
    flat = stats.bootstrap(v.withColumn("value", F.lit(-0.01)), 50, stat="median", one_sided=True).first()
    assert flat.lower == pytest.approx(-0.01) and flat.upper is None
    assert stats.bootstrap(v.filter("pos > 9"), 10).first().estimate is None
    p = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "predicted int, actual int").select("actual", "predicted")
    m = {(r.actual, r.predicted): r.n for r in stats.confusion(spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "actual int, predicted int"), "actual", "predicted").collect()}
    assert m == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 1} and p.count() == 3
    manifest = stats.task_manifest(spark, [0, 1, 2, 3], 2, 10).collect()
    assert len(manifest) == 8 and sum(r.representation == "original" for r in manifest) == 2 and {r.seed for r in manifest} == {10, 11}


def test_sign_test_of_many_trials(spark):
    exact = lambda s, n: sum(math.comb(n, k) for k in range(s, n + 1)) / 2**n
    few = [(s, n) for n in (1, 2, 20, 21, 45, 300) for s in range(0, n + 1, 1 + n // 25)]
    n = 3_000_000_000
    many = {n // 2: 0.5 + 0.5 * math.sqrt(2 / (math.pi * n)), n // 2 + 30_000: 0.5 * math.erfc(29_999.5 / math.sqrt(n / 2)), 0: 1, n: 0}
    rows = spark.createDataFrame([*few, *((s, n) for s in many), (None, 5)], "s long, n long").repartition(4)
    got = {(r.s, r.n): r.p for r in rows.select("s", "n", stats.sign_test(F.col("s"), F.col("n")).alias("p")).collect()}
    assert got.pop((None, 5)) is None
    for (s, k), p in got.items():
        assert p == (pytest.approx(many[s], rel=1e-7) if k == n else pytest.approx(exact(s, k), rel=1e-11))


def test_accounting(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "label string")
    known = accounting.vocabulary(rows)
    assert accounting.unseen_labels(spark.createDataFrame([("a",), ("z",)], "label string"), known).collect()[0].label == "z"


def test_components_and_metrics(spark):
    nodes = spark.createDataFrame([(0, i, "x") for i in range(6)], "graph_id long, node_id long, label string")
    edges = spark.createDataFrame([(0, 0, 1, "_"), (0, 1, 2, "_"), (0, 0, 2, "_"), (0, 3, 4, "_")], "graph_id long, u long, v long, label string")
    got = {r.node_id: r.component for r in graphs.connected_components(nodes, edges, store).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    m = graphs.topology_metrics(nodes, edges).first()
    assert (m.triangles, m.transitivity, m.clustering, m.max_degree) == (1, 1.0, 0.5, 2)


def test_shapes():
    rule = lambda n, es: motifs.Rule.of(0, motifs.UNIT.join("x" * n) + motifs.GROUP + motifs.UNIT.join("_" if (a, b) in es else "" for a in range(n) for b in range(a + 1, n)))
    assert rule(3, {(0, 1), (0, 2), (1, 2)}).topology() == "triangle"
    assert rule(3, {(0, 1), (1, 2)}).topology() == "path-P3"
    assert rule(4, {(0, 1), (0, 2), (0, 3)}).topology() == "star-S3"
    assert rule(4, {(0, 1), (1, 2), (2, 3), (0, 3)}).topology() == "cycle-C4"
    assert rule(4, {(a, b) for a in range(4) for b in range(a + 1, 4)}).topology() == "clique-K4"
    assert len(rule(3, {(0, 1), (0, 2), (1, 2)}).autos) == 6 and rule(3, {(0, 1), (1, 2)}).orbit_sizes == [1, 2]


def test_stream(spark, tmp_path):
    rows = [(g, "n", i, None, "x") for g in range(4) for i in range(3)] + [(g, "e", a, b, "_") for g in range(4) for a, b in ((0, 1), (1, 2), (0, 2))]
    df = spark.createDataFrame(rows, frozen.GRAPH_ROWS)
    model = MotifCompressor(dictionary_selection="fixed", min_rule_savings_bits=float("-inf")).fit(*frozen.split_rows(df))
    df.write.parquet(str(tmp_path / "in"))
    got = []
    q = frozen.transform_stream(spark.readStream.schema(frozen.GRAPH_ROWS).parquet(str(tmp_path / "in")), model, lambda d, n: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert sorted(r.graph_id for r in got) == [0, 1, 2, 3]
