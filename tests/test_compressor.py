"""Code lengths and dictionaries against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import codelength as C
from graphloom.operators import motifs
from graphloom.plans.compressor import MotifCompressor


def graphs(spark, edge_lists, label="_"):
    nodes = [(g, n, label) for g, es in enumerate(edge_lists) for n in sorted({x for e in es for x in e})]
    edges = [(g, min(e), max(e), "_") for g, es in enumerate(edge_lists) for e in es]
    return spark.createDataFrame(nodes, "graph_id long, node_id long, label string"), spark.createDataFrame(edges, "graph_id long, u long, v long, label string")


def triangles(n):
    return [e for i in range(n) for e in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 2))]


def path(n):
    return [(i, i + 1) for i in range(n - 1)]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_integer_codes(spark):
    ns = [1, 2, 3, 4, 7, 8, 15, 16, 32, 100, 1000, 10000]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n long").select(C.elias_delta_bits(F.col("n"))).collect()]
    assert got == [1, 4, 4, 5, 5, 8, 8, 9, 10, 11, 16, 20]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (0, 1, 3, 7)], "n long").select(C.elias_delta_nonnegative_bits(F.col("n"))).collect()]
    assert got == [1, 4, 5, 8]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 8, 9)], "n long").select(C.symbol_width(F.col("n"))).collect()]
    assert got == [0, 0, 1, 2, 2, 3, 3, 4]
    pairs = [(3, 1), (6, 3), (10, 2), (10, 5), (45, 10), (100, 5), (1000, 10), (7, 0), (7, 7)]
    got = [r[0] for r in spark.createDataFrame(pairs, "n long, k long").coalesce(1).select(C.subset_bits(F.col("n"), F.col("k"))).collect()]
    assert got == [2, 5, 6, 8, 32, 27, 78, 0, 0]


def test_dirichlet_multinomial(spark):
    bits = lambda c, a: one(spark, C.dirichlet_multinomial_bits(F.array(*[F.lit(x) for x in c]), F.lit(a)))
    assert bits([5, 3], 4) == pytest.approx(12.678072, abs=1e-5)
    assert bits([5, 3], 0) == 0
    assert bits([5, 3], 4) < bits([5, 3], 5) < bits([5, 3], 1e300)


@pytest.mark.parametrize(
    ("lists", "selection", "rules", "net"),
    [
        ([triangles(n) for n in (10, 12, 14)], "best", 1, 408.684773),
        ([path(n) for n in (6, 7, 8)], "best", 0, -1.0),
        ([path(n) for n in (6, 7, 8)], "fixed", 1, -1.0),
    ],
)
def test_corpora(spark, lists, selection, rules, net):
    nodes, edges = graphs(spark, lists)
    model = MotifCompressor(dictionary_selection=selection, min_rule_savings_bits=float("-inf") if selection == "fixed" else 0.0).fit(nodes, edges)
    assert len(model.rules) == rules
    result = model.transform(nodes, edges)
    assert result.report.first().net_savings_bits == pytest.approx(net, abs=1e-4)
    assert result.decode_failures().isEmpty() if rules else True


def test_costs_of_paths(spark):
    nodes, edges = graphs(spark, [path(n) for n in (6, 7, 8)])
    model = MotifCompressor(dictionary_selection="fixed", min_rule_savings_bits=float("-inf")).fit(nodes, edges)
    rows = {r.graph_id: r for r in model.transform(nodes, edges, forced=True).per_graph.collect()}
    for g, (base, template, boundary) in enumerate([(22.606284, 17.013454, 1.415037), (26.217719, 29.231525, 1.415037), (29.908760, 40.091836, 1.415037)]):
        assert rows[g].baseline == pytest.approx(base, abs=1e-5)
        assert rows[g].template == pytest.approx(template, abs=1e-5)
        assert rows[g].boundary == pytest.approx(boundary, abs=1e-5)
    assert model._path[1]["forced_savings_bits"] == pytest.approx(-12.291340, abs=1e-4)


def test_codes_do_not_depend_on_ids(spark):
    nodes = spark.createDataFrame([(0, 0, "N"), (0, 1, "C"), (0, 2, "O"), (1, 93, "N"), (1, 41, "C"), (1, 17, "O")], "graph_id long, node_id long, label string")
    edges = spark.createDataFrame([(0, 0, 1, "single"), (0, 1, 2, "double"), (1, 41, 93, "single"), (1, 17, 41, "double")], "graph_id long, u long, v long, label string")
    rows = motifs.occurrences(nodes, edges, (3,)).collect()
    assert len({r.code for r in rows}) == 1
    labels = {(r.graph_id, tuple(r.mapping)) for r in rows}
    assert labels in ({(0, (1, 0, 2)), (1, (41, 93, 17))},) or len(labels) == 2
    other = spark.createDataFrame([(2, 0, "N"), (2, 1, "C"), (2, 2, "O")], "graph_id long, node_id long, label string")
    swapped = spark.createDataFrame([(2, 0, 1, "double"), (2, 1, 2, "single")], "graph_id long, u long, v long, label string")
    assert motifs.occurrences(other, swapped, (3,)).first().code != rows[0].code


def test_sets_of_larger_sizes(spark):
    from itertools import combinations

    es = [(a, b) for a, b in combinations(range(7), 2) if (a * 5 + b * 3) % 4 != 0]
    nodes, edges = graphs(spark, [es])
    have = {frozenset(e) for e in es}
    for k in (2, 3, 4, 5):
        want = set()
        for s in combinations(range(7), k):
            seen, todo = {s[0]}, [s[0]]
            while todo:
                x = todo.pop()
                new = [y for y in s if y not in seen and frozenset((x, y)) in have]
                seen |= set(new)
                todo += new
            if len(seen) == k:
                want.add(s)
        got = [tuple(r.nodes) for r in motifs.enumerate_sets(nodes, edges, k).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_errors(spark):
    nodes, edges = graphs(spark, [path(3)])
    with pytest.raises(RuntimeError):
        MotifCompressor().transform(nodes, edges)
    with pytest.raises(ValueError):
        MotifCompressor(graphlet_sizes=(1,))
    with pytest.raises(ValueError):
        MotifCompressor().fit(nodes, edges.unionByName(spark.createDataFrame([(0, 1, 1, "_")], edges.schema)))


def test_save_and_load(spark, tmp_path):
    nodes, edges = graphs(spark, [triangles(n) for n in (3, 4)])
    model = MotifCompressor(dictionary_selection="fixed", min_rule_savings_bits=float("-inf")).fit(nodes, edges)
    model.save(str(tmp_path / "model"), spark)
    again = MotifCompressor.load(str(tmp_path / "model"), spark)
    assert again.transform(nodes, edges).report.first() == model.transform(nodes, edges).report.first()
