"""Hashes, manifests, decoding with fresh ids, raw boundary bits, ordering over ranges, summaries and clean-up."""

import hashlib
import os
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom import runtime
from graphloom.functions import codelength, stats, summaries
from graphloom.operators import costs, graphs, hashing, motifs, rewriting
from graphloom.operators.motifs import GROUP, UNIT, Rule
from tests.test_compressor import graphs as make
from tests.test_compressor import path


def number(x):
    return int(hashlib.sha1(str(x).encode()).hexdigest(), 16)


def labelled(spark, seed, n=7, kinds="ab"):
    random.seed(seed)
    labels = {i: random.choice(kinds) for i in range(n)}
    es = {(a, b): random.choice("xy") for a, b in combinations(range(n), 2) if random.random() < 0.45}
    nodes = spark.createDataFrame([(1, i, x) for i, x in labels.items()], "graph_id long, node_id long, label string")
    edges = spark.createDataFrame([(1, a, b, x) for (a, b), x in es.items()], "graph_id long, u long, v long, label string")
    return labels, es, nodes, edges


def connected(s, es):
    seen, todo = {s[0]}, [s[0]]
    while todo:
        x = todo.pop()
        new = [y for y in s if y not in seen and (min(x, y), max(x, y)) in es]
        seen |= set(new)
        todo += new
    return len(seen) == len(s)


@pytest.mark.parametrize("full", [True, False])
def test_recursive_hashes(spark, full):
    labels, es, nodes, edges = labelled(spark, 3)
    want = {}

    def of(s):
        if len(s) == 1:
            return number(labels[s[0]])
        if len(s) == 2:
            return number(tuple(sorted((of(s[:1]), of(s[1:]), number(es[s])))))
        sizes = range(1, len(s)) if full else [len(s) - 1]
        return number(tuple(sorted(Counter(of(x) for j in sizes for x in combinations(s, j) if connected(x, es)).items())))

    for k in range(1, 5):
        want |= {s: str(of(s)) for s in combinations(range(7), k) if connected(s, es)}
    got = {tuple(r.nodes): r.hash for r in hashing.hashed_sets(nodes, edges, 4, full).collect()}
    assert got == want
    other = hashing.hashed_sets(nodes, edges, 2, digest=lambda x: len(str(x)))
    assert {r.hash for r in other.filter("size = 1").collect()} == {"1"}
    assert hashing.hash_nodewise(other).agg(F.sum("n")).first()[0] == 7 + 2 * len(es)
    with pytest.raises(ValueError):
        hashing.hashed_sets(nodes, edges, 0)


def test_hashes_of_six_nodes_do_not_depend_on_ids(spark):
    labels, es, nodes, edges = labelled(spark, 9)
    move = dict(zip(range(7), random.sample(range(100), 7), strict=True))
    nodes2 = spark.createDataFrame([(1, move[i], x) for i, x in labels.items()], nodes.schema)
    edges2 = spark.createDataFrame([(1, *sorted((move[a], move[b])), x) for (a, b), x in es.items()], edges.schema)
    one, two = (sorted((r.size, r.hash, r.n) for r in hashing.hash_fingerprint(hashing.hashed_sets(*g, 6)).collect()) for g in ((nodes, edges), (nodes2, edges2)))
    assert one == two and one[-1][0] == 6


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_exhaustive_sets(spark, size):
    _, es, nodes, edges = labelled(spark, 5)
    got = sorted(tuple(r.nodes) for r in hashing.exhaustive_sets(nodes, edges, size).collect())
    assert got == [s for s in combinations(range(7), size) if connected(s, es)]
    assert got == sorted(tuple(r.nodes) for r in motifs.enumerate_sets(nodes, edges, size).collect())


def test_triples_are_the_described_sets(spark):
    for seed in range(4):
        _, _, nodes, edges = labelled(spark, seed, 8, "abc")
        slow = motifs.described(motifs.enumerate_sets(nodes, edges, 3), nodes, edges, 3)
        key = lambda d: sorted((tuple(r.nodes), tuple(r.labels), tuple(map(tuple, r.inner)), r.ext) for r in d.collect())
        assert key(motifs.triples(nodes, edges)) == key(slow)


def test_alike_nodes_give_one_code(spark):
    """A star with equal leaves and a ring with equal labels: every order of alike nodes is the same class, and the mapping is the least."""
    star = make(spark, [[(0, 1), (0, 2), (0, 3), (0, 4)]], "s")
    rows = motifs.occurrences(*star, (4, 5)).collect()
    assert Counter(r.size for r in rows) == {4: 4, 5: 1} and len({r.code for r in rows if r.size == 4}) == 1
    assert len(Rule.of(0, next(r.code for r in rows if r.size == 5)).autos) == 24
    ring = make(spark, [[(i, (i + 1) % 5) for i in range(5)]], "r")
    (one,) = [r for r in motifs.occurrences(*ring, (5,)).collect()]
    assert len(Rule.of(0, one.code).autos) == 10 and one.mapping[0] == 0


def test_sample_manifest(spark):
    sizes = spark.createDataFrame([(i, i % 9 + 1, i % 7, i % 5, i % 11) for i in range(60)], "graph_id long, nodes long, edges long, max_degree long, wedges long")
    rows = graphs.sample_manifest(sizes, "d", 7, 5, seed=3, bins=3, nodes=8, wedges=9).collect()
    assert Counter(r.split for r in rows) == {"fit": 7, "eval": 5}
    assert sorted(r.sample_position for r in rows) == sorted([*range(7), *range(5)])
    assert all(r.nodes <= 8 and r.wedges <= 9 and r.all_graphs == 60 for r in rows) and len({r.eligible_graphs for r in rows}) == 1
    assert Counter(r.size_bin for r in rows) == {0: 4, 1: 4, 2: 4}
    with pytest.raises(ValueError, match="eligible"):
        graphs.sample_manifest(sizes, "d", 50, 50)


def packed_paths(spark, lengths):
    nodes, edges = make(spark, [path(n) for n in lengths])
    rule = Rule.of(0, f"_{UNIT}_{UNIT}_{GROUP}{UNIT}_{UNIT}_")
    occ = motifs.occurrences(nodes, edges, (3,))
    packed = runtime.store(rewriting.pack(occ.select(F.lit(0).alias("eval_id"), "graph_id", "ext", F.lit(2).alias("m_edges"), F.lit(3).alias("m_size"), F.lit(0).alias("rank"), "mapping")))
    return nodes, edges, packed, rule


def test_fresh_decode(spark):
    nodes, edges, packed, rule = packed_paths(spark, [5, 9])
    table = spark.createDataFrame([(0, rule.labels, [{"a": a, "b": b, "label": c} for a, b, c in rule.edges])], "rank int, labels array<string>, medges array<struct<a:int,b:int,label:string>>")
    n, e = rewriting.decode_fresh(*rewriting.contract(nodes, edges, packed), table)
    for g, size in ((0, 5), (1, 9)):
        ids = {r.node_id for r in n.filter(f"graph_id = {g}").collect()}
        es = [(r.u, r.v) for r in e.filter(f"graph_id = {g}").collect()]
        assert len(ids) == size and len(es) == size - 1 and {x for p in es for x in p} == ids
        ends = Counter(x for p in es for x in p)
        assert sorted(ends.values()) == [1, 1, *[2] * (size - 2)]
    back = hashing.hash_fingerprint(hashing.hashed_sets(n.withColumn("node_id", F.xxhash64("node_id")), e.withColumns({"u": F.xxhash64("u"), "v": F.xxhash64("v")}), 4))
    same = hashing.hash_fingerprint(hashing.hashed_sets(nodes, edges, 4))
    assert back.exceptAll(same).isEmpty() and same.exceptAll(back).isEmpty()


def test_raw_boundary_bits(spark):
    nodes, edges, packed, rule = packed_paths(spark, [3, 4, 5])
    cn, ce = rewriting.contract(nodes, edges, packed)
    rules = motifs.rule_table(spark, [rule])
    bounds = rewriting.boundaries(cn, ce, rules)
    raw = {r.graph_id: r.boundary for r in costs.boundary_bits(bounds, rules, raw=True).collect()}
    quotient = {r.graph_id: r.boundary for r in costs.boundary_bits(bounds, rules).collect()}
    import math

    for r in bounds.collect():  # one supernode in each: a code among 3^b, or among the orbits
        assert raw[r.graph_id] == pytest.approx(r.b * math.log2(3)) and quotient[r.graph_id] <= raw[r.graph_id]
    assert {r.b for r in bounds.collect()} >= {0, 1}


@pytest.mark.parametrize("rows_per_range", [7, 10**6])
def test_orders_over_ranges(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(graphs, "ROWS_PER_RANGE", rows_per_range)
    random.seed(1)
    data = [(i, random.choice(["a", "a", "a", None]), 5 if i % 3 else random.randint(0, 9), float(i % 4)) for i in range(100)]
    df = spark.createDataFrame(data, "id long, g string, k int, x double")
    order = sorted(data, key=lambda r: (r[2], r[0]))
    got = {r.id: r.at for r in graphs.ordinal(df, [F.col("k"), F.col("id")], "at").collect()}
    assert got == {r[0]: i for i, r in enumerate(order)}
    run = {r.id: (r.k_, r.s) for r in graphs.running(df.withColumnRenamed("k", "v"), ["g"], [F.col("v"), F.col("id")], {"s": F.col("x")}).withColumnRenamed("k", "k_").collect()}
    for g in ("a", None):
        total = 0.0
        for i, r in enumerate([r for r in order if r[1] == g], 1):
            total += r[3]
            assert run[r[0]] == (i, pytest.approx(total))
    points = spark.createDataFrame([(i, float(random.randint(0, 30)), float(random.randint(0, 30))) for i in range(90)], "key long, s double, q double")
    rows = points.collect()
    front = {r.key for r in stats.pareto(points, "s", "q", "key").filter("on_frontier").collect()}
    assert front == {a.key for a in rows if not any(b.s >= a.s and b.q >= a.q and (b.s > a.s or b.q > a.q) for b in rows)}
    assert {r.g: r.code for r in stats.class_codes(df.filter("g is not null").select("g"), "g").collect()} == {"a": 0}


def test_binomials_in_constant_time(spark):
    from math import comb, log2

    pairs = [(1, 0), (1, 1), (5, 2), (50, 25), (1000, 3), (10**6, 17), (3000, 1500)]
    got = [r[0] for r in spark.createDataFrame(pairs, "n long, k long").coalesce(1).select(codelength.log2_choose_fast(F.col("n"), F.col("k"))).collect()]
    assert got == pytest.approx([log2(comb(n, k)) for n, k in pairs], abs=1e-6)


def test_differences(spark):
    a = spark.createDataFrame([(0, 1, "x"), (0, 1, "x"), (0, 2, None)], "eval_id int, graph_id long, label string")
    b = spark.createDataFrame([(0, 1, "x"), (0, 3, "z"), (0, 2, None)], "eval_id int, graph_id long, label string")
    assert sorted(map(tuple, rewriting.differences(a, b, "node").collect())) == [(0, 1, "node lost", 1), (0, 3, "node made up", 1)]


def test_linear_baselines(spark):
    random.seed(4)
    rows = [(i, random.random(), random.random()) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, float(a + b > 1.2), 3 * a - b) for i, a, b in rows], "id long, a double, b double, y double, z double")
    fit, rest = df.filter("id < 200"), df.filter("id >= 200")
    assert summaries.linear_baseline(fit, rest, ["a", "b"], "y").filter("prediction = y").count() > 92
    off = summaries.linear_baseline(fit, rest, ["a", "b"], "z", "regression").agg(F.corr("prediction", "z")).first()[0]
    assert off > 0.95
    with pytest.raises(ValueError):
        summaries.linear_baseline(fit, rest, ["a"], "y", "other")


def test_stored_tables_go(spark):
    with runtime.passing(spark) as keep:
        first = runtime.store(spark.range(5).toDF("x"), "gone")
        second = runtime.store(first.filter("x > 2"), "stays")
        keep.append(second)
    gone, stays = (f"{runtime.shared_folder(spark).removeprefix('file://')}" for _ in range(2))
    names = os.listdir(gone)
    assert not any(n.startswith("gone-") for n in names) and any(n.startswith("stays-") for n in os.listdir(stays))
    assert second.count() == 2


def test_occurrences_are_cached(spark, tmp_path):
    from graphloom.plans import compressor

    nodes, edges = make(spark, [path(n) for n in (4, 5)])
    model = compressor.MotifCompressor(cache_dir=f"file://{tmp_path}")
    first = sorted(map(str, model._occurrences(nodes, edges).collect()))
    (folder,) = tmp_path.iterdir()
    files = sorted(folder.iterdir())
    assert sorted(map(str, model._occurrences(nodes.repartition(3), edges).collect())) == first and first
    assert [folder] == list(tmp_path.iterdir()) and sorted(folder.iterdir()) == files  # part files would have other names
    assert compressor.corpus_digest(nodes, edges) != compressor.corpus_digest(nodes.filter("graph_id = 0"), edges)
