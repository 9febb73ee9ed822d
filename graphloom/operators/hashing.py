"""Recursive hashes of connected node sets, of any size, and the featurizer over them.

The hash of one node is that of its label; of an edge that of its ends' and its label's hashes, sorted; of a
larger set that of the counted hashes of its connected proper subsets (``full``) or only of those one node
smaller. Hashes are SHA-1 numbers of the printed value, so they agree with any other program that prints the
same. Classes can be coarser than the exact codes of motifs.coded.

A graph is one row of a Python kernel: its sets are held together, so memory is bounded by the graph.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import ship


def sha1_number(value: object) -> int:
    return int(hashlib.sha1(str(value).encode()).hexdigest(), 16)


def connected_sets(adjacent: dict[int, set[int]], size: int) -> list[set[frozenset[int]]]:
    """Connected sets of 1 to ``size`` nodes, by size."""
    out = [{frozenset((n,)) for n in adjacent}]
    while len(out) < size:
        out.append({s | {n} for s in out[-1] for m in s for n in adjacent[m] if n not in s})
    return out


def set_hashes(labels: dict[int, str], edges: dict[tuple[int, int], str], size: int, full: bool = True, digest: Callable[[object], int] = sha1_number) -> dict[frozenset[int], int]:
    """Hash of every connected set of up to ``size`` nodes; ``edges`` has its ends in order."""
    adjacent: dict[int, set[int]] = {n: set() for n in labels}
    for a, b in edges:
        adjacent[a].add(b)
        adjacent[b].add(a)
    done: dict[frozenset[int], int] = {}
    for k, sets in enumerate(connected_sets(adjacent, size), 1):
        for s in sets:
            if k == 1:
                done[s] = digest(labels[min(s)])
            elif k == 2:
                a, b = sorted(s)
                done[s] = digest(tuple(sorted((done[frozenset((a,))], done[frozenset((b,))], digest(edges[a, b])))))
            else:
                inner = Counter(done[part] for j in (range(1, k) if full else (k - 1,)) for x in combinations(sorted(s), j) if (part := frozenset(x)) in done)
                done[s] = digest(tuple(sorted(inner.items())))
    return done


def hashed_sets(nodes: DataFrame, edges: DataFrame, size: int, full: bool = True, digest: Callable[[object], int] = sha1_number) -> DataFrame:
    """(graph_id, size, nodes, hash): every connected set of 1 to ``size`` nodes; the hash in decimal digits, as it has 160 bits. Null labels count as 'None'."""
    if size < 1:
        raise ValueError("size from 1")
    spark = nodes.sparkSession
    ship(spark)
    n = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "label")).alias("n"))
    e = edges.groupBy("graph_id").agg(F.collect_list(F.struct(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "label")).alias("e"))
    schema = "graph_id long, size int, nodes array<long>, hash string"
    arrow = pa.schema([("graph_id", pa.int64()), ("size", pa.int32()), ("nodes", pa.list_(pa.int64())), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, ns, es in zip(*(b.column(c).to_pylist() for c in ("graph_id", "n", "e")), strict=True):
                found = set_hashes({x["node_id"]: x["label"] for x in ns}, {(x["u"], x["v"]): x["label"] for x in es or []}, size, full, digest)
                yield pa.RecordBatch.from_pydict({"graph_id": [g] * len(found), "size": [len(s) for s in found], "nodes": [sorted(s) for s in found], "hash": [str(h) for h in found.values()]}, schema=arrow)

    return n.join(e, "graph_id", "left").mapInArrow(run, schema)


def hash_fingerprint(sets: DataFrame) -> DataFrame:
    """(graph_id, size, hash, n)."""
    return sets.groupBy("graph_id", "size", "hash").agg(F.count("*").alias("n"))


def hash_bit_info(sets: DataFrame) -> DataFrame:
    """The node sets behind each entry of the fingerprint, sorted."""
    return sets.groupBy("graph_id", "size", "hash").agg(F.array_sort(F.collect_list("nodes")).alias("sets"))


def hash_nodewise(sets: DataFrame) -> DataFrame:
    return sets.withColumn("node_id", F.explode("nodes")).groupBy("graph_id", "node_id", "size", "hash").agg(F.count("*").alias("n"))


def exhaustive_sets(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(graph_id, nodes): all subsets of ``size`` nodes that are connected, found by trying every subset. For small graphs, and to hold other ways against."""
    sets = nodes.select("graph_id", F.array("node_id").alias("nodes"))
    for _ in range(size - 1):
        sets = sets.join(nodes.select("graph_id", "node_id"), "graph_id").filter(F.col("node_id") > F.element_at("nodes", -1)).select("graph_id", F.array_append("nodes", F.col("node_id")).alias("nodes"))
    if size == 1:
        return sets
    pairs = edges.groupBy("graph_id").agg(F.collect_list(F.struct("u", "v")).alias("e"))
    near = lambda got, e, n: F.array_contains("nodes", n) & (F.array_contains(got, e["u"]) | F.array_contains(got, e["v"]))
    grow = lambda got: F.array_union(got, F.flatten(F.transform("e", lambda e: F.filter(F.array(e["u"], e["v"]), lambda n: near(got, e, n)))))
    sets = sets.join(pairs, "graph_id").withColumn("got", F.slice("nodes", 1, 1))
    for _ in range(size - 1):
        sets = sets.withColumn("got", grow(F.col("got")))
    return sets.filter(F.size("got") == size).select("graph_id", "nodes")
