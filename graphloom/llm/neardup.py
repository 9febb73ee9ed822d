"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets are one class. Bands of a class's signature give buckets; inside a bucket
every class is a candidate with the bucket's leader (another leader for each band, so a group of
thousands yields few pairs for each member), not with all others. Signatures of candidates are compared
batch by batch, and a pair goes as soon as the posterior chance that its similarity reaches the
threshold falls below MISS. Each class is then verified exactly, on full sets, with its best candidate.
What this links is joined into components.

Links between components may be left. Their classes share a bucket that spans several components. In such a
bucket each class outside the largest component is compared with all classes of other components, in tiles: a
pair goes through the sequential test in the first band that it shares, and what is left is verified on full
sets. So a link is missed only if no band agrees, or by the chosen MISS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WordHash, bound_batches, mix64, per_row, stored, table, texts, to_arrow
from graphloom.llm.components import components
from graphloom.runtime import passing

SIMILAR = 80  # per cent
ROWS, BANDS = 4, 32  # at similarity 0.8 no band agrees with probability 5e-8
HASHES = ROWS * BANDS
BATCH = 16
MISS = 1e-6
TILE = 1024  # classes on a side of what a task compares at once
TILE_BYTES = 4 << 20  # of their sets, about
TASK_ROWS = 4 * TILE
PAIRS_AT_ONCE = 100_000

_hash = WordHash()
_rng = np.random.default_rng(97)
_A = _rng.integers(1, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words than ``k`` the whole sequence; none without words."""
    h = _hash.of(text.lower().split())
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = h[:n].copy()
    for j in range(1, min(k, len(h))):
        out = mix64(out * _K + h[j : j + n])
    return np.unique(mix64(out + np.uint64(min(k, len(h)))))


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES 16-bit minima."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, (s[i : i + 1024, None] * _A + _B).min(0), out=least)
    return (mix64(least) >> np.uint64(48)).astype(np.uint16)


@cache
def least_matches(similar: int, miss: float = MISS) -> np.ndarray:
    """For each batch, the fewest matches so far with which a pair goes on: under a uniform prior, the chance that the similarity reaches the threshold is ``miss`` at least."""
    t, out = similar / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:  # P(Beta(m+1, n-m+1) >= t) is the chance of at most m successes in n+1 tries at t
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def sequential(left: np.ndarray, right: np.ndarray, p: np.ndarray, q: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows p of ``left`` and q of ``right`` survive all batches, and their matches."""
    at, m = np.arange(len(p)), np.zeros(len(p), int)
    for j, least in enumerate(least_matches(similar)):
        part = slice(j * BATCH, (j + 1) * BATCH)
        m += (left[p, part] == right[q, part]).sum(1)
        go = m >= least
        at, m, p, q = at[go], m[go], p[go], q[go]
    return at, m


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """id, th (the text's hash, passed on), n (set size), cid (hash of the set, null if empty), sig."""

    def run(b: pa.RecordBatch) -> dict:
        import xxhash

        sets = [shingles(t, k) for t in texts(b)]
        cid = [np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64) if len(s) else None for s in sets]
        return {"id": b.column("id"), "th": b.column("th"), "n": [len(s) for s in sets], "cid": cid, "sig": [signature(s).tobytes() if len(s) else None for s in sets]}

    return per_row(docs, run, "id long, th long, n long, cid long, sig binary")


def band_keys(sigs: bytes) -> np.ndarray:
    """A row of keys, one for each band, for each signature."""
    return mix64(np.frombuffer(sigs, np.uint64).reshape(-1, BANDS) + mix64(np.arange(1, BANDS + 1, dtype=np.uint64)))


def band_rows(classes: DataFrame) -> DataFrame:
    """(k, cid) for each band."""
    bound_batches(classes.sparkSession)
    arrow = to_arrow(classes.sparkSession, "k long, cid long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(b"".join(b.column("sig").to_pylist()))
                yield pa.RecordBatch.from_pydict({"k": keys.view(np.int64).ravel(), "cid": np.repeat(b.column("cid").to_numpy(), BANDS)}, schema=arrow)

    return classes.mapInArrow(run, "k long, cid long")


def pruned(pairs: DataFrame, sigs: DataFrame, similar: int) -> DataFrame:
    """(a, b, m): the pairs that the sequential test leaves."""
    arrow = to_arrow(pairs.sparkSession, "a long, b long, m int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
                every = np.arange(b.num_rows)
                at, m = sequential(left, right, every, every, similar)
                yield pa.RecordBatch.from_pydict({"a": b.column("a").to_numpy()[at], "b": b.column("b").to_numpy()[at], "m": m.astype(np.int32)}, schema=arrow)

    both = pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, m int")


def verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b): the pairs whose full sets reach the similarity."""
    arrow = to_arrow(pairs.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = []
            for x, y in zip(r.column("xa").to_pylist(), r.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= similar * (len(x) + len(y) - common))
            if any(keep):
                at = np.flatnonzero(keep)
                yield pa.RecordBatch.from_pydict({"a": r.column("a").to_numpy()[at], "b": r.column("b").to_numpy()[at]}, schema=arrow)

    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"cid": "a", "words": "xa"}), "a").join(sets.withColumnsRenamed({"cid": "b", "words": "xb"}), "b")
    return both.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """(cid, words): sets of the classes in ``need`` (cid, id), made again from the texts."""
    rows = docs.join(need, "id").select("cid", "text")

    def run(b: pa.RecordBatch) -> dict:
        import xxhash

        sets = [shingles(t, k) for t in texts(b)]
        same = [np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64) == c for s, c in zip(sets, b.column("cid").to_pylist(), strict=True)]
        return {"cid": b.column("cid"), "words": [s.tobytes() if ok else None for s, ok in zip(sets, same, strict=True)]}

    # an id may stand for several texts: only those of the class count
    return per_row(rows, run, "cid long, words binary").filter("words is not null").dropDuplicates(["cid"])


def tiled(mixed: DataFrame) -> DataFrame:
    """(k, i, j, loose, out, cid, comp): in a tile the loose classes of block i, those outside the bucket's largest component, stand against all of block j; ``out`` marks loose ones on either side.

    A block has about TILE classes and TILE_BYTES of sets at most.
    """
    comps = mixed.groupBy("k", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    blocks = lambda c, w: F.greatest(F.ceil(c / TILE), F.ceil(w * 8 / TILE_BYTES)).cast("int")
    size = comps.groupBy("k").agg(F.max(F.struct("c", "w", "comp")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    size = size.select("k", F.col("top.comp").alias("top"), blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("ni"), blocks(F.col("c"), F.col("w")).alias("nj"))
    rows = mixed.join(size, "k").withColumn("out", F.col("comp") != F.col("top"))
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("cid")), F.col(n)).cast("int")
    loose = rows.filter("out").select("k", own(5, "ni").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("loose"), "out", "cid", "comp")
    every = rows.select("k", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), own(6, "nj").alias("j"), F.lit(False).alias("loose"), "out", "cid", "comp")
    return loose.unionByName(every)


def across(mixed: DataFrame, sigs: DataFrame, sets: Callable[[DataFrame], DataFrame], similar: int) -> DataFrame:
    """(a, b): links between classes of different components, of a tile one for each two components.

    ``mixed``: k, cid, comp, n, the buckets that span several components; ``sets``: from (cid) to (cid, words).
    First signatures alone are compared; then the classes of pairs that are left meet once more, with their sets.
    """
    spark = mixed.sparkSession
    bound_batches(spark)
    tiles = stored(tiled(stored(mixed, "mixed")), "tiles")
    tasks = max(1, tiles.count() // TASK_ROWS)
    tiles = tiles.withColumn("task", F.pmod(F.xxhash64("k", "i", "j"), F.lit(tasks)))
    names = ["task", "k", "i", "j", "loose", "out", "cid", "comp"]
    schema = "task long, k long, i int, j int, loose boolean, out boolean, cid long, comp long"
    left, links = to_arrow(spark, schema), to_arrow(spark, "a long, b long")

    def pairs(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The rows of a task's tiles, and of those the pairs that pass the sequential test."""
        group = group.sort_by([(c, "ascending") for c in ("k", "i", "j", "loose", "cid")])
        key = np.stack([group[c].to_numpy() for c in ("k", "i", "j")])
        cid, comp = group["cid"].to_numpy(), group["comp"].to_numpy()
        loose, out = (group[c].to_numpy().astype(bool) for c in ("loose", "out"))
        raw = b"".join(group["sig"].to_pylist())
        sig, bands = np.frombuffer(raw, np.uint16).reshape(-1, HASHES), band_keys(raw).view(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
        tile = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cid))))
        every = np.bincount(tile, ~loose, len(first)).astype(int)  # rows of a tile that are not on the loose side; they come first
        own = (bands[first] == key[0, first, None]).argmax(1)  # the tile's band
        rows = np.flatnonzero(loose)
        count = every[tile[rows]]
        found = []
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS_AT_ONCE)) + 1):
            n = count[part]
            p = np.repeat(rows[part], n)
            q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[tile[rows[part]]], n)
            go = (comp[p] != comp[q]) & (~out[q] | (cid[p] < cid[q]))  # a pair of loose ones stands twice
            p, q = p[go], q[go]
            if len(p):
                go = (bands[p] == bands[q]).argmax(1) == own[tile[p]]  # the first band that they share
                p, q = p[go], q[go]
            kept, _ = sequential(sig, sig, p, q, similar)
            found.append(np.stack((p[kept], q[kept])))
        p, q = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return group, p, q

    def survivors(group: pa.Table) -> pa.Table:
        group, p, q = pairs(group)
        return group.take(np.unique(np.concatenate((p, q)))).select(names).cast(left)

    def linked(group: pa.Table) -> pa.Table:
        group, p, q = pairs(group)
        cid, comp, words = group["cid"].to_numpy(), group["comp"].to_numpy(), group["words"]
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        a, b = [], []
        for s, e in zip(*(lambda f: (f, np.append(f[1:], len(p))))(np.flatnonzero(np.diff(p, prepend=-1))), strict=True):
            one = np.frombuffer(words[int(p[s])].as_py(), np.uint64)
            met: set[int] = set()
            for other in q[s:e].tolist():
                if comp[other] not in met:  # two components need one link
                    two = np.frombuffer(words[other].as_py(), np.uint64)
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * common >= similar * (len(one) + len(two) - common):
                        met.add(comp[other])
                        a.append(cid[p[s]])
                        b.append(cid[other])
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)}, schema=links)

    near = stored(tiles.join(sigs.select("cid", "sig"), "cid").groupBy("task").applyInArrow(survivors, schema), "survivors")
    full = sets(near.select("cid").distinct())
    return near.join(sigs.select("cid", "sig"), "cid").join(full, "cid").groupBy("task").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept and th (xxhash64 of the text) for each row.

    Null and empty texts have an empty set and are linked with nothing; so are rows with a null id, which
    have no component and are kept. Repeated ids link by their texts alone; repeated rows are all kept or
    none is. Ids are whole numbers (others raise). An empty table gives no rows.
    """
    with passing(docs.sparkSession) as keep:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        signed = stored(signatures(rows.withColumn("th", F.xxhash64("text")), k), "signatures")
        usable = signed.filter(F.col("id").isNotNull() & F.col("cid").isNotNull())
        tops = usable.groupBy("cid").agg(F.min("id").alias("id"))
        buckets = band_rows(usable.select("cid", "sig")).distinct()
        leaders = buckets.groupBy("k").agg(F.min(F.struct(F.xxhash64("cid", "k"), "cid"))["cid"].alias("leader"), F.count("*").alias("n")).filter("n > 1")
        multi = stored(buckets.join(leaders, "k").select("k", "cid", "leader"), "buckets")
        pairs = stored(multi.filter("cid != leader").select(F.least("cid", "leader").alias("a"), F.greatest("cid", "leader").alias("b")).distinct(), "pairs")
        members = multi.select("cid").distinct()
        sigs = stored(usable.select("cid", "sig", "n").join(members, "cid", "left_semi").dropDuplicates(["cid"]), "sigs")
        left = stored(pruned(pairs, sigs, similar), "pruned")
        sided = left.select(F.col("a").alias("cid"), F.col("b").alias("to"), "m").unionByName(left.select(F.col("b").alias("cid"), F.col("a").alias("to"), "m"))
        best = sided.groupBy("cid").agg(F.max(F.struct("m", F.xxhash64("to"), "to"))["to"].alias("to")).select(F.least("cid", "to").alias("a"), F.greatest("cid", "to").alias("b")).distinct()
        first = _link(rows, stored(best, "best"), tops, k, similar)
        labels = components(first)
        comps = multi.select("k", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        several = comps.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("k")
        mixed = comps.join(several, "k", "left_semi").join(sigs.select("cid", "n"), "cid")
        more = stored(across(mixed, sigs, lambda need: full_sets(rows, tops.join(need, "cid", "left_semi"), k), similar), "across")
        if not more.isEmpty():
            labels = components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        keep += [signed, labels]
    byclass = tops.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = byclass.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = byclass.join(least, "comp").select("cid", "component_id")
    out = signed.select("id", "th", "n", "cid").join(named, "cid", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "th")


def drop_near_duplicates(docs: DataFrame, k: int = 5, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are not their group's smallest id; columns and other rows as they were. Rows equal in id and text are one document."""
    gone = near_duplicates(docs, k, similar, id_col, text_col).filter("not kept").select(F.col(id_col).alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    return docs.join(gone, (docs[id_col] == gone["_gone_id"]) & (F.xxhash64(docs[text_col]) == gone["_gone_th"]), "left_anti")


def _link(rows: DataFrame, pairs: DataFrame, tops: DataFrame, k: int, similar: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = stored(full_sets(rows, tops.join(ends, "cid", "left_semi"), k), "sets")
    return stored(verified(pairs, sets, similar), "links")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2).drop("th")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
"""
