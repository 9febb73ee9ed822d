"""Removal of bytes that repeat from documents with smaller ids, by threshold-bounded BWT search.

Equal strings of ``least`` bytes have the same least hash of a 16-byte gram (a minimizer). A document
falls into segments, maximal runs of strings with one minimizer; a string that two documents share lies,
in both, in segments of the same minimizer. So:

1. Tasks cut their documents into segments and send each minimizer once; a bucket of minimizers answers
   which of them several documents have.
2. Segments with such a minimizer go, once for each group of documents and distinct segment, to the
   bucket of their minimizer. There a Burrows-Wheeler transform of the distinct segments is searched
   (bwt.py) for the strings they share, and each string gets the least id of its documents. The segments of
   a hot minimizer, one with more than HOT segments, go as single strings, each to the bucket of its own
   hash, so that no task has all the surroundings of a frequent passage.
3. The answers return to the groups of documents, where bytes covered by a string with a smaller id go.

What crosses the network is packed: one row holds many records, in byte planes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bwt import least_owner
from graphloom.llm.common import bound_batches, mix64, table, texts, to_arrow

LEAST = 50
GRAM = 16
LEVEL = 3  # of compression of what crosses the network
GROUP_BYTES = 8 << 20  # text in a group of documents, about
FLUSH_BYTES = 16 << 20  # text that a task cuts at once, about
CHUNK_BYTES = 1 << 20  # text that is hashed at once, about
BLOCK_BYTES = 1 << 17  # text in one transform, about; a minimizer's segments stay together
HOT = 20_000  # segments of one minimizer
MINIMIZER = np.uint64((1 << 48) - 1)  # bits of a minimizer that travel; equal strings agree in them, others seldom
NO_ID = np.iinfo(np.int64).max  # a null id: larger than all others
BLOB = "kind int, bucket int, data binary"


def packed(*columns: np.ndarray, raw: bytes = b"") -> bytes:
    """Arrays of one length, as byte planes, and bytes, compressed. The first column comes as differences: it is sorted or nearly so."""
    n = len(columns[0])
    columns = (np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:])
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([np.array([n], np.int64).tobytes(), *planes, raw]))


def unpacked(data: bytes, *types: type) -> tuple:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for t in types:
        w = np.dtype(t).itemsize
        out.append(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T.copy().view(t).ravel())
        at += n * w
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return (*out, data[at:])


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """As pmod(xxhash64(id), groups) in SQL; the constants are those of the public XXH64 for one 8-byte value and seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = (p5 + np.uint64(42 + 8)) ^ _rotl(ids.view(np.uint64) * p2, 31) * p1
    h = _rotl(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return np.mod((h ^ h >> np.uint64(32)).view(np.int64), groups)


def segments(docs: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, strings, minimizer) of every segment."""
    size = np.array([len(d) for d in docs])
    text = b"".join(docs) + bytes(16)
    n = len(text) - 16
    if n < least:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    word = np.ndarray(n + 8, "<u8", text, strides=(1,))
    h = mix64(word[:n] * np.uint64(0x9E3779B97F4A7C15) + mix64(word[GRAM - 8 : n + GRAM - 8]))
    del word
    w, have = least - GRAM + 1, 1
    m = h
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if w > have:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    end = np.cumsum(size)
    # strings that end in their document
    runs = size >= least
    starts, counts = (end - size)[runs], (size - least + 1)[runs]
    doc = np.repeat(np.flatnonzero(runs), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts - starts, counts)
    v = m[at]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], at[first] - (end - size)[doc[first]], np.diff(np.append(first, len(v))), v[first] & MINIMIZER


def chunked(docs: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``segments`` of many documents, some CHUNK_BYTES at a time: it holds a dozen words for each byte."""
    parts, at, size = [], 0, 0
    for i, d in enumerate(docs):
        size += len(d)
        if size >= CHUNK_BYTES or i == len(docs) - 1:
            doc, *rest = segments(docs[at : i + 1], least)
            parts.append((doc + at, *rest))
            at, size = i + 1, 0
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets <= 4 * len(bucket) else None
    if edge is not None:
        for b in np.flatnonzero(np.diff(edge)):
            yield int(b), order[edge[b] : edge[b + 1]]
        return
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for s, e in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(bucket[order[s]]), order[s:e]


def tidy() -> None:
    """Gives freed memory back to the system; workers live on after a stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def _cut(least: int, buckets: int, groups: int, arrow: pa.Schema):
    """Stage 1. kind 0: minimizers for their bucket, with id, start and strings of the segment, and, if several
    of the task's documents have it, in how many segments, else 0; kind 1: segments that the task itself knows to be shared, for their group."""

    def flush(ids: list, held: list[bytes], turn: int) -> Iterator[pa.RecordBatch]:
        doc, start, strings, v = chunked(held, least)
        if not len(v):
            return
        ids = np.array(ids, np.int64)[doc]
        order = np.argsort(v)
        ids, start, strings, v = ids[order], start[order].astype(np.uint32), strings[order].astype(np.uint32), v[order]
        new = np.concatenate(([True], v[1:] != v[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(v)) - 1
        many = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        # a minimizer that one document has in several segments is sent with each of them
        shared = np.repeat(many, last - first + 1)
        send = np.where(shared, new, True)
        many_segments = np.where(shared, np.repeat(last - first + 1, last - first + 1), 0).astype(np.uint32)
        kind, bucket, data = [], [], []
        at = np.flatnonzero(send)
        for b, rows in by_bucket((v[at] % np.uint64(buckets)).astype(np.int64), buckets):
            r = at[rows]
            kind.append(0)
            bucket.append(b)
            data.append(packed(v[r], ids[r], start[r], strings[r], many_segments[r]))
        at = np.flatnonzero(shared)
        if len(at):
            for g, rows in by_bucket(group_of(ids[at], groups), groups):
                r = at[rows]
                kind.append(g + 1)
                bucket.append((turn + g) % buckets)
                data.append(packed(v[r], ids[r], start[r], strings[r]))
        yield pa.RecordBatch.from_pydict({"kind": kind, "bucket": bucket, "data": data}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size, turn = [], [], 0, 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), texts(b), strict=True):
                if len(t) >= least:
                    ids.append(i)
                    held.append(t)
                    size += len(t)
                if size >= FLUSH_BYTES:
                    yield from flush(ids, held, turn)
                    ids, held, size, turn = [], [], 0, turn + 1
        if held:
            yield from flush(ids, held, turn)
        del ids, held
        tidy()

    return run


def _shared(groups: int, hot: int, arrow: pa.Schema):
    """Stage 1, a bucket of minimizers. kind 0: segments whose minimizer several documents have, for their groups; those of kind 1 pass. kind 1: hot minimizers, for all groups."""

    def run(t: pa.Table) -> pa.Table:
        kind, group, data, found = [], [], [], []
        for k, d in zip(t["kind"].to_pylist(), t["data"].to_pylist(), strict=True):
            if k:
                kind.append(0)
                group.append(k - 1)
                data.append(d)
            else:
                found.append(unpacked(d, np.uint64, np.int64, np.uint32, np.uint32, np.uint32)[:5])
        if found:
            v, ids, start, strings, flag = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(v)
            v, ids, start, strings, flag = v[order], ids[order], start[order], strings[order], flag[order]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            last = np.append(first[1:], len(v)) - 1
            several = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) | (np.maximum.reduceat(flag, first) > 0)
            at = np.flatnonzero(np.repeat(several, last - first + 1) & (flag == 0))  # flagged ones went by kind 1
            for g, rows in by_bucket(group_of(ids[at], groups), groups):
                r = at[rows]
                kind.append(0)
                group.append(g)
                data.append(packed(v[r], ids[r], start[r], strings[r]))
            frequent = v[first][several & (np.add.reduceat(np.maximum(flag.astype(np.int64), 1), first) > hot)]
            if len(frequent):
                kind += [1] * groups
                group += range(groups)
                data += [frequent.tobytes()] * groups
        tidy()
        return pa.table({"kind": kind, "grp": group, "data": data}, schema=arrow)

    return run


def distinct_texts(docs: pa.Table) -> dict[int, list[bytes]]:
    """id to its distinct texts, sorted: one, unless ids repeat."""
    out: dict[int, set[bytes]] = {}
    for i, t in zip(docs["id"].to_pylist(), texts(docs.combine_chunks().to_batches()[0]), strict=True):
        out.setdefault(i, set()).add(t)
    return {i: sorted(ts) for i, ts in out.items()}


def single_strings(t: bytes, start: int, strings: int, least: int) -> Iterator[tuple[tuple[int, bytes], int]]:
    """Each string of a segment under a hash of its own, and where it starts."""
    for at in range(start, start + strings):
        x = t[at : at + least]
        yield (xxhash.xxh3_64_intdigest(x) & int(MINIMIZER), x), at


def _send(least: int, buckets: int, arrow: pa.Schema):
    """Stage 2, a group of documents: each distinct segment once, with its least id, for its minimizer's bucket; where they stand, for stage 3."""

    def run(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        group = key[0].as_py()
        kind, bucket, data = [], [], []
        told = list(zip(shared["kind"].to_pylist(), shared["data"].to_pylist(), strict=True))
        hot = {w for k, d in told if k for w in np.frombuffer(d, np.uint64).tolist()}
        packets = [d for k, d in told if not k]
        if docs.num_rows and packets:
            text = distinct_texts(docs)
            cut = {(i, n): set(zip(*(x.tolist() for x in segments([t], least)[1:]), strict=True)) for i, ts in text.items() if len(ts) > 1 for n, t in enumerate(ts)}
            v, ids, start, strings = (np.concatenate(c) for c in zip(*(unpacked(d, np.uint64, np.int64, np.uint32, np.uint32)[:4] for d in packets), strict=True))
            order = np.lexsort((start, ids, v))
            seen: dict[tuple[int, bytes], int] = {}
            low: list[int] = []
            where: list[tuple[int, int, int, int]] = []
            for w, i, s, n in zip(v[order].tolist(), ids[order].tolist(), start[order].tolist(), strings[order].tolist(), strict=True):
                for nth, t in enumerate(text[i]):
                    if len(text[i]) == 1 or (s, n, w) in cut[i, nth]:  # of texts with one id, those that have the segment
                        for key, at in single_strings(t, s, n, least) if w in hot else [((w, t[s : s + n + least - 1]), s)]:
                            k = seen.setdefault(key, len(seen))
                            if k == len(low):
                                low.append(i)
                            where.append((k, i, at, nth))
            if where:
                number, ids, start, nths = (np.array(c) for c in zip(*where, strict=True))
                kind.append(1)
                bucket.append(group % buckets)
                data.append(np.array([group], np.int64).tobytes() + packed(number.astype(np.uint32), ids.astype(np.int64), start.astype(np.uint32), nths.astype(np.uint32)))
                keys = list(seen)
                w = np.array([k[0] for k in keys], np.uint64)
                low = np.array(low, np.int64)
                for b, r in by_bucket((w % np.uint64(buckets)).astype(np.int64), buckets):
                    kind.append(0)
                    bucket.append(b)
                    own = [keys[i][1] for i in r]
                    data.append(packed(w[r], low[r], r.astype(np.uint32), np.array([len(x) for x in own], np.uint32), np.full(len(r), group, np.uint32), raw=b"".join(own)))
        tidy()
        return pa.table({"kind": kind, "bucket": bucket, "data": data}, schema=arrow)

    return run


def _search(least: int, arrow: pa.Schema):
    """Stage 2, a bucket of minimizers: the least id of every string of every segment, as runs, for the groups that sent it."""

    def run(t: pa.Table) -> pa.Table:
        kinds, groups, out, found = [], [], [], []
        for k, d in zip(t["kind"].to_pylist(), t["data"].to_pylist(), strict=True):
            if k:
                kinds.append(1)
                groups.append(int(np.frombuffer(d, np.int64, 1)[0]))
                out.append(d[8:])
            else:
                found.append(unpacked(d, np.uint64, np.int64, np.uint32, np.uint32, np.uint32))
        if found:
            v, ids, number, size, group = (np.concatenate([f[i] for f in found]) for i in range(5))
            raw = b"".join(f[5] for f in found)
            end = np.cumsum(size.astype(np.int64))
            own: dict[tuple[int, bytes], int] = {}
            which = np.array([own.setdefault((a, raw[e - n : e]), len(own)) for a, e, n in zip(v.tolist(), end.tolist(), size.tolist(), strict=True)])
            low = np.full(len(own), NO_ID)
            np.minimum.at(low, which, ids)
            keys = list(own)
            owners: dict[int, list[int]] = {}
            for k, (a, _) in enumerate(keys):
                owners.setdefault(a, []).append(k)
            count = np.array([len(x) for _, x in keys]) - least + 1
            at = np.cumsum(count) - count
            least_ids = np.empty(count.sum(), np.int64)  # of every string of every distinct segment
            block: list[int] = []
            held = 0
            for own_keys in [*owners.values(), None]:
                if block and (own_keys is None or held >= BLOCK_BYTES):
                    found_ids = least_owner([keys[k][1] for k in block], low[block], least)
                    n = count[block]
                    least_ids[np.arange(len(found_ids)) + np.repeat(at[block] - np.cumsum(n) + n, n)] = found_ids
                    block, held = [], 0
                if own_keys:
                    block += own_keys
                    held += sum(len(keys[k][1]) for k in own_keys)
            new = np.ones(len(least_ids), bool)  # where runs of one id begin, in a segment
            new[1:] = least_ids[1:] != least_ids[:-1]
            new[at] = True
            cut = np.flatnonzero(new)
            stop, begin = np.append(cut[1:], len(least_ids)), np.searchsorted(cut, at)
            runs = np.append(begin[1:], len(cut)) - begin
            for g, r in by_bucket(group.astype(np.int64), int(group.max()) + 1):
                k = which[r]
                n = runs[k]
                row = np.arange(n.sum()) + np.repeat(begin[k] - np.cumsum(n) + n, n)
                base = np.repeat(at[k], n)
                kinds.append(0)
                groups.append(g)
                out.append(packed(np.repeat(number[r], n), (cut[row] - base).astype(np.uint32), (stop[row] - base).astype(np.uint32), least_ids[cut[row]]))
        tidy()
        return pa.table({"kind": kinds, "grp": groups, "data": out}, schema=arrow)

    return run


def spans_of(answers: list[tuple[int, bytes]], least: int) -> dict[tuple[int, int], np.ndarray]:
    """(id, number of its text) to (starts, ends) of covered bytes, maximal and sorted. kind 1: where segments stand; kind 0: least ids by runs of strings."""
    where = [unpacked(d, np.uint32, np.int64, np.uint32, np.uint32)[:4] for k, d in answers if k]
    runs = [unpacked(d, np.uint32, np.uint32, np.uint32, np.int64)[:4] for k, d in answers if not k]
    if not where or not runs:
        return {}
    number, ids, start, nth = (np.concatenate(c) for c in zip(*where, strict=True))
    num, begin, stop, low = (np.concatenate(c) for c in zip(*runs, strict=True))
    order = np.argsort(num, kind="stable")
    num, begin, stop, low = num[order], begin[order].astype(np.int64), stop[order].astype(np.int64), low[order]
    lo, hi = np.searchsorted(num, number), np.searchsorted(num, number, "right")
    n = hi - lo
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
    owner = np.repeat(np.arange(len(number)), n)
    less = low[at] < ids[owner]
    at, owner = at[less], owner[less]
    i, j, s, e = ids[owner], nth[owner], start[owner] + begin[at], start[owner] + stop[at] + least - 1
    order = np.lexsort((s, j, i))
    i, j, s, e = i[order], j[order], s[order], e[order]
    out: dict[tuple[int, int], np.ndarray] = {}
    cut = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])))) if len(i) else np.zeros(0, int)
    for a, b in zip(cut, np.append(cut[1:], len(i)) if len(cut) else cut, strict=True):
        far = np.maximum.accumulate(e[a:b])
        new = np.flatnonzero(np.concatenate(([True], s[a + 1 : b] > far[:-1])))
        out[int(i[a]), int(j[a])] = np.stack((s[a:b][new], far[np.append(new[1:], b - a) - 1]))
    return out


def remove_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), only_text: bool = False, need_text: bool = True, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left), then the columns of ``keep``, for each row; with ``only_text`` id, text, ``keep``. Without ``need_text`` the text is null.

    Bytes in a string of ``least`` bytes that also starts in a document with a smaller id go; overlaps count,
    the input decides. In ``text`` a character stays only if all its bytes stay. Null texts are empty. Rows
    with equal ids remove nothing from each other; a null id is larger than every other, and the same as 2^63-1.
    Ids are whole numbers (others raise). Texts under ``least`` bytes stay whole. ``least`` is GRAM at least.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [f"_keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = buckets = max(8, -(-total // GROUP_BYTES))
    blob, both = to_arrow(spark, BLOB), to_arrow(spark, "kind int, grp int, data binary")
    cut = rows.select("id", "text").mapInArrow(_cut(least, buckets, groups, blob), BLOB)
    shared = cut.groupBy("bucket").applyInArrow(_shared(groups, hot, both), "kind int, grp int, data binary")

    kinds = dict(rows.dtypes)
    grouped = rows.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    # one plan, so that both uses of the grouped texts share an exchange
    sent = grouped.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(_send(least, buckets, blob), BLOB)
    answers = sent.groupBy("bucket").applyInArrow(_search(least, both), "kind int, grp int, data binary")
    schema = ", ".join([f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "_left string", *[f"`{k}` {kinds[k]}" for k in kept]])
    final = to_arrow(spark, schema)

    def apply(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        spans = spans_of(list(zip(told["kind"].to_pylist(), told["data"].to_pylist(), strict=True)), least)
        docs = docs.combine_chunks()
        text = distinct_texts(docs) if docs.num_rows else {}
        out: dict[str, list] = {n: [] for n in final.names}
        if docs.num_rows:
            for i, t in zip(docs["id"].to_pylist(), texts(docs.to_batches()[0]), strict=True):
                s, e = spans.get((i, text[i].index(t)), np.zeros((2, 0), np.int64))
                left = b"".join(t[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(t)], strict=True))
                row = [None if i == NO_ID else i, len(t), len(t) - len(left), len(s), hashlib.sha256(left).hexdigest()]
                for n, x in zip(final.names, row, strict=False):
                    out[n].append(x)
                out["_left"].append("".join(t[a:b].decode("utf-8", "ignore") for a, b in zip([0, *e.tolist()], [*s.tolist(), len(t)], strict=True)) if need_text else None)
        return pa.table({n: docs[n] if n in kept else out[n] for n in final.names}, schema=final)

    result = grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(apply, schema)
    named = [F.col("_left").alias(text_col), *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)]]
    return result.select(id_col, *([] if only_text else ["n_bytes", "n_removed", "n_spans", "kept_sha256"]), *named)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), need_text=False).drop("text")


#: Every string of every text against every other; ids are distinct.
OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc_id, o, h[2 * o + 1:2 * o + 610] AS c FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49, 256)) AS o FROM d)),
g AS (SELECT r, doc_id, o + k AS p, md5_number(c[2 * k + 1:2 * k + 100]) AS s FROM (SELECT r, doc_id, o, c, unnest(range(0, least(256, length(c) // 2 - 49))) AS k FROM c)),
low AS (SELECT s, min(doc_id) AS i FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50, true) AS new FROM g JOIN low USING (s) WHERE low.i < doc_id),
run AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY p) AS k FROM hit) GROUP BY r, k),
part AS (SELECT r, h, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM run JOIN d USING (r)),
kept AS (SELECT r, count(*) AS n, sum(b - a) AS gone, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) || any_value(h)[2 * max(b) + 1:] AS k FROM part GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
