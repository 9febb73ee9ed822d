"""LM scoring of whole documents with the recurrent model of gru.py.

Counts of words come from every training document. Words are held as 64-bit hashes. Of the counted
words, those over a count (at most TABLE_WORDS) go to the executors as a hash table of fixed size; the
others, and words never seen, meet their counts in a shuffled join, so nothing that is broadcast grows
with the corpus. One pass turns every text into codes, which training and scoring read.

Every training document is learnt from once. Hashes of ids deal the documents to shards, as many as the
training tokens ask for; a shard is learnt from in the order of other hashes, from the weights that the
round before left, and the weights of a round's shards are averaged by tokens in fixed groups. So the
weights depend on the documents and not on how they are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WordHash, bound_batches, fold, stored, table, texts, to_arrow
from graphloom.llm.gru import BANDS, BUCKETS, CLASS_WORDS, CLASSES, Gru, Trainer
from graphloom.llm.gru import score as score_texts

TABLE_WORDS = 1_000_000  # words whose counts every executor holds, at most
ROUNDS = 2  # each takes the shards that have its number modulo ROUNDS
SHARD_TOKENS = 1_000_000  # of a shard, about; the number of shards grows with the corpus
WARM_DOCS = 400  # learnt from by one task at first, besides the rounds: a common start for them
WARM_TOKENS = 4096  # of such a document, at most
WARM_EPOCHS = 3
GATHER = 1_500_000  # tokens that a task holds at once, about
END = b""

_hash = WordHash()


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words, then of the end."""
    return _hash.of([*text.lower().split(), END])


class CountTable:
    """64-bit hash to row, open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several for one slot, one wins
            won = self.at[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            slot, left = (slot[~won] + np.uint64(1)) & self.mask, left[~won]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if absent."""
        out = np.full(len(h), -1, np.int32)
        slot, left = h & self.mask, np.arange(len(h))
        while len(left):
            row = self.at[slot]
            hit = (row >= 0) & (self.keys[slot] == h[left])
            out[left[hit]] = row[hit]
            on = (row >= 0) & ~hit
            slot, left = (slot[on] + np.uint64(1)) & self.mask, left[on]
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): hash and count of every distinct token of ``docs``, pre-aggregated in each task."""
    bound_batches(docs.sparkSession)
    arrow = to_arrow(docs.sparkSession, "h long, c long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for t in texts(b):
                held.append(tokens(t))
                n += len(held[-1])
                if n >= 3 * GATHER:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c.astype(np.int64)}, schema=arrow)

    return docs.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Totals, and of the frequent words hash, count and code, by falling count."""

    def __init__(self, counts: DataFrame, table_words: int):
        total, self.distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.total = int(total)
        by = counts.groupBy(F.least(F.col("c"), F.lit(100_000)).alias("c")).agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)
        fit = by[by.n.cumsum() <= table_words]
        self.least = int(fit.c.min()) if len(fit) else 100_001
        frequent = counts.filter(F.col("c") >= self.least).toArrow()
        h, c = frequent["h"].to_numpy().view(np.uint64), frequent["c"].to_numpy()
        order = np.lexsort((h, -c))
        self.h, self.c = h[order], c[order]
        self.floor = np.log10(self.total + 0.5 * (self.distinct + 1)) if self.total else 0.0
        ends = self.h == _hash[END]
        words = np.flatnonzero(~ends)
        self.neural = min(CLASSES, len(words) // CLASS_WORDS)
        head = words[: self.neural * CLASS_WORDS]
        band = np.clip(BANDS - 1 - np.log2(np.maximum(self.c, 1)).astype(int), 0, BANDS - 2)  # the last is for words out of the table
        codes = coded(band, self.h)
        codes[head] = self.model().words + np.arange(len(head))
        codes[ends] = 0
        self.codes = codes.astype(np.uint16)
        # inside a band a word's share is its count + 0.5; the last band has one share of 0.5 for words never seen
        tail = np.setdiff1d(words, head, assume_unique=True)
        sums = np.bincount(band[tail], self.c[tail] + 0.5, BANDS)
        rare = self.total - int(self.c.sum()) + 0.5 * (self.distinct - len(self.h)) + 0.5
        self.band_logs = np.log10(np.append(np.maximum(sums[:-1], 0.5), rare))

    def sent(self) -> tuple:
        return self.h, self.c, self.codes, self.band_logs

    def model(self) -> Gru:
        return Gru(self.neural)


def coded(band: np.ndarray | int, h: np.ndarray) -> np.ndarray:
    """Code of words outside the neural classes."""
    return 1 + band * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)


class Lookup(dict):
    """In a worker: the vocabulary's table, made once. As a dict, it remembers rows of words: 0 and up in the table, -1 - i for word i of ``far``, which is out of it."""

    LIMIT, LONGEST, NEW = 400_000, 64, -(1 << 62)

    def __init__(self, sent: tuple):
        h, c, self.codes, self.band_logs = sent
        self.table = CountTable(h)
        self.logs = np.log10(c + 0.5)
        self.far: list[int] = []
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = row = self.NEW - len(self.fresh)
        self.fresh.append(word)
        return row

    def rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word, negative if it is not in the table, and the hashes of those."""
        if len(self) > self.LIMIT:
            self.clear()
            self.far.clear()
        row = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.fresh), np.uint64, len(self.fresh))
            found = self.table.find(h).astype(np.int64)
            out = found < 0
            found[out] = -1 - len(self.far) - np.arange(out.sum())
            self.far += h[out].tolist()
            new = row <= self.NEW
            row[new] = found[self.NEW - row[new]]
            for w, r in zip(self.fresh, found.tolist(), strict=True):
                if len(w) <= self.LONGEST:
                    self[w] = r
                else:
                    del self[w]
            self.fresh = []
        return row, np.array(self.far, np.uint64)[-1 - row[row < 0]]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: code, whether the table has it, log10(c + 0.5) if so, and log10 of its share inside its band, where that is the table's; and the hashes of the others."""
        row, far = self.rows(words)
        known = row >= 0
        code, logs, inside = np.empty(len(row), np.int64), np.zeros(len(row)), np.full(len(row), -self.band_logs[-1])
        code[~known] = coded(BANDS - 1, far)
        if known.any():
            code[known] = self.codes[row[known]]
            logs[known] = self.logs[row[known]]
            tail = known & (code > 0) & (code <= BANDS * BUCKETS)
            inside[known] = 0
            inside[tail] = logs[tail] - self.band_logs[(code[tail] - 1) // BUCKETS]
        return code.astype(np.uint16), known, logs, inside, far


_lookup: list = [None, None]


def lookup(sent) -> Lookup:
    """Made anew when a worker meets another broadcast."""
    value = sent.value
    if _lookup[0] is not value:
        _lookup[:] = value, Lookup(value)
    return _lookup[1]


ENCODED = "uid long, id long, held boolean, shard long, o long, n_tokens long, n_known long, base double, inside double, x binary, rare array<long>"


def encode(docs: DataFrame, sent) -> DataFrame:
    """``docs``: id, text, held, shard, o. For each row what the table knows, its codes, and the hashes of tokens out of the table."""
    spark = docs.sparkSession
    bound_batches(spark)
    arrow = to_arrow(spark, ENCODED)
    passed = ("id", "held", "shard", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, uid = lookup(sent), TaskContext.get().partitionId() << 36
        for b in batches:
            if not b.num_rows:
                continue
            words: list[bytes] = []
            ends = []
            for t in texts(b):
                words += t.lower().split()
                words.append(END)
                ends.append(len(words))
            ends = np.array(ends)
            size = np.diff(ends, prepend=0)
            starts = ends - size
            x, known, logs, inside, far = found.encode(words)
            far = far.view(np.int64)
            of = lambda v: np.add.reduceat(v, starts)  # noqa: E731 a text has at least its end
            parts = zip(starts.tolist(), ends.tolist(), strict=True)
            far_ends = np.cumsum(of((~known).astype(np.int64)))
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], far_ends)).astype(np.int32)), pa.array(far))
            out = {c: b.column(c) for c in passed} | {
                "uid": np.arange(uid, uid + b.num_rows), "n_tokens": size, "n_known": of(known.astype(np.int64)), "base": of(logs), "inside": of(inside), "x": [x[i:j].tobytes() for i, j in parts], "rare": rare,
            }
            uid += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, ENCODED)


def learnt(batches: Iterator[pa.RecordBatch], start: bytes, neural: int, epochs: int) -> Iterator[tuple[int, int, bytes]]:
    """(shard, tokens, weights) of each shard; rows (shard, x) of one shard follow each other."""
    now, model, trainer, done, n = None, None, None, 0, 0
    held: list[np.ndarray] = []

    def learn() -> None:
        nonlocal held, done, n
        done += sum(trainer.learn(held) for _ in range(epochs)) if held else 0
        held, n = [], 0

    for b in batches:
        for shard, x in zip(b.column("shard").to_pylist(), b.column("x").to_pylist(), strict=True):
            if shard != now:
                if trainer:
                    learn()
                    yield now, done, model.dump()
                now, model, done = shard, Gru(neural).load(start), 0
                trainer = Trainer(model)
            held.append(np.frombuffer(x, np.uint16))
            n += len(held[-1])
            if n >= GATHER:
                learn()
    if trainer:
        learn()
        yield now, done, model.dump()


WEIGHTS = "shard long, tokens long, weights binary"


def trained(rows: DataFrame, neural: int, start: bytes, epochs: int) -> DataFrame:
    """WEIGHTS of each shard of ``rows`` (shard, x), which are sorted in their tasks."""
    begin = rows.sparkSession.sparkContext.broadcast(start)
    arrow = to_arrow(rows.sparkSession, WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, n, w in learnt(batches, begin.value, neural, epochs):
            yield pa.RecordBatch.from_pydict({"shard": [shard], "tokens": [n], "weights": [w]}, schema=arrow)

    return rows.mapInArrow(run, WEIGHTS)


def averaged(weights: DataFrame, start: bytes) -> bytes:
    """By tokens, 64 shards at a time in the order of their numbers, so that no task and not the driver holds those of all. ``start`` if there are none."""
    arrow = to_arrow(weights.sparkSession, WEIGHTS)

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        n = group["tokens"].to_numpy().astype(float)
        total = np.zeros(len(group["weights"][0].as_py()) // 4)
        for w, k in zip(group["weights"], n, strict=True):
            total += np.frombuffer(w.as_py(), np.float32) * (k / n.sum())
        return pa.table({"shard": [group["shard"][0].as_py()], "tokens": [int(n.sum())], "weights": [total.astype(np.float32).tobytes()]}, schema=arrow)

    top = weights.agg(F.max("shard")).first()[0]
    if top is None:
        return start
    while True:
        weights = weights.groupBy(F.shiftright("shard", 6).alias("block")).applyInArrow(mean, WEIGHTS).withColumn("shard", F.shiftright("shard", 6))
        top >>= 6
        if not top:
            return bytes(weights.first()["weights"])


def train(encoded: DataFrame, vocabulary: Vocabulary, shards: int, rounds: int = ROUNDS) -> bytes:
    """Weights, from the rows of ``encoded`` that are not held out."""
    known = encoded.filter(~F.col("held"))
    warm = known.filter(F.col("n_tokens") <= WARM_TOKENS).select("o", "x").orderBy("o", "x").limit(WARM_DOCS).select(F.lit(0).cast("long").alias("shard"), "x")
    weights = averaged(stored(trained(warm, vocabulary.neural, vocabulary.model().dump(), WARM_EPOCHS), "lm-weights"), vocabulary.model().dump())
    for r in range(rounds):
        slot = F.floor(F.col("shard") / rounds).cast("int")
        rows = known.filter(F.col("shard") % rounds == r).select("shard", "o", "x").repartitionById(-(-shards // rounds), slot).sortWithinPartitions("shard", "o", "x").select("shard", "x")
        weights = averaged(stored(trained(rows, vocabulary.neural, weights, 1), "lm-weights"), weights)
    return weights


SCORED = "uid long, id long, held boolean, n_tokens long, n_known long, base double, score double"


def score(encoded: DataFrame, vocabulary: Vocabulary, weights: bytes) -> DataFrame:
    """The columns of SCORED; the score lacks the counts of tokens out of the table."""
    spark = encoded.sparkSession
    arrow, neural = to_arrow(spark, SCORED), vocabulary.neural
    sent = spark.sparkContext.broadcast(weights)
    passed = ("uid", "id", "held", "n_tokens", "n_known", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gru(neural).load(sent.value)
        kept: list[pa.RecordBatch] = []
        n = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(kept).combine_chunks()
            logs = score_texts(model, [np.frombuffer(x, np.uint16) for x in rows["x"].to_pylist()]) / np.log(10)
            columns = [rows[c].combine_chunks() for c in passed] + [pa.array(rows["inside"].to_numpy() + logs)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for b in batches:
            if b.num_rows:
                kept.append(b)
                n += sum(b.column("n_tokens").to_pylist())
                if n >= GATHER:
                    yield flush()
                    kept, n = [], 0
        if kept:
            yield flush()

    return encoded.select(*passed, "inside", "x").mapInArrow(run, SCORED)


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, table_words: int = TABLE_WORDS, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Null texts are empty, that is an end alone. Null ids fall in fold 0 and are learnt from unless that is
    held out; repeated rows count as often as they stand. Ids are whole numbers (others raise). Without
    training documents N and V are 0: the base score is 0 for every token.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("held", fold(F.col("id"), folds) == held_out)
    counts = stored(word_counts(rows.filter(~F.col("held")).select("text")), "lm-counts")
    vocabulary = Vocabulary(counts, table_words)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.sent())
    shards = rounds * max(1, -(-vocabulary.total // (rounds * shard_tokens)))
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64(F.lit(41), F.col("id")), F.lit(shards)), "o": F.xxhash64(F.lit(43), F.col("id"))})
    done = stored(encode(dealt, sent), "lm-encoded")
    scored = score(done, vocabulary, train(done, vocabulary, shards, rounds))
    rare = done.select("uid", F.explode("rare").alias("h")).groupBy("uid", "h").agg(F.count("*").alias("n"))
    c = F.coalesce("c", F.lit(0))
    rest = rare.join(counts.filter(F.col("c") < vocabulary.least), "h", "left").groupBy("uid").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"))
    out = scored.join(rest, "uid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(vocabulary.floor)).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
