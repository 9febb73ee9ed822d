"""Quality rules: a linear-chain CRF labels lines as content or boilerplate, by Viterbi decoding.

The share of words in content lines decides whether a document stays, after two plain rules (few words;
many words in five-word windows that come again). The CRF is trained here, by maximum likelihood with
forward-backward sums, on a bounded sample of labelled documents. Only documents have labels, so those of
the lines are found in turns with the weights: lines are first told apart by themselves, then labelled as
the model would label them, as far as a good document has CONTENT_SHARE of its words in content lines and
a bad one has not. So a document's lines need not agree, and the model learns where labels change.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import per_row, table, texts

MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of words in repeated windows
WINDOW = 5
CONTENT_SHARE = 0.5
SAMPLE_PER_LABEL = 1000  # documents of each label that are learnt from, at most: those with the smallest hashed ids
SAMPLE_LINES = 256  # lines of such a document, at most: neighbours, from a place that its hashed id gives
TURNS = 2  # of labelling lines and fitting weights
SPACES = b" \t\n\r\x0b\f"
SYMBOLS = b"#*$%&|<>"
_NOT_CHAR = bytes(c for c in range(256) if c in SPACES or 128 <= c < 192)
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 192))
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_LINK = re.compile(rb"https?://|www\.|@[a-z]", re.I)
N_FEATURES = 12


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside windows of ``n`` that stand twice or more, the first time included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size, key, have = len(ids), at, 1
    if float(size) ** n < 2**62:
        key = at[:m].copy()
        for j in range(1, n):
            key = key * size + at[j : j + m]
    else:  # rank after each word more, so that keys stay exact
        while have < n:
            _, key = np.unique(key[: len(words) - have] * size + at[have:], return_inverse=True)
            have += 1
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def line_features(line: bytes, words: list[bytes], again: bool) -> tuple[float, ...]:
    n = len(words)
    letters = len(line.translate(None, _NOT_LETTER)) or 1
    distinct = len(set(words))
    end = line.rstrip()[-1:]
    return (
        1.0,
        min(1.0, len(line.translate(None, _NOT_SYMBOL)) / n),
        len(line.translate(None, _NOT_UPPER)) / letters,
        float(b"|" in line),
        min(1.0, line.count(b"!") / n),
        float(end in b".?:;\"')"),
        1 - distinct / n if n >= 6 else 0.0,
        float(n < 4),
        float(again),
        len(line.translate(None, _NOT_DIGIT)) / (letters + 1),
        min(1.0, np.log1p(n) / 6),
        float(bool(_LINK.search(line))),
    )


def lines_of(text: bytes) -> tuple[list[bytes], list[list[bytes]], list[bool]]:
    """Lines with a word, their words, and whether each equals an earlier one."""
    kept, words, again, seen = [], [], [], set()
    for line in text.split(b"\n"):
        if w := line.split():
            kept.append(line)
            words.append(w)
            again.append(line in seen)
            seen.add(line)
    return kept, words, again


class Crf:
    """Two labels, 0 boilerplate and 1 content; ``unary`` is 2 x features, ``pair`` 2 x 2, from the earlier to the later line."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def viterbi(self, x: np.ndarray, content: float = 0.0) -> np.ndarray:
        """Whether each line is content; ``content`` is added to the score of every content line."""
        e, p = (x @ self.unary.T + (0.0, content)).tolist(), self.pair.tolist()
        (a, b), back = e[0], []
        for u, v in e[1:]:
            a0, b0, a1, b1 = a + p[0][0], b + p[1][0], a + p[0][1], b + p[1][1]
            back.append((b0 > a0, b1 >= a1))
            a, b = max(a0, b0) + u, max(a1, b1) + v
        out = np.empty(len(e), bool)
        out[-1] = s = b >= a  # ties are content
        for i in range(len(back) - 1, -1, -1):
            out[i] = s = back[i][s]
        return out


#: Used where no labelled sample has both labels.
UNTRAINED = Crf(np.array([np.zeros(N_FEATURES), [1.0, -4, -2, -2, -2, 1, -6, -1, -1, -1, 1, -1]]), np.array([[1.0, -1.0], [-1.0, 1.0]]))


Document = tuple[np.ndarray, np.ndarray, int]  # features of its lines, their words, its label


def train(documents: list[Document], turns: int = TURNS) -> Crf:
    if len({y for *_, y in documents}) < 2:
        return UNTRAINED
    documents = sorted(documents, key=lambda d: len(d[0]))
    crf = weights([(x, np.full(len(x), y)) for x, _, y in documents], chained=False)
    for _ in range(turns):
        crf = weights([(x, line_labels(crf, x, n, y)) for x, n, y in documents])
    return crf


def line_labels(crf: Crf, x: np.ndarray, n: np.ndarray, label: int, content_share: float = CONTENT_SHARE) -> np.ndarray:
    """The labelling that Viterbi gives if content is made just so likely, or unlikely, in all lines that the document's label holds."""
    holds = lambda z: (n @ z >= content_share * n.sum()) == bool(label)
    best = crf.viterbi(x)
    if holds(best):
        return best.astype(int)
    near, far = 0.0, 1.0
    while not holds(crf.viterbi(x, far if label else -far)):
        far *= 2
    for _ in range(12):
        mid = (near + far) / 2
        near, far = (near, mid) if holds(crf.viterbi(x, mid if label else -mid)) else (mid, far)
    return crf.viterbi(x, far if label else -far).astype(int)


def weights(documents: list[tuple[np.ndarray, np.ndarray]], chained: bool = True, epochs: int = 30, batch: int = 64, rate: float = 0.05, l2: float = 1e-3) -> Crf:
    """Maximum likelihood of labelled lines by Adam; documents, sorted by length, share a batch, padded and masked. Without ``chained`` lines stand alone."""
    batches = []
    for i in range(0, len(documents), batch):
        part = documents[i : i + batch]
        longest = len(part[-1][0])
        x, y = np.zeros((len(part), longest, N_FEATURES)), np.zeros((len(part), longest), int)
        for j, (f, z) in enumerate(part):
            x[j, : len(f)], y[j, : len(f)] = f, z
        batches.append((x, y, np.array([len(f) for f, _ in part])))
    w, p = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    moments = [np.zeros_like(a) for a in (w, p, w, p)]
    step = 0
    for e in range(epochs):
        for i in np.random.default_rng(e).permutation(len(batches)):
            gw, gp = gradient(*batches[i], w, p)
            step += 1
            for a, g, m, v in ((w, gw - l2 * w, *moments[0::2]), (p, (gp - l2 * p) * chained, *moments[1::2])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(w, p)


def gradient(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean log-likelihood per line of the labels ``y``, for the first ``n`` lines of each document."""
    size, longest, _ = x.shape
    live = np.arange(longest) < n[:, None]
    e = x @ w.T
    alpha, beta = np.zeros((size, longest, 2)), np.zeros((size, longest, 2))
    alpha[:, 0] = e[:, 0]
    for t in range(1, longest):
        new = np.logaddexp(alpha[:, t - 1, 0, None] + p[0], alpha[:, t - 1, 1, None] + p[1]) + e[:, t]
        alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        nxt = beta[:, t + 1] + e[:, t + 1]
        new = np.logaddexp(p[:, 0] + nxt[:, 0, None], p[:, 1] + nxt[:, 1, None])
        beta[:, t] = np.where(live[:, t + 1, None], new, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    mean = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * live[..., None]
    gold = np.stack((y == 0, y == 1), -1) & live[..., None]
    gw = np.einsum("bts,btf->sf", gold - mean, x)
    gp = np.zeros((2, 2))
    if longest > 1:
        both = alpha[:, :-1, :, None] + p + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        gp = (gold[:, :-1, :, None] & gold[:, 1:, None, :]).sum((0, 1)) - (np.exp(np.minimum(both, 0)) * live[:, 1:, None, None]).sum((0, 1))
    total = max(1, int(n.sum()))
    return gw / total, gp / total


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, lines: int = SAMPLE_LINES) -> Crf:
    """``docs``: id, text; ``labels``: id, label. Null labels and ids, and texts without words, teach nothing. The driver holds 2 x ``per_label`` x ``lines`` lines at most."""
    order = F.xxhash64(F.lit(29), F.col("id"))
    known = labels.filter(F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("label", (F.col("label") > 0).cast("int")).withColumn("o", order)
    sample = known.filter("label = 0").orderBy("o", "id").limit(per_label).unionByName(known.filter("label = 1").orderBy("o", "id").limit(per_label))

    def run(b: pa.RecordBatch) -> dict:
        out = []
        for t, o in zip(texts(b), b.column("o").to_pylist(), strict=True):
            rows = list(zip(*lines_of(t), strict=True))
            at = o % (len(rows) - lines + 1) if len(rows) > lines else 0
            out.append(np.array([(*line_features(*z), len(z[1])) for z in rows[at : at + lines]], np.float32).tobytes())
        return {"o": b.column("o"), "label": b.column("label"), "x": out}

    rows = per_row(docs.join(F.broadcast(sample), "id").select("o", "label", "text"), run, "o long, label int, x binary").collect()
    data = sorted({(r["o"], r["label"], bytes(r["x"])) for r in rows if r["x"]})
    tables = [(np.frombuffer(x, np.float32).reshape(-1, N_FEATURES + 1).astype(float), y) for _, y, x in data]
    return train([(x[:, :-1], x[:, -1], y) for x, y in tables])


def judge(text: bytes, crf: Crf, content_share: float = CONTENT_SHARE) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share."""
    lines, words, again = lines_of(text)
    flat = [w for ws in words for w in ws]
    n = len(flat)
    repeat = repeated_words(flat)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEATED * n
    share = 0.0
    if n:
        content = crf.viterbi(np.array([line_features(*z) for z in zip(lines, words, again, strict=True)]))
        share = sum(len(w) for w, c in zip(words, content, strict=True) if c) / n
    chars = len(text.translate(None, _NOT_CHAR))  # of each code point one byte
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), sum(again), repeat, failed, not failed and share >= content_share, share


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: tuple[str, ...] = (), only_kept: bool = False) -> DataFrame:
    """id and FIELDS for each row, then the columns of ``keep``; with ``only_kept`` id and ``keep`` of the rows that stay.

    A null text has no words and so fails; null ids and repeated rows are kept as rows. Ids are whole numbers
    (others raise). Without a sample of both labels fixed weights (UNTRAINED) are taken.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    crf = fit(rows.select("id", "text"), labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = dict(rows.dtypes)

    def run(b: pa.RecordBatch) -> dict:
        out = {id_col: b.column("id")} | dict(zip(names, map(list, zip(*(judge(t, crf) for t in texts(b)), strict=True)), strict=True))
        return out | {f"_keep_{i}": b.column(f"_keep_{i}") for i in range(len(keep))}

    schema = ", ".join([f"`{id_col}` long", FIELDS, *[f"`_keep_{i}` {kinds[f'_keep_{i}']}" for i in range(len(keep))]])
    out = per_row(rows, run, schema)
    if only_kept:
        return out.filter("kept").select(id_col, *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
    return out.select(id_col, *names, *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)]) if keep else out


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
