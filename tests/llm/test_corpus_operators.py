"""Operators across rows: mixing, WARC, language model, near-duplicates, suffix dedup, components."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bwt, components, gru, lm_score, mixing, neardup, suffix_dedup, warc
from tests.llm.conftest import EDGES


def test_mix(spark, documents, edges, nothing):
    random.seed(1)
    rows = [(i, " ".join("x" for _ in range(random.randint(0, 30))), random.choice("abcdefg")) for i in range(3000)] + [(5000, "one two", None)]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = [*sorted(s for s in sizes if s), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:  # water filling
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not new:
            break
        capped |= new
    taken = Counter()
    for r in got:
        want = 2 * sizes[r.source] if r.source in capped else level * weight[r.source]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - (2 * sizes[s] if s in capped else level * weight[s])) <= 16
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(documents(rows)).collect()), key=repr)
    assert len(mixing.mix(edges).collect()) == len(EDGES)
    assert mixing.mix(nothing).isEmpty()


@pytest.mark.parametrize("weight", [None, "n_words"])
def test_mix_takes_the_smallest_ranks(spark, documents, weight):
    """Expected copies, odds and ranks worked out in plain Python; the nearest number of documents by trying each."""
    random.seed(2)
    rows = [(i, " ".join("x" for _ in range(random.choice([0, 1, 3, 8, 20, 60, 300]))), random.choice("aaaabc")) for i in range(900)] + [(950, "one two", None), (951, None, "a"), (952, "x y z", "c"), (952, "x y z", "c")]
    docs = documents(rows).withColumn("n_words", F.expr("case when doc_id % 7 = 0 then null else doc_id % 5 end"))
    got = sorted((r.source or "~", r.doc_id, r.size, r.target, r.copies, r.taken) for r in mixing.mix(docs, weight_col=weight, share=0.6).collect())
    target = {r[0]: r[3] for r in got}
    want, unequal = [], 0
    for source in target:
        mine = [(i, t or "") for i, t, s in rows if (s or "~") == source]
        sizes = [len(t.split()) for _, t in mine]
        given = [math.sqrt(n) if weight is None else ((0 if i % 7 == 0 else i % 5) if n else 0) for (i, _), n in zip(mine, sizes, strict=True)]
        whole = [int(g * 1000) for g in given]
        m = [w - w % 10 ** max(len(str(w)) - 3, 0) for w in whole]
        lo, hi = 0.0, 1e6
        for _ in range(200):  # the rate at which expected words are the target
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(2, mid * a) * n for a, n in zip(m, sizes, strict=True)) < target[source] else (lo, mid)
        e = [min(2, hi * a) for a in m]
        unequal += len({round(x, 6) for x in e if 0 < x < 2}) > 1
        base = [int(x + 1e-9) for x in e]
        ranked = []
        for k, ((i, t), x, b) in enumerate(zip(mine, e, base, strict=True)):
            if (p := x - b) > 1e-9:
                text = next(u for j, u, s in rows if j == i)
                h = hashlib.md5(f"{mixing.SEED}:{i}:{'' if text is None else hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
                u = (int(h[:13], 16) + 0.5) / 2**52
                ranked.append(((u / (1 - u)) / (p / (1 - p)), h[13:28], k))
        ranked.sort()
        lacks = target[source] - sum(b * n for b, n in zip(base, sizes, strict=True))
        upto = [0, *np.cumsum([sizes[k] for *_, k in ranked])]
        n = min(range(len(upto)), key=lambda k: (abs(upto[k] - lacks), k))
        last = ranked[n - 1][:2] if n else (-1, "")
        for odds, tie, k in ranked:
            base[k] += (odds, tie) <= last
        want += [(source, i, s, target[source], b, b * s) for (i, _), s, b in zip(mine, sizes, base, strict=True)]
    assert unequal and [(g[0], g[1], g[2], g[4], g[5]) for g in got] == [(w[0], w[1], w[2], w[4], w[5]) for w in sorted(want)]


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "x"), (5, "http://b", "x"), (3, None, "x"), (2, "http://c\r\nX: y", "é" * 50_000), (4, "u", None), (6, "u", ""), (None, "n", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        p = (h or "").encode()
        assert got[i].payload_bytes == len(p) and got[i].payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert got[i].payload == (None if got[i].record_type == "revisit" else h or "")
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("response", None), 4: ("revisit", 6), 6: ("response", None), None: ("response", None)}
    one = warc.read_records(index.filter("page_id = 2")).collect()
    assert [r.page_id for r in one] == [2] and one[0].payload == "é" * 50_000
    assert warc.read_records(warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")).isEmpty()
    same = warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/big", least=10)).collect()
    assert all(r.record_type == "response" for r in same)


def test_ranges_are_joined():
    assert [(a, b, len(m)) for a, b, m in warc.coalesced([(0, 10), (12, 5), (100, 5), (106, 50)], gap=5, most=40)] == [(0, 17, 2), (100, 105, 1), (106, 156, 1)]


def test_gru_gradients_and_carried_state():
    m = gru.Gru(2, 3, buckets=2, hidden=4, members=4)
    for n in m.names:
        setattr(m, n, getattr(m, n).astype(float))
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, m.start, k).astype(np.uint16) for k in (5, 3, 1, 7)]
    grads = {}

    class Caught(gru.Trainer):
        def step(self, name, grad, rows=slice(None)):
            grads[name] = np.zeros_like(getattr(self.model, name))
            grads[name][rows] = grad

    count = Caught(m).learn(texts, wide=2, window=100)
    loss = lambda: -gru.score(m, texts, wide=2, window=100).sum()
    for name in m.names:
        a = getattr(m, name)
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in a.shape)
            old = a[at]
            a[at] = old + 1e-3
            up = loss()
            a[at] = old - 1e-3
            down = loss()
            a[at] = old
            assert (up - down) / 2e-3 == pytest.approx(grads[name][at] * np.sqrt(count), abs=2e-3)
    assert np.allclose(gru.score(m, texts, wide=3, window=2), gru.score(m, texts, wide=1, window=50), atol=1e-4)


def test_classes_sum_to_one():
    m = gru.Gru(3, 2, buckets=1, hidden=4, members=5)
    h = np.append(np.tanh(np.random.default_rng(0).standard_normal((1, 4))), [[1]], 1).astype(np.float32)
    every = np.arange(m.start, dtype=np.uint16)
    assert np.exp(m.log_probs(np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-5)
    m.Wc *= 400  # logits beyond what exp takes
    assert np.exp(m.log_probs(np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("words", [1_000_000, 3, 0])
def test_base_scores(spark, documents, edges, words):
    got = lm_score.lm_score(edges, table_words=words).collect()
    token = lambda t: [*(t or "").encode().lower().split(), b""]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    c = Counter(w for i, t, _ in EDGES if fold(i) != 1 for w in token(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), fold(i) == 1, len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(t)), 4)) for i, t, _ in EDGES)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def chains(n):
    random.seed(8)
    follow = {w: random.choice("abcdefgh") for w in "abcdefgh"}
    rows = []
    for i in range(n):
        w = [random.choice("abcdefgh")]
        for _ in range(60):
            w.append(follow[w[-1]] if random.random() < 0.9 else random.choice("abcdefgh"))
        rows.append((i, " ".join(x + str(k % 16) for k, x in enumerate(w))))
    return rows


def test_model_learns(spark, documents, nothing):
    held = [r for r in lm_score.lm_score(documents(chains(400)), shard_tokens=5000).collect() if r.held_out]
    assert held and sum(r.score for r in held) < 0 and sum(r.score for r in held) > sum(r.base_score for r in held) * 0.95
    assert lm_score.lm_score(nothing).isEmpty()


def test_scores_do_not_depend_on_partitions(spark, documents):
    docs = documents([*chains(120), (None, "no id"), (7, "twice"), (7, "twice")])
    one, four = ({(r.doc_id, r.n_tokens): r.score for r in lm_score.lm_score(d, shard_tokens=1500).collect()} for d in (docs.coalesce(1), docs.repartition(4)))
    assert one.keys() == four.keys() and all(one[k] == pytest.approx(four[k], rel=1e-5) for k in one)


@pytest.mark.parametrize("words", [1_000_000, 70, 0])
def test_score_against_a_plain_one(spark, documents, monkeypatch, words):
    caught, train = [], lm_score.train

    def spy(encoded, vocabulary, *rest):
        caught[:] = vocabulary, train(encoded, vocabulary, *rest)
        return caught[1]

    monkeypatch.setattr(lm_score, "train", spy)
    rows = [*chains(60), (100, None), (101, "never seen words"), (102, "a0 b1 unseen")]
    got = {r.doc_id: r.score for r in lm_score.lm_score(documents(rows), table_words=words, shard_tokens=2000).collect()}
    vocabulary, weights = caught
    m = vocabulary.model().load(weights)
    n = m.hidden
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*(t or "").encode().lower().split(), b""])
    code = {w: int(vocabulary.codes[k]) for w in c for k in np.flatnonzero(vocabulary.h == lm_score.tokens(w)[0])}
    plain = {}  # words outside the neural classes, by band
    for w in c:
        if 0 < code.get(w, 1) < m.words:
            plain.setdefault((code[w] - 1) // gru.BUCKETS if w in code else gru.BANDS - 1, []).append(w)
    soft = lambda e: e - np.log(np.exp(e).sum())
    for i, t in rows:
        h, x, total = np.zeros(n), m.start, 0.0
        for w in [*(t or "").encode().lower().split(), b""]:
            gx, gh = m.G[x].astype(float), h @ m.U
            z, r = (np.tanh(gx[:n] + gh[:n]) + 1) / 2, (np.tanh(gx[n : 2 * n] + gh[n : 2 * n]) + 1) / 2
            new = np.tanh(gx[2 * n :] + r * gh[2 * n :])
            h = new + z * (h - new)
            x = code.get(w, 1 + (gru.BANDS - 1) * gru.BUCKETS + int(lm_score.tokens(w)[0] % gru.BUCKETS))
            one = np.append(h, 1)
            cls = soft(one @ m.Wc)
            if x >= m.words:
                k, member = divmod(x - m.words, m.members)
                total += cls[m.plain + k] + soft(one @ m.Wo[k])[member]
            elif x == 0:
                total += cls[0]
            else:
                band = (x - 1) // gru.BUCKETS
                total += cls[1 + band] + math.log((c[w] + 0.5) / (sum(c[v] + 0.5 for v in plain.get(band, ())) + (0.5 if band == gru.BANDS - 1 else 0)))
        assert got[i] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-4)


def test_every_training_document_is_learnt_from(spark, documents, monkeypatch):
    seen = Counter()

    def trained(rows, neural, start, epochs):
        if epochs == 1:
            seen.update(bytes(r.x) for r in rows.collect())
        return spark.createDataFrame([], lm_score.WEIGHTS)

    monkeypatch.setattr(lm_score, "trained", trained)
    rows = [(i, " ".join(f"text {i}".split() * (i % 7))) for i in range(200)] + [(None, "no id"), (3, "a"), (3, "a")]
    lm_score.lm_score(documents(rows), shard_tokens=100).collect()
    assert sorted(len(x) // 2 for x in seen.elements()) == sorted(1 + len(t.split()) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1)


def jaccard_components(rows, k, similar=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= similar * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                top[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_copies(n, seed):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for b in range(n):
        base = [random.choice(vocab) for _ in range(random.choice([2, 8, 60, 120]))]
        for _ in range(random.choice([1, 2, 5, 25])):
            t = list(base)
            for _ in range(random.randint(0, max(1, len(t) // 8))):
                t[random.randrange(len(t))] = random.choice(vocab)
            out.append(" ".join(t) if b % 2 else "\n".join(t).upper())
    random.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, documents, k):
    rows = near_copies(25, k)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(rows), k=k).collect())
    assert got == jaccard_components(rows, k)


def test_tiles(spark, documents, monkeypatch):
    rows = near_copies(12, 11)
    monkeypatch.setattr(neardup, "TILE", 4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(rows), k=2).collect())
    assert got == jaccard_components(rows, 2)


def test_many_loose_texts_share_bands(spark, documents):
    """Texts that agree in a third of their words: many bands are shared, hardly any link is there."""
    random.seed(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, *(f"r{random.randint(0, 10**6)}" for _ in range(40))])) for i in range(150)]
    rows += [(200 + i, " ".join([*common, *(f"z{j}" for j in range(40 - i % 3)), f"y{i}"])) for i in range(20)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(rows), k=1).collect())
    assert got == jaccard_components(rows, 1)


def test_near_duplicate_edges(spark, edges, nothing):
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(edges, k=2).collect()), key=repr)
    want = [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True), (7, 6, False), (8, 8, True), (9, 9, True), (None, None, True)]
    assert got == sorted(want, key=repr)
    assert neardup.near_duplicates(nothing).isEmpty()
    left = neardup.drop_near_duplicates(edges)
    assert left.columns == edges.columns and left.count() == 8


def test_few_matches_are_pruned_and_many_are_not():
    least = neardup.least_matches(80)
    assert list(least) == sorted(least) and least[-1] < 0.8 * neardup.HASHES and least[-1] > 0.5 * neardup.HASHES


def test_components(spark):
    random.seed(3)
    pairs = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    top = {x: x for p in pairs for x in p}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    loose = {x for x in top if find(x) == x and not any(find(y) == x for y in top if y != x)}
    assert got == {x: find(x) for x in top if x not in loose}


def brute_removal(rows, least):
    low = {}
    for i, t in rows:
        for p in range(len(t) - least + 1):
            low[t[p : p + least]] = min(low.get(t[p : p + least], 1 << 70), i)
    out = []
    for i, t in rows:
        cut = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if low[t[p : p + least]] < i:
                cut[p : p + least] = b"\1" * least
        spans = sum(1 for p in range(len(t)) if cut[p] and (p == 0 or not cut[p - 1]))
        out.append((i, len(t), sum(cut), spans, hashlib.sha256(bytes(b for b, c in zip(t, cut, strict=True) if not c)).hexdigest()))
    return sorted(out)


def test_transform_against_brute_force():
    random.seed(3)
    for _ in range(150):
        least = random.choice([2, 3, 5, 8, 12, 50])
        letters = random.choice([b"ab", b"abc", b"\x00a\xff", b"a"])
        texts = [bytes(random.choice(letters) for _ in range(random.randint(0, 60 if least < 50 else 150))) for _ in range(random.randint(1, 12))]
        texts += [texts[0][: len(texts[0]) // 2] + texts[-1], texts[0]]
        owners = np.array([random.randint(0, 99) for _ in texts])
        low = {}
        for x, o in zip(texts, owners, strict=True):
            for i in range(len(x) - least + 1):
                low[x[i : i + least]] = min(low.get(x[i : i + least], 1000), o)
        assert bwt.least_owner(texts, owners, least).tolist() == [low[x[i : i + least]] for x in texts for i in range(len(x) - least + 1)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_removal(spark, documents, nothing, hot):
    random.seed(12)
    parts = ["".join(random.choice("abcdé 漢") for _ in range(random.randint(20, 120))) for _ in range(30)] + ["x" * 300, "ab" * 90]
    rows = [(i * 7 % 101, "".join(random.choice(parts) for _ in range(random.randint(0, 6)))) for i in range(100)]
    got = suffix_dedup.remove_repeats(documents(rows), hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removal([(i, t.encode()) for i, t in rows], 50)
    assert suffix_dedup.remove_repeats(nothing).isEmpty()


def test_removal_edges(spark, edges, documents):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(edges).collect()), key=repr)
    size = {i: len((t or "").encode()) for i, t, _ in EDGES}
    assert got == sorted(((i, size[i], size[i] if i == 7 else 0) for i, _, _ in EDGES), key=repr)
    a, b = "q" * 10 + "unlike text number one " * 5, "r" * 10 + "unlike text number two " * 5
    rows = [(3, a), (3, b), (3, a), (1, b), (None, a)]
    cut = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(documents(rows)).collect()), key=repr)
    assert cut == sorted([(3, 0), (3, len(b)), (3, 0), (1, 0), (None, len(a))], key=repr)
    left = suffix_dedup.remove_repeats(documents(rows), keep=("lang", "n_words"), only_text=True)
    assert left.columns == ["doc_id", "text", "lang", "n_words"]


def test_groups_hash_as_sql_does(spark):
    from pyspark.sql import functions as F

    ids = np.array([0, 1, -5, 2**62, 12345, -(2**63)], np.int64)
    want = [r[0] for r in spark.createDataFrame([(int(i),) for i in ids], "id long").coalesce(1).select(F.pmod(F.xxhash64("id"), F.lit(97))).collect()]
    assert suffix_dedup.group_of(ids, 97).tolist() == want
