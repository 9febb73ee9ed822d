"""Operators that map each row: token counts, quality, toxicity, licenses."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from graphloom.llm import common, licenses, quality, token_counts, toxicity
from tests.llm.conftest import EDGES

P = pytest.importorskip("public_tokenizers")


def test_tokens_equal_the_library(spark, edges, documents, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    random.seed(2)
    parts = ["ab", " ", "  ", "\n", "\x0b", "\x85", "\xa0", "1", "²", "é", "漢", "👍🏽", "'s", "'LL", "!?", "<|endoftext|>", "<|end", " the", "́", "ª"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 15))) for _ in range(600)] + ["a" * 5000, "ab" * 3000, "=" * 999]
    for df, want in ((edges, [t for _, t, _ in EDGES]), (documents(list(enumerate(texts))), texts)):
        got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, path).collect())
        n = [(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in want]
        assert got == sorted((b, k, k > 1024) for b, k in n)
    assert token_counts.token_counts(nothing, path).isEmpty()


def test_counts_survive_a_full_table():
    c = token_counts.MergeCounter(P.path("byte_bpe_50k.json"), kept=3)
    assert [c.count("one two three four five six") for _ in range(3)] == [6, 6, 6] and len(c) <= 3


def brute_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 3000 else None
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_quality_rules(spark, edges, documents, nothing):
    random.seed(3)
    texts = ["\n".join(" ".join(random.choice("ab#é 漢| \x85") for _ in range(random.randint(0, 9))) for _ in range(random.randint(0, 9))) for _ in range(200)]
    rows = [*enumerate(texts, 100), *[(i, t) for i, t, _ in EDGES]]
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality(documents(rows), labels).collect())
    want = sorted((*w[:4], r) for w in (brute_rules(t) for _, t in rows) for r in [w[4] if w[4] is not None else -1])
    assert [g for g in got if g[0] < 3000] == [w for w in want if w[0] < 3000] and len(got) == len(want)
    for r in quality.quality(edges, labels).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.quality(nothing, labels).isEmpty()


def test_long_words_use_exact_ranks():
    words = [str(i).encode() for i in range(9000)] * 2
    assert quality.repeated_words(words) == 18000
    assert quality.repeated_words(words[:9000]) == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        crf = quality.Crf(rng.standard_normal((2, 3)), rng.standard_normal((2, 2)))
        x = rng.standard_normal((n, 3))
        score = lambda p: sum(x[i] @ crf.unary[s] for i, s in enumerate(p)) + sum(crf.pair[a, b] for a, b in zip(p, p[1:], strict=False))
        assert tuple(crf.viterbi(x).astype(int)) == max(product((0, 1), repeat=n), key=score)


def test_crf_gradient():
    from itertools import product

    rng = np.random.default_rng(2)
    k = quality.N_FEATURES
    w, p = rng.standard_normal((2, k)), rng.standard_normal((2, 2))
    x, y, n = rng.standard_normal((2, 4, k)), np.array([[1, 0, 0, 1], [0, 1, 1, 0]]), np.array([4, 3])
    x[1, 3] = 0

    def loglik(w, p):
        total = 0.0
        for d in range(2):
            s = lambda z: sum(x[d, i] @ w[a] for i, a in enumerate(z)) + sum(p[a, b] for a, b in zip(z, z[1:], strict=False))  # noqa: E731, B023
            total += s(y[d, : n[d]]) - np.log(sum(np.exp(s(z)) for z in product((0, 1), repeat=n[d])))
        return total / n.sum()

    gw, gp = quality.gradient(x, y, n, w, p)
    for a, g in ((w, gw), (p, gp)):
        for at in np.ndindex(a.shape):
            b = a.copy()
            b[at] += 1e-5
            assert abs((loglik(b if a is w else w, b if a is p else p) - loglik(w, p)) / 1e-5 - g[at]) < 1e-3


def junk_and_prose():
    vocab = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    prose = lambda n=6: [" ".join(random.choice(vocab) for _ in range(12)).capitalize() + "." for _ in range(n)]
    junk = lambda n=6: [" ".join(random.choice(vocab).upper() + "### $$$ |" for _ in range(9)) for _ in range(n)]
    return prose, junk


def test_line_labels_follow_lines_and_documents():
    random.seed(14)
    prose, junk = junk_and_prose()
    made = [([*prose(5), *junk(k % 2)], 1) for k in range(40)] + [([*prose(k % 2), *junk(5)], 0) for k in range(40)]
    documents = []
    for lines, y in made:
        _, words, again = quality.lines_of("\n".join(lines).encode())
        documents.append((np.array([quality.line_features(line.encode(), w, a) for line, w, a in zip(lines, words, again, strict=True)]), np.array([len(w) for w in words]), y))
    crf = quality.train(documents)
    mixed = 0
    for (x, n, y), (lines, _) in zip(documents, made, strict=True):
        labels = quality.line_labels(crf, x, n, y)
        assert (n @ labels >= 0.5 * n.sum()) == bool(y)
        assert labels.tolist() == ["#" not in line for line in lines]
        mixed += 0 < labels.mean() < 1
    assert mixed == 40
    one = documents[0][0][:1]  # a single line takes the document's label, whatever it looks like
    assert quality.line_labels(crf, one, np.array([12]), 0).tolist() == [0] and quality.line_labels(crf, one, np.array([12]), 1).tolist() == [1]


def test_share_and_verdict_against_all_labellings():
    from itertools import product

    random.seed(15)
    rng = np.random.default_rng(15)
    prose, junk = junk_and_prose()
    for _ in range(40):
        crf = quality.Crf(rng.standard_normal((2, quality.N_FEATURES)), rng.standard_normal((2, 2)))
        lines = [random.choice([*prose(1), *junk(1), "", "short", prose(1)[0][:30]]) for _ in range(random.randint(1, 8))]
        text = "\n".join(lines)
        kept = [line for line in lines if line.split()]
        x = [quality.line_features(line.encode(), line.encode().split(), line in kept[:i]) for i, line in enumerate(kept)]
        score = lambda z: sum(np.dot(f, crf.unary[s]) for f, s in zip(x, z, strict=True)) + sum(crf.pair[a, b] for a, b in zip(z, z[1:], strict=False))  # noqa: E731, B023
        n = sum(len(line.split()) for line in kept)
        share = sum(len(line.split()) for line, s in zip(kept, max(product((0, 1), repeat=len(kept)), key=score), strict=True) if s) / n if n else 0.0
        got = quality.judge(text.encode(), crf)
        assert got[7] == pytest.approx(share) and got[0] == n
        assert got[6] == (not got[5] and share >= quality.CONTENT_SHARE)


def test_half_boilerplate_has_a_share_between(spark, documents):
    random.seed(16)
    prose, junk = junk_and_prose()
    rows = [(i, "\n".join([*prose(4), *(junk(1) if i % 6 == 1 else [])] if i % 2 else [*junk(4), *(prose(1) if i % 6 == 0 else [])])) for i in range(120)]
    rows += [(200, "\n".join([*prose(5), *junk(5)])), (201, "\n".join([*prose(8), *junk(2)])), (202, "\n".join([*prose(2), *junk(8)])), (203, "\n".join(prose(300) + junk(5)))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(203, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(documents(rows), labels).collect()}
    assert all(0 < got[i].content_share < 1 for i in (200, 201, 202))
    assert got[201].kept and not got[202].kept


def test_junk_goes_and_prose_stays(spark, documents):
    random.seed(4)
    prose, junk = junk_and_prose()
    rows = [(i, "\n".join(prose() if i % 2 else junk())) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.quality(documents(rows), labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(80, 120))


def test_toxicity(spark, documents, edges, nothing):
    random.seed(6)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [random.choice(vocab) for _ in range(40)]
        if bad:
            words[random.randint(0, 39)] = random.choice(["scum", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(documents(rows), known).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and 60 < len(held) < 180
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    flipped = known.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert sorted((r.doc_id, r.score) for r in toxicity.toxicity(documents(rows), flipped).collect()) == sorted((r.doc_id, r.score) for r in got)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(edges, none).collect()) == len(EDGES)
    assert toxicity.toxicity(nothing, none).isEmpty()


def test_ftrl_against_a_plain_one():
    """Per-coordinate updates and the threshold, one coordinate at a time in dictionaries."""
    random.seed(21)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.7, 0.3
    model = toxicity.Ftrl(5, alpha, beta, l1, l2)
    z, n = dict.fromkeys(range(32), 0.0), dict.fromkeys(range(32), 0.0)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(400):
        at, y = sorted(random.sample(range(32), random.randint(1, 6))), random.randint(0, 1)
        model.learn(np.array(at), y)
        g = 1 / (1 + math.exp(-sum(weight(i) for i in at))) - y
        w = {i: weight(i) for i in at}
        for i in at:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert model.weights() == pytest.approx([weight(i) for i in range(32)])
    assert any(weight(i) == 0 for i in range(32)) and any(weight(i) != 0 for i in range(32))


def test_toxicity_scores_against_a_plain_model(spark, documents):
    """Training and scoring worked out again without Spark: the sample by hash, the order of documents, features as sets of hashed grams."""
    from pyspark.sql import functions as F

    random.seed(22)
    vocab = [f"w{i}" for i in range(40)] + ["scum"]
    rows = [(i, " ".join(random.choice(vocab) for _ in range(12))) for i in range(80)] + [(90, None), (91, "Scum, SCUM!")]
    labels = [(i, int("scum" in t)) for i, t in rows[:80]]
    got = {r.doc_id: r.score for r in toxicity.toxicity(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}

    def grams(text):
        w = [xxhash.xxh3_64_intdigest(x) for x in (text or "").encode().translate(toxicity.TOKEN_TABLE).split()]
        mix = lambda x: int(common.mix64(np.array([x % 2**64], np.uint64))[0]) >> (64 - toxicity.BITS)
        pairs = [a * int(toxicity._PAIR) + b for a, b in zip(w, w[1:], strict=False)]
        skips = [a * int(toxicity._SKIP) + b + 1 for a, b in zip(w, w[2:], strict=False)]
        return {0} | {mix(x) for x in [*w, *pairs, *skips]}

    order = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i, _ in rows], "id long").select("id", F.xxhash64(F.lit(17), "id")).collect()}
    data = [(grams(t), y) for (i, t), (_, y) in sorted(zip(rows[:80], labels, strict=True), key=lambda r: order[r[0][0]]) if zlib.crc32(str(i).encode()) % 5 != 0]
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for e in range(toxicity.EPOCHS):
        for k in np.random.default_rng(e).permutation(len(data)):
            at, y = data[k]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(map(weight, grams(t))))), abs=1e-9)


def test_licenses(spark, documents, edges, nothing):
    rows = [
        (1, "Code under the MIT License. Also UNDER-THE-mit-license!"), (2, "Apache\nLicense, Version 2"), (3, "Licensed under CC BY-SA 4.0"), (4, "licensed under the license version 2 apache"), (5, "plain words"),
        (6, "Licensed under the Apache License, Version 2.0."), (7, "all rights reserved rights all"), (8, "Licensed under CC BY-NC 4.0."), (9, "licensed under CC BY-ND 4.0"), (10, "Licensed under CC BY-NC-SA 4.0"), (11, "licensed under cc by 4 0"),
        (12, "licensed under the mozilla general license version 2 0"), (13, "reserved: all of the rights"), (14, "This work is licensed under the GNU General Public License, version 3."), (15, "licensed under the GNU Lesser General Public License version 3"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (2, 1, 6, "mit", 1.0)
    assert (got[2].n_base, got[2].labels) == (1, "apache-2")
    assert got[3].base_labels == "" and got[3].labels == "cc-by-sa" and got[3].score == 1
    assert got[4].n_base == 0 and got[4].labels == "apache-2" and got[4].score == pytest.approx(7 / 8)
    assert got[5].labels == "" and got[5].score == 0 and got[5].first_word is None
    want = {6: "apache-2", 7: "all-rights-reserved", 8: "cc-by-nc", 9: "cc-by-nd", 10: "cc-by-nc,cc-by-nc-sa", 11: "cc-by", 12: "", 13: "", 14: "gpl-3", 15: "lgpl-3"}
    assert {i: got[i].labels for i in want} == want  # of 10, the first is the phrase's
    assert len(licenses.scan_licenses(edges).collect()) == len(EDGES) and licenses.scan_licenses(nothing).isEmpty()


def test_wrapped_and_long_notices(spark, documents):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mit = next(t for t in licenses.TEMPLATES if t.startswith("permission is hereby"))
    gpl = next(t for t in licenses.TEMPLATES if t.startswith("this program") and "version 3" in t)
    rows = [
        (1, bsd), (2, "x\n" + bsd.replace(" ", "\n * ")), (3, "# Licensed under the Apache\n#   License, Version 2.0"), (4, "Some text. Licensed under the Mozilla Public\n\nLicense, Version 2.0. More."),
        (5, "der mit\nEin Satz von vielen Worten.\nLicensed under the Apache License, Version 2.0."), (6, "all rights\nare long and wide here, and\nreserved"), (7, "Copyright X.\n\n" + mit.title()), (8, gpl.upper()),
        (9, " ".join(w for i, w in enumerate(mit.split()) if i % 9)), (10, " and more words ".join(mit.split())),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(documents(rows)).collect()}
    assert got[1] == got[2] == ("bsd", 1.0)
    assert got[3] == got[5] == ("apache-2", 1.0)
    assert got[4] == ("mpl-2", 1.0)
    assert got[6] == ("", 0.0) and got[10] == ("", 0.0)
    assert got[7] == ("mit", 1.0) and got[8] == ("gpl-3", 1.0) and got[9][0] == "mit"


def test_filters_lose_nothing():
    random.seed(9)
    vocab = [f"t{i}" for i in range(12)]
    temps = {" ".join(random.choice(vocab) for _ in range(random.randint(1, 9))): str(i % 25) for i in range(30)}
    freq = {w.encode(): random.randint(0, 9) for w in vocab}
    index = licenses.Index(temps, freq, 0.8)
    sets = {t: set(t.split()) for t in temps}
    need = {t: math.ceil(0.8 * len(s) - 1e-9) for t, s in sets.items()}
    for _ in range(3000):
        text = [random.choice([*vocab, "other", "more"]) for _ in range(random.randint(0, 20))]
        want = {}
        for t, label in temps.items():
            span = math.ceil(len(t.split()) / 0.8 - 1e-9)
            near = [sets[o] for o, other in temps.items() if other != label and len(sets[o] & sets[t]) >= min(need[o], need[t])]
            for i in range(max(0, len(text) - span) + 1):
                w = set(text[i : i + span])
                if len(w & sets[t]) >= need[t] and all(sets[t] - o <= w for o in near) and not any(sets[t] < o and o - sets[t] <= w for o in near):
                    want[t] = max(want.get(t, 0), len(w & sets[t]) / len(sets[t]))
        assert sorted(index.matches([w.encode() for w in text])) == sorted((temps[t], s) for t, s in want.items())
