import hashlib
import random
import re

from graphloom.llm.decontaminate import drop_contaminated, find_hits
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = split(t)
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = split(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if (x := tuple(w[j : j + k])) in windows:
                    hit |= set(range(j, j + k))
                    got |= windows[x]
        out.append((d, len(w), len(hit), sorted(got)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=repr)


def test_brute_force(spark, documents):
    random.seed(5)
    vocab = [f"w{i}" for i in range(12)] + ["É", "ß9"]
    items = [(i, " ".join(random.choice(vocab) for _ in range(random.choice([0, 1, 3, 9, 10, 12, 30])))) for i in range(8)] + [(90, None), (91, "...")]
    docs = []
    for i in range(60):
        t = [random.choice(vocab) for _ in range(random.randint(0, 40))]
        if i % 3 == 0:
            t[5:5] = split(random.choice(items)[1])
        docs.append((i, random.choice([" ", "-", ". "]).join(t).upper() if i % 2 else " ".join(t)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(find_hits(documents(docs), bench)) == brute(docs, items)


def test_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(None, "word"), (1, "two three four five six seven eight nine ten eleven"), (1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = found(find_hits(edges, bench))
    assert rows == brute([(i, t) for i, t, _ in EDGES], [("null", "word"), (1, "two three four five six seven eight nine ten eleven")])
    assert find_hits(nothing, bench).isEmpty()
    assert all(r.n_hit == 0 for r in find_hits(edges, bench.limit(0)).collect())
    left = drop_contaminated(edges, bench)
    assert left.columns == edges.columns and sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 3, 6, 7, 8, 9]


def test_blocks_of_windows(spark, documents, monkeypatch):
    from graphloom.llm import decontaminate

    items = [(i, " ".join(f"w{i}v{j}" for j in range(20))) for i in range(5)]
    docs = [(i, t + " tail") for i, t in items] + [(99, "clean text")]
    monkeypatch.setattr(decontaminate, "WINDOWS_PER_BROADCAST", 20)
    assert found(find_hits(documents(docs), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_digest_of_no_items(spark, documents, tmp_path):
    from graphloom.llm.decontaminate import op1_decontamination

    documents([(1, "clean")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert op1_decontamination(spark, str(tmp_path)).first().items_sha256 == hashlib.sha256(b"").hexdigest()
