"""The pipeline's stages against plain versions of their operators, over small tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_corpus_operators import brute_removal, jaccard_components
from tests.llm.test_decontaminate import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    (_, quality), (_, near), (_, suffix), (_, clean), (_, mix) = corpus_pipeline.STAGES
    rows = lambda d: {r.doc_id: r.text for r in d.collect()}
    one = quality(spark, docs, SF).cache()
    assert one.columns == columns and 0 < one.count() < docs.count()
    two = near(spark, one, SF).cache()
    assert two.columns == columns and sorted(rows(two)) == sorted({c for _, _, c in jaccard_components(list(rows(one).items()), 5)})
    three = suffix(spark, two, SF).cache()
    assert three.columns == columns
    left = {r[0]: r[1] - r[2] for r in brute_removal([(i, t.encode()) for i, t in rows(two).items()], 50)}
    assert {i: len(t.encode()) for i, t in rows(three).items() if "�" not in t}.keys() == left.keys()
    assert all(left[i] - 6 * (1 + len(t)) <= len(t.encode()) <= left[i] for i, t in rows(three).items())
    assert three.filter(F.length("text") != F.col("n_chars")).isEmpty()
    four = clean(spark, three, SF).cache()
    assert four.columns == columns and sorted(rows(four)) == sorted(d for d, _, hit, _ in brute(list(rows(three).items()), items) if not hit)
    five = mix(spark, four, SF).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows(four).items()}
    assert five and all(r["size"] == sizes[r.doc_id] and r.taken == r.copies * r["size"] and 1 <= r.copies <= 2 for r in five)


def test_run_takes_edges(spark, edges, nothing, tmp_path):
    for name, d in (("some", edges), ("none", nothing)):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()
    assert all(r.copies in (1, 2) for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect())


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
    shutil.copy(root / "corpus_pipeline.py", tmp_path)
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("name", ["corpus_pipeline.py"])
def test_all_names_are_registered(name):
    import __spark_entry__ as e

    assert {q.split("_")[0] for q in e.queries() if q.startswith("op")} == {f"op{n}" for n in range(1, 11)} and "pipeline" in e.queries()
