"""A corpus from documents to a mix: quality rules, near-duplicates, repeated passages, benchmark
passages, source weights.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of
documents, the last one the mix: documents that are taken at least once, with their copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, neardup, quality, suffix_dedup
from graphloom.llm.common import stored, table
from graphloom.runtime import passing

ID, TEXT = "doc_id", "text"
OWN = ("size", "source_size", "target", "copies", "taken")  # of the mix; columns of documents with these names end there


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rest = tuple(c for c in docs.columns if c != ID)
    return quality.quality(docs, table(spark, sf_dir, "labels"), keep=rest, only_kept=True).select(docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, similarity 0.8)."""
    return neardup.drop_near_duplicates(docs, k=5)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document with a smaller id has; n_chars follows the text."""
    rest = tuple(c for c in docs.columns if c not in (ID, TEXT))
    out = suffix_dedup.remove_repeats(docs, keep=rest, only_text=True)
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length(TEXT).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies, words taken and their source's target."""
    rest = tuple(c for c in docs.columns if c not in (ID, "source", *OWN))
    return mixing.mix(docs, keep=rest).filter("copies > 0").select(ID, "source", *rest, *OWN)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", neardup_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again; what it wrote on the way, and its input, go then."""
    docs = table(spark, sf_dir, "documents")
    with passing(spark) as keep:
        for name, stage in STAGES[:-1]:
            with passing(spark) as result:
                docs = stored(stage(spark, docs, sf_dir), name)
                result.append(docs)
        keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
