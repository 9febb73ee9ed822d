"""Benchmark decontamination against a broadcast hash set of n-grams (DataFrame operations only).

A window is ``n`` consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. Every token window of every document is hashed and looked up in the broadcast set; a hit
counts only if the words themselves are equal. One sentinel per document passes the same join, so that
a single scan of the texts yields counts for clean documents as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, stored, table

NGRAM = 10
WINDOWS_PER_BROADCAST = 500_000  # about 100 bytes each; more are matched in blocks of so many
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SENTINEL = -1


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, k, items): distinct windows as joined words, their length, the items that have them."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w"))
    items = items.withColumn("k", F.least(F.size("w"), F.lit(n))).filter(F.col("k") > 0)
    starts = items.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)))
    each = starts.select("item", "k", F.array_join(F.expr("slice(w, i, k)"), " ").alias("window"))
    return each.groupBy("window", "k").agg(F.collect_set("item").alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted strings), spans (start, length in words).

    Null texts have no words. Items with a null id count as item "null"; items without words match nothing.
    Repeated rows give a row each. Rows share a result if id and text are equal, so equal ids with other
    texts don't mix. Empty tables: no documents, no rows; no benchmark, no hits.
    """
    windows = stored(benchmark_windows(benchmark, n), "windows")
    lengths = [r[0] for r in windows.groupBy("k").agg(F.count("*").alias("c")).orderBy(F.col("k").desc()).collect()]  # n at most
    many = windows.count()
    blocks = max(1, -(-many // WINDOWS_PER_BROADCAST))
    hashed = windows.withColumn("h", F.xxhash64(F.split("window", " ")))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", F.xxhash64("text", F.length("text")).alias("th"), words(F.col("text")).alias("w"))

    def grams(k: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(k))))
        return F.when(F.size("w") >= k, at).otherwise(F.array().cast("array<long>"))

    probes = base.select("id", "th", "w", F.posexplode(F.concat(F.array(F.lit(SENTINEL).cast("long")), *[grams(k) for k in lengths])).alias("pos", "h"))
    offset, before = F.lit(1), F.lit(1)  # of the first window of length k among a document's hashes
    for k in lengths:
        offset = before if k == lengths[0] else F.when(F.col("k") == k, before).otherwise(offset)
        before = before + F.greatest(F.lit(0), F.size("w") - k + 1)
    start = F.col("pos") - offset
    same = (start >= 0) & (start + F.col("k") <= F.size("w")) & (F.array_join(F.slice(F.col("w"), F.greatest(start, F.lit(0)) + 1, F.col("k")), " ") == F.col("window"))
    first = docs.sparkSession.range(1).select(F.lit(SENTINEL).cast("long").alias("h"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("window"), F.lit(None).cast("array<string>").alias("items"))

    def block(b: int) -> DataFrame:
        part = hashed if blocks == 1 else hashed.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        part = part.select("h", "k", "window", "items")
        part = first.unionByName(part) if b == 0 else part
        at = probes.join(F.broadcast(part), "h").filter(((F.col("pos") == 0) & (F.col("k") == 0)) | ((F.col("pos") > 0) & (F.col("k") > 0) & same))
        return at.select("id", "th", F.when(F.col("pos") == 0, F.size("w")).alias("n_words"), F.when(F.col("pos") > 0, F.struct(start.alias("start"), F.col("k").alias("k"))).alias("hit"), "items")

    found = reduce(DataFrame.unionByName, [block(b) for b in range(blocks)])
    grouped = found.groupBy("id", "th").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_set("hit")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["k"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["k"]).alias("end")),
    )
    out = grouped.withColumn("hit", covered["n"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.col("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", "th")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, columns and clean rows as they were. Null ids and repeated rows are kept."""
    bad = find_hits(docs, benchmark, n, id_col, text_col).filter(F.col("n_hit") > 0).select(F.col(id_col).alias("_bad_id"), F.col("th").alias("_bad_th")).distinct()
    same = docs[id_col].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text_col], F.length(docs[text_col])) == bad["_bad_th"])
    return docs.join(bad, same, "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items t USING (doc_id)
"""
