"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored
from graphloom.runtime import forget, written


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least node among its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return least.select("a", F.col("m").alias("b")).unionByName(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs to (node, comp), stored: comp is the least node that is reached. Nodes without an edge to another have no row.

    Nulls and loops link nothing. The driver sees a count and a checksum for each round; a round's table goes when the next one stands.
    """
    spark = edges.sparkSession
    since, mark = written(), None
    now = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        now = stored(_small(_large(now)), "edges")
        forget(spark, since, (now,))
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    out = stored(now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct(), "components")
    forget(spark, since, (out,))
    return out
