"""An extension: a frozen dictionary over a stream of whole graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.compressor import MotifCompressor

#: Rows of a graph arrive in one batch: nodes with kind 'n' (a = node id), edges with kind 'e' (a, b = ends).
GRAPH_ROWS = "graph_id long, kind string, a long, b long, label string"


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = rows.filter("kind = 'n'").select("graph_id", F.col("a").alias("node_id"), "label")
    return nodes, rows.filter("kind = 'e'").select("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "label")


def transform_stream(rows: DataFrame, model: MotifCompressor, sink: Callable[[DataFrame, int], None]):
    """A writer that gives ``sink`` the per-graph costs of every batch, with the batch id, by which a sink can tell a repeat."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            sink(model.transform(*split_rows(df)).per_graph.withColumn("batch", F.lit(number)), number)

    return rows.writeStream.foreachBatch(batch)


def support_stream(occurrence_rows: DataFrame, time: str, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Occurrences of each code in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return occurrence_rows.withWatermark(time, late).groupBy(F.window(time, every), "code").agg(F.count("*").alias("n"))
