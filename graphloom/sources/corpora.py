"""Graph corpora derived from relational tables, as (nodes, edges) with columns graph_id, node_id, label / graph_id, u, v, label, u < v."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Graphs = tuple[DataFrame, DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select("graph_id", F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "label").filter("u != v").distinct()


def event_chain(spark: SparkSession, sf_dir: str) -> Graphs:
    """A user's events in order: nodes are events with their type, edges join consecutive ones."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("node_id"), F.col("event_type").alias("label"), "ts")
    nxt = F.lead("node_id").over(W.partitionBy("graph_id").orderBy("ts", "node_id"))
    pairs = e.withColumn("other", nxt).filter("other is not null").withColumn("label", F.lit("_"))
    return e.select("graph_id", "node_id", "label"), undirected(pairs, "node_id", "other")


def event_flow(spark: SparkSession, sf_dir: str) -> Graphs:
    """A user's event types: edges join types that follow each other."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("graph_id"), "event_id", "event_type", "ts")
    kinds = e.select("event_type").distinct().withColumn("node_id", (F.row_number().over(W.orderBy("event_type")) - 1).cast("long"))  # the types are few
    e = e.join(F.broadcast(kinds), "event_type")
    nxt = F.lead("node_id").over(W.partitionBy("graph_id").orderBy("ts", "event_id"))
    pairs = e.withColumn("other", nxt).filter("other is not null").withColumn("label", F.lit("_"))
    return e.select("graph_id", "node_id", F.col("event_type").alias("label")).distinct(), undirected(pairs, "node_id", "other")


def order_supplier(spark: SparkSession, sf_dir: str) -> Graphs:
    """A customer's orders (even nodes) and the suppliers of their lines (odd nodes)."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey"), F.col("o_orderpriority").alias("label"))
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    lines = o.join(li, "o_orderkey").select("graph_id", (F.col("o_orderkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"), F.lit("_").alias("label"))
    orders = o.select("graph_id", (F.col("o_orderkey") * 2).alias("node_id"), "label")
    return orders.unionByName(lines.select("graph_id", F.col("b").alias("node_id"), F.lit("S").alias("label")).distinct()), undirected(lines, "a", "b")


def co_purchase(spark: SparkSession, sf_dir: str) -> Graphs:
    """A customer's parts; edges join parts of one order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"), "o_orderkey")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part")).distinct()
    lines = o.join(li, "o_orderkey")
    pairs = lines.select("graph_id", "o_orderkey", F.col("part").alias("a")).join(lines.select("o_orderkey", F.col("part").alias("b")), "o_orderkey").filter("a < b").withColumn("label", F.lit("_"))
    kinds = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("label"))
    nodes = lines.select("graph_id", "part").distinct().join(kinds, "part").select("graph_id", F.col("part").alias("node_id"), "label")
    return nodes, undirected(pairs, "a", "b")
