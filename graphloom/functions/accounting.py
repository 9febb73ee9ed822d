"""The integer accountant: exact code lengths of simple graphs with frozen vocabularies. Not to be mixed with the analytic code lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.codelength import elias_delta_nonnegative_bits, simple_topology_bits, symbol_width
from graphloom.functions.stats import grouped_costs


def vocabulary(train: DataFrame) -> DataFrame:
    return train.select("label").distinct()


def unseen_labels(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Labels outside the frozen vocabulary; any of them is an error for this accountant."""
    return rows.select("label").distinct().join(known, "label", "left_anti")


def graph_bits(sizes: DataFrame, node_alphabet: Column, edge_alphabet: Column) -> DataFrame:
    """``sizes``: graph_id, nodes, edges. Header, topology, labels and total bits."""
    header = elias_delta_nonnegative_bits(F.col("nodes")) + elias_delta_nonnegative_bits(F.col("edges"))
    kinds = sizes.select("nodes", "edges").distinct().withColumn("topology", simple_topology_bits(F.col("nodes"), F.col("edges")))  # a big binomial once for each size
    rows = sizes.join(kinds, ["nodes", "edges"]).withColumn("header", header.cast("long"))
    rows = rows.withColumn("node_labels", (F.col("nodes") * symbol_width(node_alphabet)).cast("long")).withColumn("edge_labels", (F.col("edges") * symbol_width(edge_alphabet)).cast("long"))
    return rows.select("graph_id", "nodes", "edges", "header", "topology", "node_labels", "edge_labels", (F.col("header") + F.col("topology") + F.col("node_labels") + F.col("edge_labels")).alias("bits"))


def payload_bits(residual: Column, occurrences: Column, n_rules: Column, attachments: Column) -> Column:
    """Residual graph, a flag, the number of occurrences, their rules, their attachments."""
    return residual + 1 + elias_delta_nonnegative_bits(occurrences) + occurrences * symbol_width(n_rules) + attachments


def split_summary(rows: DataFrame, split: str, raw: str, compressed: str, dictionary_bits: int) -> DataFrame:
    """Raw and compressed bits of each split and of all, with the dictionary reused (0) and paid for in each scope."""
    g = grouped_costs(rows, split, [raw, compressed])
    reuse = g.select("scope", F.lit("frozen reuse").alias("policy"), F.col(raw).alias("raw"), F.col(compressed).alias("compressed"))
    alone = g.select("scope", F.lit("standalone").alias("policy"), F.col(raw).alias("raw"), (F.col(compressed) + dictionary_bits).alias("compressed"))
    return reuse.unionByName(alone).withColumn("saved", F.col("raw") - F.col("compressed"))
