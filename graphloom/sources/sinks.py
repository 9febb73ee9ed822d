"""Results as files: table bundles, GraphML, strict JSON, TU text."""

from __future__ import annotations

import json
import math
import os
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict(value):
    """JSON values without NaN: it becomes null, infinities become text."""
    if isinstance(value, float):
        return None if math.isnan(value) else value if math.isfinite(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [strict(v) for v in value]
    return value


def write_json(path: str, value) -> None:
    """Atomic: a reader sees the old file or the new one."""
    tmp = f"{path}.{os.getpid()}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(strict(value), f, allow_nan=False, indent=2, sort_keys=True, default=str)
    os.replace(tmp, path)


def write_bundle(path: str, tables: dict[str, DataFrame], fmt: str = "parquet") -> None:
    """Each table under its name, by Spark's committers."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.option("header", True).csv(f"{path}/{name}") if fmt == "csv" else w.format(fmt).save(f"{path}/{name}")


def graphml(labels: list[str], edges: list[tuple[int, int, str]]) -> str:
    """One small graph (a motif)."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="n" for="node" attr.name="label" attr.type="string"/>\n<key id="e" for="edge" attr.name="label" attr.type="string"/>\n<graph edgedefault="undirected">\n'
    text = lambda s: quoteattr(s)[1:-1]
    nodes = "".join(f'<node id="{i}"><data key="n">{text(x)}</data></node>\n' for i, x in enumerate(labels))
    return head + nodes + "".join(f'<edge source="{a}" target="{b}"><data key="e">{text(x)}</data></edge>\n' for a, b, x in edges) + "</graph>\n</graphml>\n"


def motif_json(dictionary: DataFrame) -> DataFrame:
    """(code, json) of dictionary rows."""
    return dictionary.select("code", F.to_json(F.struct(*[F.col(c) for c in dictionary.columns])).alias("json"))


def markdown(rows: list[dict], columns: list[str]) -> str:
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]])


def latex(rows: list[dict], columns: list[str]) -> str:
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("&", r"\&")
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(c.replace("_", r"\_") for c in columns) + r" \\", r"\hline", *[" & ".join(cell(r.get(c)) for c in columns) + r" \\" for r in rows], r"\end{tabular}"])


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, low, high, n): square root of the count bins, 5 to 30."""
    n, low, high = df.agg(F.count(value), F.min(value), F.max(value)).first()
    bins = max(5, min(30, int(math.sqrt(n or 0))))
    width = ((high - low) / bins if n else 0) or 1.0
    rows = df.filter(F.col(value).isNotNull()).groupBy(F.least(F.floor((F.col(value) - (low or 0)) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return rows.select("bin", (F.lit(low or 0) + F.col("bin") * width).alias("low"), (F.lit(low or 0) + (F.col("bin") + 1) * width).alias("high"), "n")


def write_tu(path: str, name: str, graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
    """A corpus as TU text, in folders of part files; nodes get dense 1-based ids by (graph_id, node_id).

    Each file is one sorted text, as the format asks: a line's number is its id.
    """
    from graphloom.operators.graphs import ordinal

    at = ordinal(nodes, [F.col("graph_id"), F.col("node_id")], "id").select("graph_id", "node_id", "label", (F.col("id") + 1).alias("id"))
    gs = ordinal(graphs, [F.col("graph_id")], "g").select("graph_id", F.col("label").alias("y"), (F.col("g") + 1).alias("g"))
    rows = at.join(gs, "graph_id")
    end = lambda c, n: at.select("graph_id", F.col("node_id").alias(c), F.col("id").alias(n))
    pairs = edges.join(end("u", "a"), ["graph_id", "u"]).join(end("v", "b"), ["graph_id", "v"])
    both = pairs.select("a", "b", "label").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "label"))
    lines = lambda d, order, text: d.repartitionByRange(*order).sortWithinPartitions(*order).select(text)
    out = {"A.txt": lines(both, ["a", "b"], F.concat_ws(", ", F.col("a").cast("string"), F.col("b").cast("string"))), "edge_labels.txt": lines(both, ["a", "b"], F.col("label")), "graph_indicator.txt": lines(rows, ["id"], F.col("g").cast("string")), "node_labels.txt": lines(rows, ["id"], F.col("label")), "graph_labels.txt": lines(gs, ["g"], F.col("y").cast("string"))}
    for suffix, d in out.items():
        d.write.mode("overwrite").text(f"{path}/{name}_{suffix}")
