"""Graph files: TU text, JSONL molecules, CSV tables, dependency trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The two naming schemes of the files of a TU data set, by role.
TU_FILES = {
    "edges": ("{n}_A.txt", "{n}.edges"),
    "indicator": ("{n}_graph_indicator.txt", "{n}.graph_idx"),
    "graph_labels": ("{n}_graph_labels.txt", "{n}.graph_labels"),
    "node_labels": ("{n}_node_labels.txt", "{n}.node_labels"),
    "edge_labels": ("{n}_edge_labels.txt", "{n}.edge_labels"),
    "node_attributes": ("{n}_node_attributes.txt", "{n}.node_attributes"),
    "edge_attributes": ("{n}_edge_attributes.txt", "{n}.edge_attributes"),
}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def tu_directory(spark: SparkSession, root: str, name: str) -> str:
    """The folder with the edge file: root, root/name, root/name/raw, root/raw, else the shallowest below root, the first by name."""
    for d in (root, f"{root}/{name}", f"{root}/{name}/raw", f"{root}/raw"):
        if any(exists(spark, f"{d}/{f.format(n=name)}") for f in TU_FILES["edges"]):
            return d
    fs, p = _fs(spark, root)
    found = []
    if fs.exists(p):
        it = fs.listFiles(p, True)
        while it.hasNext():
            at = it.next().getPath()
            if at.getName() in [f.format(n=name) for f in TU_FILES["edges"]]:
                found.append(at.getParent().toString())
    if not found:
        raise FileNotFoundError(f"no edge file of {name} under {root}")
    return min(found, key=lambda d: (d.count("/"), d))


def numbered_text(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines that are not blank, numbered from 0 through the file, or the files of a folder by name.

    A line's place is its split's place and its place there. Splits are few; their counts give the offsets.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")).filter("trim(value) != ''")
    sizes = raw.groupBy("f", "b").agg(F.count("*").alias("c"))
    before = sizes.select("f", "b", F.coalesce(F.sum("c").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(W.partitionBy("f", "b").orderBy("m")) - 1
    return raw.withColumn("at", at).join(F.broadcast(before), ["f", "b"]).select((F.col("at") + F.col("before")).cast("long").alias("n"), "value")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, cells): numbered lines split at commas or blanks."""
    return numbered_text(spark, path).select("n", F.split(F.trim(F.regexp_replace("value", ",", " ")), r"\s+").alias("cells"))


def label_text(cells: Column) -> Column:
    """A label vector as text: integers without leading zeros if all cells are integers, joined by commas."""
    whole = F.forall(cells, lambda c: c.rlike(r"^[+-]?\d+$"))
    return F.concat_ws(",", F.when(whole, F.transform(cells, lambda c: c.cast("long").cast("string"))).otherwise(cells))


def load_tu(spark: SparkSession, root: str, name: str, node_labels: str = "auto", edge_labels: str = "auto", attributes: bool = False) -> dict[str, DataFrame]:
    """Tables graphs (graph_id, label), nodes, edges (and attribute tables) of a TU data set.

    ``node_labels``: auto, none, file or degree; ``edge_labels``: auto, none, file or constant. Edges given
    in both directions become one; other labels on the way back, loops and edges across graphs raise.
    """
    if node_labels not in ("auto", "none", "file", "degree") or edge_labels not in ("auto", "none", "file", "constant"):
        raise ValueError("unknown label mode")
    d = tu_directory(spark, root, name)

    def path(role: str) -> str | None:
        return next((p for f in TU_FILES[role] if exists(spark, p := f"{d}/{f.format(n=name)}")), None)

    def rows(role: str) -> DataFrame:
        if (p := path(role)) is None:
            raise FileNotFoundError(f"{name}: no {role} file in {d}")
        return numbered(spark, p)

    pairs = rows("edges").select("n", F.col("cells")[0].cast("long").alias("a"), F.col("cells")[1].cast("long").alias("b"))
    indicator = rows("indicator").select(F.col("n").alias("node_id"), F.col("cells")[0].cast("long").alias("graph_id"))
    low, n_edges, high = pairs.agg(F.min(F.least("a", "b")), F.count("*"), F.max(F.greatest("a", "b"))).first()
    n_nodes = indicator.count()
    if not n_nodes or not n_edges:
        raise ValueError(f"{name}: an empty file")
    if low not in (0, 1) or high - low >= n_nodes and high >= n_nodes + low:
        raise ValueError(f"{name}: node ids from {low} to {high} for {n_nodes} nodes")
    pairs = pairs.select("n", (F.col("a") - low).alias("a"), (F.col("b") - low).alias("b"))
    if edge_labels == "file" or edge_labels == "auto" and path("edge_labels"):
        pairs = pairs.join(rows("edge_labels").select("n", label_text(F.col("cells")).alias("label")), "n", "left")
    else:
        pairs = pairs.withColumn("label", F.lit("_"))
    at = lambda c, g: indicator.select(F.col("node_id").alias(c), F.col("graph_id").alias(g))
    known = pairs.join(at("a", "graph_id"), "a").join(at("b", "other"), "b")
    edges = known.groupBy("graph_id", "other", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("label").alias("label"), F.count_distinct("label").alias("kinds"))
    bad = edges.select(F.when(F.col("u") == F.col("v"), "a self-loop").when(F.col("graph_id") != F.col("other"), "an edge across graphs").when(F.col("kinds") > 1, "two labels on one edge").alias("p")).filter("p is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{name}: {bad[0].p}")
    edges = edges.select("graph_id", "u", "v", "label")
    nodes = indicator.select("graph_id", "node_id")
    if node_labels == "degree":
        from graphloom.operators.graphs import degrees

        nodes = degrees(nodes, edges).select("graph_id", "node_id", F.col("degree").cast("string").alias("label"))
    elif node_labels == "file" or node_labels == "auto" and path("node_labels"):
        nodes = nodes.join(rows("node_labels").select(F.col("n").alias("node_id"), label_text(F.col("cells")).alias("label")), "node_id").select("graph_id", "node_id", "label")
    else:
        nodes = nodes.withColumn("label", F.lit("_"))
    first = indicator.agg(F.min("graph_id")).first()[0]
    out = {"graphs": rows("graph_labels").select((F.col("n") + first).alias("graph_id"), F.col("cells")[0].cast("int").alias("label")), "nodes": nodes, "edges": edges}
    if attributes:
        number = lambda c: F.transform(c, lambda x: x.cast("double"))
        if path("node_attributes"):
            out["node_attributes"] = rows("node_attributes").select(F.col("n").alias("node_id"), number(F.col("cells")).alias("values"))
        if path("edge_attributes"):
            out["edge_attributes"] = rows("edge_attributes").join(pairs.select("n", "a", "b"), "n").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), number(F.col("cells")).alias("values"))
    return out


JSONL = "num_nodes INT, node_feat ARRAY<ARRAY<INT>>, edge_index ARRAY<ARRAY<INT>>, edge_attr ARRAY<ARRAY<INT>>, y ARRAY<DOUBLE>"


def load_jsonl(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """graphs (graph_id, num_nodes, y), nodes, arcs of molecules in JSON lines; edge_index is 2 x E or E x 2. graph_id is the line's number."""
    lines = numbered_text(spark, path).withColumnRenamed("n", "graph_id")
    r = lines.select("graph_id", F.from_json("value", JSONL).alias("r")).select("graph_id", "r.*")
    wide = (F.size("edge_index") == 2) & ((F.size(F.col("edge_index")[0]) != 2) | (F.size("edge_attr") == 2))
    pairs = F.when(wide, F.arrays_zip(F.col("edge_index")[0], F.col("edge_index")[1])).otherwise(F.transform("edge_index", lambda p: F.struct(p[0].alias("0"), p[1].alias("1"))))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    arcs = r.select("graph_id", F.posexplode(pairs).alias("i", "p"), "edge_attr").select("graph_id", F.col("p")["0"].cast("long").alias("a"), F.col("p")["1"].cast("long").alias("b"), text(F.get("edge_attr", F.col("i"))).alias("label"))
    nodes = r.select("graph_id", F.posexplode("node_feat").alias("node_id", "f")).select("graph_id", F.col("node_id").cast("long").alias("node_id"), text("f").alias("label"))
    return {"graphs": r.select("graph_id", "num_nodes", F.col("y")[0].alias("y")), "nodes": nodes, "arcs": arcs}


def arc_faults(graphs: DataFrame, nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(graph_id, fault, n): ids out of range, loops, arcs without the arc back, edges not given exactly twice or with two labels, wrong node counts."""
    name = lambda d, f: d.select("graph_id", F.lit(f).alias("fault"))
    size = graphs.select("graph_id", "num_nodes")
    far = arcs.join(size, "graph_id").filter("least(a, b) < 0 or greatest(a, b) >= num_nodes")
    back = arcs.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))
    alone = arcs.join(back, ["graph_id", "a", "b"], "left_anti")
    edge = arcs.filter("a != b").groupBy("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("kinds"))
    count = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).join(size, "graph_id", "right").filter("coalesce(n, 0) != num_nodes")
    out = name(far, "range").unionByName(name(arcs.filter("a = b"), "loop")).unionByName(name(alone, "no reverse")).unionByName(name(edge.filter("n != 2"), "not twice")).unionByName(name(edge.filter("kinds > 1"), "two labels")).unionByName(name(count, "node count"))
    return out.groupBy("graph_id", "fault").agg(F.count("*").alias("n"))


def arcs_to_edges(arcs: DataFrame) -> DataFrame:
    return arcs.select("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "label").distinct()


def pick_graphs(tables: dict[str, DataFrame], wanted: DataFrame) -> dict[str, DataFrame]:
    """The tables' rows of ``wanted`` (graph_id); raises if one is missing."""
    if lost := wanted.join(tables["graphs"], "graph_id", "left_anti").count():
        raise ValueError(f"{lost} of the wanted graphs are missing")
    return {k: t.join(wanted, "graph_id", "left_semi") if "graph_id" in t.columns else t for k, t in tables.items()}


def molecule_table(rows: DataFrame, text: str = "smiles", order: str = "row") -> DataFrame:
    """Distinct texts with the first row that has each; a null text raises."""
    if not rows.filter(F.col(text).isNull()).isEmpty():
        raise ValueError(f"null in {text}")
    return rows.groupBy(text).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def normalized_header(rows: DataFrame, wanted: str = "smiles", limit: int | None = None) -> DataFrame:
    """The column of that name in any case, renamed; at most ``limit`` rows."""
    found = [c for c in rows.columns if c.lower() == wanted]
    if not found:
        raise ValueError(f"no column {wanted}")
    rows = rows.withColumnRenamed(found[0], wanted)
    return rows if limit is None else rows.limit(limit)


def dependency_trees(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """graph_id, heads, pos, dep to nodes and edges; a root is its own head and gives no edge."""
    nodes = sentences.select("graph_id", F.posexplode("pos").alias("node_id", "label")).withColumn("node_id", F.col("node_id").cast("long"))
    each = sentences.select("graph_id", "dep", F.posexplode("heads").alias("child", "head")).filter("child != head")
    return nodes, each.select("graph_id", F.least("child", "head").cast("long").alias("u"), F.greatest("child", "head").cast("long").alias("v"), F.get("dep", F.col("child")).alias("label"))


def smiles_graphs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """graph_id, smiles to nodes and edges, where the optional chemistry library is installed; else ImportError."""
    from rdkit import Chem  # noqa: F401

    schema = "graph_id long, kind string, a long, b long, label string"

    def parse(frames):
        import pandas as pd
        from rdkit import Chem

        for f in frames:
            out = []
            for g, s in zip(f.graph_id, f.smiles, strict=True):
                m = Chem.MolFromSmiles(s)
                if m is None:
                    raise ValueError(f"not a molecule: {s}")
                out += [(g, "n", x.GetIdx(), None, x.GetSymbol()) for x in m.GetAtoms()]
                out += [(g, "e", *sorted((x.GetBeginAtomIdx(), x.GetEndAtomIdx())), str(x.GetBondType())) for x in m.GetBonds()]
            yield pd.DataFrame(out, columns=["graph_id", "kind", "a", "b", "label"])

    all_rows = rows.select("graph_id", "smiles").mapInPandas(parse, schema)
    return all_rows.filter("kind = 'n'").select("graph_id", F.col("a").alias("node_id"), "label"), all_rows.filter("kind = 'e'").select("graph_id", F.col("a").alias("u"), F.col("b").alias("v"), "label")
