"""Mixing sources to target weights, by Pareto order sampling (DataFrame operations only).

Documents have a measure, the square root of their words unless a column is given, so that long texts come
again sooner than short ones, but not in proportion. In a source with target t a document expects
e = min(cap, c x measure) copies, c being such that the expected words are t. The whole part of e is certain.
The rest is an inclusion probability p, which differs between the documents of a source, and a document's
rank is the random odds u/(1-u) over the inclusion odds p/(1-p), u being a hash of seed, id and text. The n
documents of smallest rank get one copy more: a Pareto sample of fixed size n, n being the size at which the
words taken are nearest to the target.

Sums are of whole numbers, so they do not depend on the order of rows. The last document is found without
sorting a source in one task: ranks are counted in buckets, as many as the source's rows ask for, and only
the bucket at the edge is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import id_text, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
ROWS_PER_BUCKET = 20_000
SEED = 20240501


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(id_col: Column, text: Column, seed: int) -> Column:
    """md5 of seed, id and the text's md5, as hexadecimal digits; null ids and texts are empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_text(id_col), F.coalesce(F.md5(text.cast("binary")), F.lit(""))).cast("binary"))


def digits(h: Column, first: int, n: int) -> Column:
    return F.conv(F.substring(h, first, n), 16, 10).cast("long")


def measured(weight: Column) -> Column:
    """The weight in thousandths, cut to three decimal digits: a bounded number of values in every source."""
    whole = F.floor(F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)) * 1000).cast("long")
    unit = F.pow(F.lit(10.0), F.greatest(F.length(whole.cast("string")) - 3, F.lit(0))).cast("long")
    return whole - whole % unit


def expected_rate(classes: DataFrame, cap: int) -> DataFrame:
    """(source, m, s, target), s words of measure m, to (source, c): with min(cap, c x m) copies of each, a source's words are its target."""
    falling = W.partitionBy("source").orderBy(F.col("m").desc())
    above = F.coalesce(F.sum("s").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # of larger measure: they stop at cap
    rest = F.sum(F.col("m").cast("decimal(19,0)") * F.col("s")).over(falling.rowsBetween(W.currentRow, W.unboundedFollowing)).cast("double")
    c = F.when(F.col("rest") > 0, (F.col("target") - cap * F.col("above")) / F.col("rest"))
    rows = classes.filter("m > 0").withColumn("above", above).withColumn("rest", rest).withColumn("c", c)
    return rows.groupBy("source").agg(F.max(F.when(F.col("c") * F.col("m") <= cap, F.struct("m", "c")))["c"].alias("c"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights repeat over the sources by code point, null last. ``share`` of all sizes is dealt out by
    weight; a target over ``cap`` times its source stops there and the excess goes to the others by
    weight, until none is above. The driver sees a few sums for each round, never the sources.
    """
    spark = sizes.sparkSession
    # rank without a single task: a range for each task, then the tasks' counts as offsets
    dealt = stored(
        sizes.repartitionByRange(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1),
        "sources",
    )
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") + F.col("before")).cast("int") % len(weights) + 1)
    ranked = stored(dealt.join(F.broadcast(offsets), "part").select("source", "source_size", weight.cast("long").alias("w")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, above = -1.0, F.lit(False)
    while True:
        capped, rest = ranked.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("w")))).first()
        if not rest:
            break
        new = (share * total - cap * (capped or 0)) / rest
        if new <= level:
            break
        level = new
        above = F.col("w") * F.lit(level) > F.col("source_size") * F.lit(float(cap))
    target = F.when(above, F.col("source_size") * F.lit(float(cap))).otherwise(F.col("w") * F.lit(level))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken; then the columns of ``keep``.

    A null text has size 0, null sources are one source, ranked last. Documents without words get no copies.
    Rows equal in id and text tie in rank: they are all taken or none is. ``weight_col`` takes the place of
    the measure; a weight that is null or not positive expects no copies. An empty table gives no rows.
    """
    h, size = hashed(F.col(id_col), F.col(text_col), seed), word_count(F.col(text_col))
    extra = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    given = F.sqrt(size) if weight_col is None else F.when(size > 0, F.col(weight_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), h.alias("h"), given.alias("weight"), *extra)
    u = (digits(F.col("h"), 1, 13) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = stored(rows.withColumns({"u": u, "tie": digits(F.col("h"), 14, 15), "m": measured(F.col("weight"))}).drop("h", "weight"), "mix")
    classes = stored(rows.groupBy("source", "m").agg(F.sum("size").alias("s"), F.count("*").alias("n")), "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum("s").alias("source_size"), F.sum("n").alias("n"))
    same = F.col("source").eqNullSafe(F.col("s_"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap).join(sizes.select(F.col("source").alias("s_"), "n"), same).drop("s_")
    targets = stored(targets, "mix-goals")
    rates = expected_rate(classes.select(F.col("source").alias("s_"), "m", "s").join(targets.select("source", "target"), same).drop("s_"), cap)
    targets = stored(targets.join(rates.withColumnRenamed("source", "s_"), same, "left").drop("s_"), "mix-targets")
    few = targets.count() <= 100_000
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_s")
        return left.join(small(right), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    expected = F.when(F.col("m") == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(cap)), F.coalesce(F.col("c") * F.col("m"), F.lit(float(cap)))))
    base = F.floor(F.col("expected")).cast("long")
    p = F.col("expected") - F.col("base")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    rank = F.when(p > 0, odds / (1 + odds)).otherwise(F.lit(2.0))  # in (0, 1); 2: no further copy

    def ranked(d: DataFrame) -> DataFrame:
        return d.withColumn("expected", expected).withColumn("base", base).withColumn("rank", rank)

    slim = ranked(with_source(rows.select("source", "size", "u", "tie", "m"), targets))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_PER_BUCKET)).cast("long") * 8  # at the edge, rows are about as dense as anywhere or less
    slim = slim.withColumn("bucket", F.floor(F.col("rank") * buckets).cast("long"))
    byb = slim.groupBy("source", "bucket").agg(
        F.sum(F.when(F.col("rank") <= 1, F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("base") * F.col("size")).alias("certain"), F.first("target").alias("target")
    )
    certain = F.sum("certain").over(W.partitionBy("source"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = byb.withColumn("lacks", F.col("target") - certain).withColumn("before", before).filter((F.col("words") > 0) & (F.col("lacks") > 0) & (F.col("before") < F.col("lacks")) & (F.col("before") + F.col("words") >= F.col("lacks")))
    edge = stored(edge.select("source", F.col("bucket").alias("edge"), "lacks", "before"), "mix-edge")
    in_edge = with_source(slim, edge).filter(F.col("bucket") == F.col("edge"))
    order = W.partitionBy("source").orderBy("rank", "tie")
    run = F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    near = in_edge.withColumn("upto", run).withColumn("off", F.abs(F.col("upto") - F.col("lacks")))
    # the best last document: its running sum is nearest to what the source lacks, the smaller of two; none may be best
    best = near.groupBy("source").agg(F.min(F.struct("off", "upto", "rank", "tie")).alias("b"), F.first("lacks").alias("lacks"), F.first("before").alias("before"), F.first("edge").alias("edge"), F.first("n").alias("n"))
    none = F.abs(F.col("before") - F.col("lacks")) <= F.col("b.off")
    cut = stored(
        best.select("source", F.when(none, F.col("edge") / buckets).otherwise(F.col("b.rank")).alias("cut"), F.when(none, F.lit(-(1 << 63))).otherwise(F.col("b.tie")).alias("cut_tie")),
        "mix-cut",
    )
    # a source without an edge takes all of its ranked documents if it lacks words still, else none
    total = stored(byb.groupBy("source").agg(F.sum("words").alias("words"), (F.first("target") - F.sum("certain")).alias("lacks")), "mix-total")
    cut = total.withColumnRenamed("source", "_t").join(cut, F.col("_t").eqNullSafe(F.col("source")), "left")
    cut = cut.select(F.col("_t").alias("source"), F.coalesce("cut", F.when((F.col("lacks") > 0) & (F.col("words") <= F.col("lacks")), F.lit(1.5)).otherwise(F.lit(-1.0))).alias("cut"), F.coalesce("cut_tie", F.lit(0)).alias("cut_tie"))
    out = ranked(with_source(with_source(rows, targets), cut))
    more = (F.col("rank") < F.col("cut")) | ((F.col("rank") == F.col("cut")) & (F.col("tie") <= F.col("cut_tie")))
    copies = F.col("base") + F.when(more, F.lit(1)).otherwise(F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h FROM documents),
v AS (SELECT *, CAST(floor(sqrt(size) * 1000) AS BIGINT) AS whole, (CAST('0x' || h[1:13] AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4503599627370496 AS u, CAST('0x' || h[14:28] AS BIGINT) AS tie FROM d),
r AS (SELECT *, whole - whole % CAST(pow(10, greatest(length(CAST(whole AS VARCHAR)) - 3, 0)) AS BIGINT) AS m FROM v),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM r GROUP BY 1),
l AS (SELECT *, row_number() OVER o AS place, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped, CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
k AS (SELECT arg_min(level, place) FILTER (w * level <= {CAP} * source_size) AS level FROM (SELECT *, (CAST({SHARE} AS DOUBLE) * total - {CAP} * capped) / rest AS level FROM l)),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR w * level > {CAP} * source_size THEN CAST({CAP} * source_size AS DOUBLE) ELSE w * level END AS target FROM s, k),
c AS (SELECT source, m, sum(size) AS s FROM r WHERE m > 0 GROUP BY 1, 2),
q AS (SELECT c.source, m, (target - {CAP} * coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(m * s) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS c
  FROM c JOIN t ON t.source IS NOT DISTINCT FROM c.source WINDOW o AS (PARTITION BY c.source ORDER BY m DESC)),
g AS (SELECT source, arg_max(c, m) FILTER (c * m <= {CAP}) AS c FROM q GROUP BY 1),
e AS (SELECT r.*, source_size, target, CASE WHEN m = 0 THEN 0 ELSE least(CAST({CAP} AS DOUBLE), coalesce(c * m, {CAP})) END AS e FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source LEFT JOIN g ON g.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, floor(e) AS b, e - floor(e) AS p FROM e),
z AS (SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) ELSE 2 END AS rank FROM p),
a AS (SELECT source, any_value(target) - sum(b * size) AS lacks FROM z GROUP BY 1),
n AS (SELECT source, rank, tie, sum(size) OVER (PARTITION BY source ORDER BY rank, tie ROWS UNBOUNDED PRECEDING) AS upto FROM z WHERE p > 0 UNION ALL SELECT source, -1, 0, 0 FROM a),
x AS (SELECT n.source, rank, tie, row_number() OVER (PARTITION BY n.source ORDER BY abs(upto - lacks), upto) AS k FROM n JOIN a ON a.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, CAST(b AS BIGINT) + CAST(z.rank < x.rank OR (z.rank = x.rank AND z.tie <= x.tie) AS BIGINT) AS copies,
  (CAST(b AS BIGINT) + CAST(z.rank < x.rank OR (z.rank = x.rank AND z.tie <= x.tie) AS BIGINT)) * size AS taken
FROM z JOIN x ON x.k = 1 AND x.source IS NOT DISTINCT FROM z.source
"""
