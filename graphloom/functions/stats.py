"""Paired statistics, bootstrap intervals, skylines, classification tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graphs import dealt, ordinal


def _stirling_rest(n: Column) -> Column:
    """ln n! less (n + 1/2) ln n - n + ln(2 pi) / 2, for n > 0: from n! where that is small, else by the series, whose next term is below 1e-15."""
    x = n.cast("double")
    small = F.log(F.factorial(F.least(n, F.lit(20)).cast("int"))) - ((x + 0.5) * F.log(x) - x + math.log(2 * math.pi) / 2)
    return F.when(n <= 20, small).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (x * x)) / (x * x)) / (x * x)) / x)


def sign_test(successes: Column, trials: Column) -> Column:
    """Chance of at least so many successes in fair trials; null without trials.

    A term comes from its deviance, without sums of logarithms. Terms are added from 10 roots of n below the mean,
    or the successes, to 10 roots above the larger: all others together are below e**-150 of the sum, which no double shows.
    """
    s, n = successes.cast("long"), trials.cast("long")
    s = F.when(s > n, n).otherwise(s)
    mean, far = F.floor(n / 2), F.ceil(10 * F.sqrt(n.cast("double")))
    first, last = F.greatest(s, mean - far, F.lit(0)), F.least(n, F.greatest(s, mean) + far)

    def term(k: Column) -> Column:
        d = (2 * k - n) / n
        log = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - k * F.log1p(d) - (n - k) * F.log1p(-d)
        return F.when((k == 0) | (k == n), F.exp(-n * math.log(2))).otherwise(F.exp(log) * F.sqrt(n / (2 * math.pi * k * (n - k))))

    return F.when((n > 0) & s.isNotNull(), F.aggregate(F.sequence(first, last), F.lit(0.0), lambda a, k: a + term(k)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def bootstrap(values: DataFrame, replicates: int, level: float = 0.95, seed: int = 0, stat: str = "mean", one_sided: bool = False) -> DataFrame:
    """(estimate, lower, upper) of the mean or median of column ``value``; ``values`` also has pos, 0-based.

    Draw j of replicate r takes position md5(seed:r:j) mod n, so any engine can repeat it. Rows are the
    replicates times the values, dealt over the cluster.
    """
    v = values.filter(finite(F.col("value").cast("double")))
    n = v.count()
    of = {"mean": F.avg, "median": F.median}[stat]
    if not n:
        return values.sparkSession.createDataFrame([(None, None, None)], "estimate double, lower double, upper double")
    draws = values.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("j"))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % n
    means = draws.withColumn("pos", at).join(v, "pos").groupBy("r").agg(of("value").alias("m"))
    tail = 1 - level if one_sided else (1 - level) / 2
    ends = means.agg(F.percentile("m", F.lit(tail)).alias("lower"), F.percentile("m", F.lit(1 - tail)).alias("upper"))
    if one_sided:
        ends = ends.withColumn("upper", F.lit(None).cast("double"))
    return v.agg(of("value").alias("estimate")).crossJoin(F.broadcast(ends))  # one row each


def non_inferior(lower: Column, margin: float) -> Column:
    return lower >= -margin - 1e-12


def pareto(points: DataFrame, speed: str, quality: str, key: str) -> DataFrame:
    """``points`` with on_frontier: no other point is at least as good in both and better in one.

    The best quality among faster points decides: prefix maxima over the distinct speeds, range by range,
    replace the comparison of all pairs.
    """
    tops, n = dealt(points.groupBy(speed).agg(F.max(quality).alias("_top")), [F.desc(speed)], "speeds")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    tops = tops.withColumn("_faster", F.max("_top").over(before(W.partitionBy("_range").orderBy(F.desc(speed)))))
    if n > 1:
        ranges = tops.groupBy("_range").agg(F.max("_top").alias("_m"))
        ranges = ranges.select("_range", F.max("_m").over(before(W.orderBy("_range"))).alias("_m"))  # MOST_RANGES rows at most
        tops = tops.join(F.broadcast(ranges), "_range").withColumn("_faster", F.greatest("_faster", "_m")).drop("_m")
    tops = tops.drop("_range")
    rows = points.join(tops, speed)
    good = (F.col(quality) == F.col("_top")) & (F.col("_faster").isNull() | (F.col(quality) > F.col("_faster")))
    return rows.withColumn("on_frontier", good).drop("_top", "_faster")


def recommended(points: DataFrame, speed: str, acceptable: Column, key: str) -> DataFrame:
    """The fastest acceptable point, the least key of equals."""
    return points.filter(acceptable).orderBy(F.desc(speed), key).limit(1)


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Every pair of classes with its count."""
    a = rows.select(F.col(actual).alias("c")).unionByName(rows.select(F.col(predicted).alias("c"))).distinct()
    grid = a.select(F.col("c").alias("actual")).crossJoin(F.broadcast(a.select(F.col("c").alias("predicted"))))  # classes are few
    n = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1, support and predicted count of each class; 0 where a denominator is 0."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    support = matrix.groupBy(F.col("actual").alias("c")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    got = matrix.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = support.join(got, "c").withColumn("precision", ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("c", "precision", "recall", "f1", "support", "predicted")


def macro_f1(matrix: DataFrame) -> DataFrame:
    return class_metrics(matrix).agg(F.avg("f1").alias("macro_f1"), (F.sum("support")).alias("n"))


def majority_baseline(rows: DataFrame, actual: str) -> DataFrame:
    return rows.groupBy(actual).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("accuracy"))


def class_codes(rows: DataFrame, column: str) -> DataFrame:
    """Classes to 0..C-1 by their text."""
    return rows.join(ordinal(rows.select(column).distinct(), [F.col(column).cast("string")], "code"), column)


def run_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, quartiles by linear interpolation, range and count of finite values."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = runs.filter(finite(F.col(value))).groupBy(*by).agg(q.alias("q"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))
    return rows.select(*by, F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "least", "most", "n")


def fold_means(rows: DataFrame, by: list[str], fold: str, value: str) -> DataFrame:
    """Mean over folds of fold means, and its standard error."""
    per = rows.groupBy(*by, fold).agg(F.avg(value).alias("m"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("folds"))


def paired(original: DataFrame, other: DataFrame, on: list[str], value: str) -> DataFrame:
    """Differences and speedups of runs that both sides have; raises if the keys differ."""
    both = original.select(*on, F.col(value).alias("before")).join(other.select(*on, F.col(value).alias("after")), on, "full_outer")
    if not both.filter("before is null or after is null").isEmpty():
        raise ValueError("the two sides do not have the same runs")
    return both.withColumn("saved", F.col("before") - F.col("after")).withColumn("speedup", F.col("before") / F.col("after"))


def tradeoff(original: Column, tokenized: Column, preparation: Column) -> list[Column]:
    """speedup, seconds saved, runs until the preparation has paid (infinite if nothing is saved)."""
    saved = original - tokenized
    return [(original / tokenized).alias("speedup"), saved.alias("seconds_saved"), F.when(saved > 0, preparation / saved).otherwise(float("inf")).alias("break_even")]


def grouped_costs(rows: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """Sums for each value of ``by`` and for all, in one pass; ``scope`` is 'all' for the total."""
    agg = [F.sum(c).alias(c) for c in sums]
    return rows.rollup(by).agg(F.grouping(by).alias("g"), *agg).select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col(by).cast("string")).alias("scope"), *sums)


def unpivot(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Cost columns to rows (component, bits, fraction of the sum)."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts])
    long = rows.withColumn("_t", total).select(*keys, "_t", F.explode(F.array(*[F.struct(F.lit(p).alias("component"), F.col(p).cast("double").alias("bits")) for p in parts])).alias("x"))
    return long.select(*keys, "x.component", "x.bits", F.when(F.col("_t") != 0, F.col("x.bits") / F.col("_t")).otherwise(0.0).alias("fraction"))


def task_manifest(spark, rule_counts: list[int], repeats: int, seed: int) -> DataFrame:
    """One task for each repeat and rule count; odd repeats run in reverse order."""
    counts = F.array(*[F.lit(c) for c in rule_counts])
    n = len(rule_counts)
    rows = spark.range(repeats).select(F.col("id").alias("repeat"), F.posexplode(counts).alias("i", "rule_count"))
    order = F.when(F.col("repeat") % 2 == 0, F.col("i")).otherwise(n - 1 - F.col("i"))
    kind = F.when(F.col("rule_count") == 0, "original").otherwise("tokenized")
    return rows.select((F.col("repeat") * n + order).alias("task_id"), "repeat", "rule_count", kind.alias("representation"), order.alias("order_position"), (F.lit(seed) + F.col("repeat")).alias("seed"))


def manifest_faults(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """(task_id, fault): missing, duplicate or unexpected results."""
    got = results.groupBy("task_id").agg(F.count("*").alias("n"))
    both = manifest.select("task_id", F.lit(1).alias("want")).join(got, "task_id", "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.select("task_id", fault.alias("fault")).filter("fault is not null")
