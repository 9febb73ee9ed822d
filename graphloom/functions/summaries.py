"""Summaries of benchmark runs: null-aware deltas, points of a trade-off, enumeration totals, merged metrics, linear baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.stats import finite


def deltas(rows: DataFrame, on: list[str], side: str, before: str, after: str, values: list[str]) -> DataFrame:
    """Mean of each value on both sides and the difference; null where a side is missing or has a value that is not finite."""
    clean = lambda v: F.when(F.count("*") == F.count_if(finite(F.col(v).cast("double"))), F.avg(v))
    of = lambda s, t: rows.filter(F.col(side) == s).groupBy(*on).agg(*[clean(v).alias(f"{v}_{t}") for v in values])
    both = of(before, "before").join(of(after, "after"), on, "full_outer")
    return both.withColumns({f"{v}_delta": F.col(f"{v}_after") - F.col(f"{v}_before") for v in values})


def tradeoff_points(pairs: DataFrame, by: list[str], before: str, after: str, quality_before: str, quality_after: str) -> DataFrame:
    """For each point: medians of both times, their ratio, range of the speedups, how many are faster or slower, and how many are better, equal or worse."""
    speed, gain = F.col(before) / F.col(after), F.col(quality_after) - F.col(quality_before)
    return pairs.groupBy(*by).agg(
        F.median(before).alias("median_before"), F.median(after).alias("median_after"), (F.median(before) / F.median(after)).alias("ratio_of_medians"), F.median(speed).alias("median_speedup"), F.min(speed).alias("least_speedup"),
        F.max(speed).alias("most_speedup"), F.count_if(speed > 1).alias("faster"), F.count_if(speed < 1).alias("slower"), F.count_if(gain > 0).alias("better"), F.count_if(gain == 0).alias("equal"), F.count_if(gain < 0).alias("worse"), F.count("*").alias("n"),
    )


def enumeration_totals(occ: DataFrame) -> DataFrame:
    """Of each size: occurrences, distinct classes, most in one graph, graphs that have any."""
    per = occ.groupBy("size", "graph_id").agg(F.count("*").alias("n"))
    classes = occ.groupBy("size").agg(F.count_distinct("code").alias("classes"))
    return per.groupBy("size").agg(F.sum("n").alias("occurrences"), F.max("n").alias("most"), F.count("*").alias("graphs")).join(classes, "size")


def merge_metrics(metrics: DataFrame, original: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Metrics beside those of the original under the same keys, with what is kept of each."""
    right = original.select(*on, *[F.col(v).alias(f"original_{v}") for v in values])
    kept = lambda v: F.when(F.col(f"original_{v}") != 0, F.col(v) / F.col(f"original_{v}"))
    return metrics.join(right, on).withColumns({f"{v}_kept": kept(v) for v in values})


def preservation(rows: DataFrame, by: list[str], fold: str, value: str, speedup: str) -> DataFrame:
    """Mean over folds, its standard error, and the median speedup."""
    per = rows.groupBy(*by, fold).agg(F.avg(value).alias("m"))
    mean = per.groupBy(*by).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("folds"))
    return mean.join(rows.groupBy(*by).agg(F.median(speedup).alias("median_speedup")), by)


def top_by(rows: DataFrame, value: str, n: int, key: str) -> DataFrame:
    """The ``n`` rows of largest value, the least key of equals first."""
    return rows.orderBy(F.desc(value), key).limit(n)


def accountant_comparison(n: Column) -> list[Column]:
    """Analytic and integer code lengths of a positive integer, and of an edge set of that size among n + 1 nodes."""
    from graphloom.functions import codelength as C

    universe = C.simple_edge_universe(n + 1)
    return [C.positive_integer_bits(n).alias("analytic"), C.elias_delta_bits(n).cast("long").alias("integer"), C.log2_choose_fast(universe, n).alias("analytic_topology"), C.subset_bits(universe, n).alias("integer_topology")]


def linear_baseline(train: DataFrame, test: DataFrame, features: list[str], label: str, task: str = "classification") -> DataFrame:
    """``test`` with a prediction: balanced logistic regression or ridge regression over standardised columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    steps = [VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_s", withMean=True)]
    if task == "classification":
        count = train.groupBy(label).agg(F.count("*").alias("_c"))  # classes are few
        share = train.count() / F.lit(count.count()) / F.col("_c")
        train = train.join(F.broadcast(count), label).withColumn("_w", share)
        steps.append(LogisticRegression(featuresCol="_s", labelCol=label, weightCol="_w", regParam=1e-3))
    elif task == "regression":
        steps.append(LinearRegression(featuresCol="_s", labelCol=label, regParam=1.0, elasticNetParam=0.0))
    else:
        raise ValueError(f"unknown task {task!r}")
    out = Pipeline(stages=steps).fit(train).transform(test)
    return out.select(*test.columns, "prediction")


def validated(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule; rules that hold have no row."""
    broken = rows.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(name) for name, r in rules.items()])
    parts = [broken.select(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules]
    return reduce(DataFrame.unionByName, parts).filter("n > 0")
