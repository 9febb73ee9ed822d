"""Code lengths in bits as column expressions (no UDF but for exact big binomials)."""

from __future__ import annotations

from math import log, pi

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def positive_integer_bits(n: Column) -> Column:
    m = F.greatest(_d(n), F.lit(1.0))
    return F.log2(m) + F.log2(m + 1)


def sum_log2(first: Column, count: Column) -> Column:
    """Sum of log2(first + j) for j in 0..count-1; ``count`` is an integer."""
    return F.when(count > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), F.lit(0.0), lambda a, j: a + F.log2(_d(first) + j))).otherwise(F.lit(0.0))


def log2_factorial(n: Column) -> Column:
    return sum_log2(F.lit(1), n)


def log2_gamma(x: Column) -> Column:
    """log2 of the gamma function of a positive number in constant time: Stirling's series at x + 10, less the steps up to there."""
    x = _d(x)
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    steps = F.lit(1.0)
    for i in range(10):
        steps = steps * (x + i)
    return (series - F.log(steps)) / log(2)


def log2_choose_fast(n: Column, k: Column) -> Column:
    """Within 0..n; for many rows with large k, where a sum for each row would be quadratic."""
    return log2_gamma(n + 1) - log2_gamma(k + 1) - log2_gamma(n - k + 1)


def log2_choose(n: Column, k: Column) -> Column:
    """Infinite outside 0..n."""
    inside = sum_log2(n - k + 1, k) - log2_factorial(k)
    return F.when((k < 0) | (k > n), F.lit(float("inf"))).otherwise(inside)


def dirichlet_multinomial_bits(counts: Column, alphabet: Column) -> Column:
    """Of an array of counts under a symmetric Dirichlet of 1/2 for each of ``alphabet`` symbols; 0 without symbols.

    The gamma ratios are telescoped into sums, which stay exact for alphabets of any size a double can hold.
    """
    total = F.aggregate(counts, F.lit(0), lambda a, c: a + c.cast("int"))
    each = F.aggregate(counts, F.lit(0.0), lambda a, c: a + sum_log2(F.lit(0.5), c.cast("int")))
    return F.when(_d(alphabet) <= 0, F.lit(0.0)).otherwise(sum_log2(_d(alphabet) / 2, total) - each)


def edge_list_bits(degrees: Column, m: Column) -> Column:
    """Topology bits of ``m`` edges with an array of degrees."""
    each = F.aggregate(degrees, F.lit(0.0), lambda a, d: a + log2_factorial(d.cast("int")))
    m = m.cast("int")
    return F.when(m == 0, F.lit(0.0)).otherwise(log2_factorial(2 * m) - log2_factorial(m) - m - each)


def histogram(values: Column) -> Column:
    """Counts of the distinct values of an array."""
    return F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v)))


def base_bits(n: Column, m: Column, degrees: Column, label_counts: Column, edge_label_counts: Column, node_alphabet: Column, edge_alphabet: Column) -> Column:
    """Bits of a labelled graph: topology, labels, sizes and the degree histogram; ``degrees`` has isolated nodes too."""
    top = F.greatest(F.coalesce(F.array_max(degrees), F.lit(0)).cast("int"), F.lit(1))
    most = F.coalesce(F.array_max(degrees), F.lit(0)).cast("int")
    return (
        edge_list_bits(degrees, m) + dirichlet_multinomial_bits(label_counts, node_alphabet) + dirichlet_multinomial_bits(edge_label_counts, edge_alphabet)
        + positive_integer_bits(F.greatest(n, F.lit(1))) + positive_integer_bits(top) + dirichlet_multinomial_bits(histogram(degrees), most + 1)
    )


def bit_length(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0)).otherwise(F.length(F.bin(n.cast("long"))))


def ceil_log2(n: Column) -> Column:
    return bit_length(n.cast("long") - 1)


def elias_delta_bits(n: Column) -> Column:
    """Of a positive integer."""
    size = bit_length(n)
    return size + 2 * bit_length(size) - 2


def elias_delta_nonnegative_bits(n: Column) -> Column:
    return elias_delta_bits(n.cast("long") + 1)


def symbol_width(alphabet: Column) -> Column:
    return F.when(alphabet <= 1, F.lit(0)).otherwise(ceil_log2(alphabet))


def binomial(n: Column, k: Column) -> Column:
    """Exact while it fits into 38 digits."""
    k = F.least(k, n - k).cast("int")
    step = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(1).cast("decimal(38,0)"), lambda a, j: (a * (n - k + j).cast("decimal(10,0)") / j).cast("decimal(38,0)"))
    return step


def subset_bits(n: Column, k: Column) -> Column:
    """ceil(log2 C(n, k)), exactly, for any size: a vectorised UDF over Python integers, of distinct (n, k) best."""
    @F.pandas_udf("long")
    def exact(n: pd.Series, k: pd.Series) -> pd.Series:
        from math import comb

        return pd.Series([None if a is None or b is None or a != a or b != b else (comb(int(a), int(b)) - 1).bit_length() if 0 <= b <= a else None for a, b in zip(n, k, strict=True)], dtype="Int64")

    return exact(n, k)


def simple_edge_universe(n: Column) -> Column:
    return (n.cast("long") * (n.cast("long") - 1) / 2).cast("long")


def simple_topology_bits(n: Column, m: Column) -> Column:
    return subset_bits(simple_edge_universe(n), m)


def orbit_bits_log2(fixed_points: Column, order: Column, b: Column) -> Column:
    """log2 of the orbits of port strings of length ``b``: Burnside's mean over the automorphisms' fixed points, in log space. b <= 0: 0."""
    top = F.array_max(fixed_points)
    scaled = F.aggregate(fixed_points, F.lit(0.0), lambda a, f: a + F.when(f > 0, F.pow(_d(f) / top, b)).otherwise(F.lit(0.0)))
    return F.when(b <= 0, F.lit(0.0)).otherwise(b * F.log2(_d(top)) + F.log2(scaled) - F.log2(_d(order)))
