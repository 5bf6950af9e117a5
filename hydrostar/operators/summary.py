"""Group summaries with exact means, and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrostar.functions.numeric import mean_half_even, scaled


@dataclass(frozen=True)
class Agg:
    """One output column of :func:`summarise`.

    kind: ``sum`` | ``mean`` | ``std``.  ``digits`` is the number of decimals
    the input already has (it is held as whole units, so means are exact);
    ``out_digits`` the half-even rounding of the result.
    """

    name: str
    kind: str
    col: str
    digits: int = 0
    out_digits: int = 2


def _std(n: Column, s: Column, ss: Column, digits: int, out_digits: int) -> Column:
    # Sample standard deviation from integer moments: exact up to one sqrt.
    # n == 1 gives NULL (pandas: NaN).
    num = (n * ss - s * s).cast("double")
    den = (n * (n - 1)).cast("double")
    var_units = F.try_divide(num, F.when(den > 0, den))
    std = F.sqrt(var_units) / F.lit(float(10**digits))
    return F.rint(std * F.lit(float(10**out_digits))) / F.lit(float(10**out_digits))


def summarise(df: DataFrame, keys: Sequence[str], spec: Sequence[Agg]) -> DataFrame:
    """Per group of ``keys``: sums, half-even means and sample deviations.

    Means and deviations are taken over values scaled to whole units, so
    they do not depend on binary fractions or summation order.
    """
    work = df
    inner = []
    for a in spec:
        u = f"__u_{a.name}"
        work = work.withColumn(u, scaled(a.col, a.digits))
        inner += [
            F.count(u).alias(f"{u}_n"),
            F.sum(u).alias(f"{u}_s"),
            F.sum(F.col(u) * F.col(u)).alias(f"{u}_ss"),
        ]
    grouped = work.groupBy(*keys).agg(*inner)
    outs = []
    for a in spec:
        u = f"__u_{a.name}"
        n, s, ss = F.col(f"{u}_n"), F.col(f"{u}_s"), F.col(f"{u}_ss")
        if a.kind == "sum":
            col = s if a.digits == 0 else s.cast("double") / F.lit(float(10**a.digits))
        elif a.kind == "mean":
            col = mean_half_even(s, n, a.digits, a.out_digits)
        elif a.kind == "std":
            col = _std(n, s, ss, a.digits, a.out_digits)
        else:
            raise ValueError(a.kind)
        outs.append(col.alias(a.name))
    return grouped.select(*keys, *outs)


def box_stats(df: DataFrame, group: str, value: str, digits: int) -> DataFrame:
    """Box-plot statistics per ``group`` of a column held at ``digits``
    decimals: n, quartiles by the Hazen rule (position n*p + 0.5, linear
    interpolation, clamped to the ends; the median is the usual one),
    whisker ends (the most extreme values within 1.5 IQR of the box) and the
    number of outliers beyond them.  NULL values are ignored.

    All arithmetic is on whole units: quartiles are exact multiples of a
    quarter unit, and the fence tests are integer comparisons.

    The rows are first reduced to (group, value, count); every later step is
    a window over one group's *distinct* values, so after that one shuffle
    by group no further exchange is needed.  Callers pass grouped results
    (here: months per region), so a group's distinct values are few.
    """
    m = 10**digits
    counted = (
        df.filter(F.col(value).isNotNull())
        .select(F.col(group), scaled(value, digits).alias("u"))
        .groupBy(group, "u")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    in_group = Window.partitionBy(group)
    running = in_group.orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counted.withColumn("hi", F.sum("c").over(running))
        .withColumn("lo", F.col("hi") - F.col("c") + 1)
        .withColumn("n", F.sum("c").over(in_group))
    )
    n = F.col("n")

    def at(pos: F.Column) -> F.Column:
        # value at 1-based position ``pos`` of the sorted group
        return F.max(F.when((F.col("lo") <= pos) & (pos <= F.col("hi")), F.col("u"))).over(in_group)

    for tag, p4 in (("q1", 1), ("median", 2), ("q3", 3)):
        # 4 * clamp(n * p + 1/2, 1, n) with p = p4 / 4; quartile in quarter units
        h4 = F.least(F.greatest(n * p4 + 2, F.lit(4)), n * 4)
        k = F.call_function("div", h4, F.lit(4))
        a, b = at(k), at(F.least(k + 1, n))
        ranked = ranked.withColumn(f"{tag}_4", a * 4 + (h4 % 4) * (b - a))
    # Fences in eighth units: 8*q1 - 12*IQR ... 8*q3 + 12*IQR (1.5 IQR).
    iqr4 = F.col("q3_4") - F.col("q1_4")
    inside = (F.col("u") * 8 >= F.col("q1_4") * 2 - iqr4 * 3) & (
        F.col("u") * 8 <= F.col("q3_4") * 2 + iqr4 * 3
    )
    q = float(4 * m)
    return ranked.groupBy(group).agg(
        F.max("n").cast("long").alias("n"),
        (F.max("q1_4") / F.lit(q)).alias("q1"),
        (F.max("median_4") / F.lit(q)).alias("median"),
        (F.max("q3_4") / F.lit(q)).alias("q3"),
        (F.min(F.when(inside, F.col("u"))) / F.lit(float(m))).alias("lower_whisker"),
        (F.max(F.when(inside, F.col("u"))) / F.lit(float(m))).alias("upper_whisker"),
        F.sum(F.when(~inside, F.col("c")).otherwise(0)).cast("long").alias("outliers"),
    )
