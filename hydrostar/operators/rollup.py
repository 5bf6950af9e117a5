"""Eager aggregation of the measurement fact, and the lattice of its grains.

Every fact query of the dashboard joins the fact to dimensions only to group
by dimension attributes and to count records, sum values and count distinct
keys.  Aggregating the fact to the grain the query needs *before* the joins
is exact (sums of per-group counts keep join multiplicities; distinct counts
are set functions) and moves the joins from fact size to dimension size.
The partial (map-side) aggregate also caps what a hot key can send through
the shuffle: one row per key per map task.

A grain's measures add up, so a coarser grain follows from any finer one:
``regroup`` derives it, and one stored fine grain serves every query that
groups by some of its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrostar.operators.exact_sum import digits, sum_digits

# The finest grain that the plant queries (Q6-Q10) group by.
GRAIN = ("plant_id", "parameter_id", "band_id", "year", "month")


def fact_rollup(
    measurement: DataFrame, keys: Sequence[str], where: Column | None = None
) -> DataFrame:
    """``measurement`` grouped by ``keys`` with

    * ``records``  = COUNT(measurement_id)  (non-NULL ids),
    * ``rows``     = COUNT(*),
    * ``analyses_0..3`` = SUM(value) in digits (``exact_sum``).

    Aggregates a query does not use are pruned by Catalyst.
    """
    fact = measurement if where is None else measurement.filter(where)
    return (
        fact.select("*", *digits("value", "analyses"))
        .groupBy(*keys)
        .agg(
            F.count("measurement_id").alias("records"),
            F.count(F.lit(1)).alias("rows"),
            *sum_digits("analyses"),
        )
    )


def regroup(grain: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """A coarser grain from a finer one, with the same measures."""
    rows = grain if where is None else grain.filter(where)
    return rows.groupBy(*keys).agg(
        F.sum("records").alias("records"), F.sum("rows").alias("rows"), *sum_digits("analyses")
    )


def table_count(df: DataFrame) -> Column:
    """``(SELECT COUNT(*) FROM df)`` as an uncorrelated scalar subquery.

    Reads no column of ``df``: Parquet answers it from row-group counts.
    """
    return df.agg(F.count(F.lit(1))).scalar()
