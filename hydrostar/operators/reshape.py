"""Shape changes: matrices, long form, hierarchy totals, stacked metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_matrix(
    df: DataFrame,
    index: str,
    columns: str,
    values: str,
    column_values: Sequence[object],
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Cross-tab ``index`` x ``columns`` holding ``values``; missing cells NULL.

    Like pandas' ``pivot``, two rows for one cell are an error, and so is a
    column value that is not listed: no row is dropped silently.  The listed
    ``column_values`` fix the output columns, so no job runs to find them.
    """
    names = list(names) if names is not None else [str(v) for v in column_values]
    key, value = F.col(columns), F.col(values)
    kind = df.schema[values].dataType
    listed = F.when(key.isin(list(column_values)), F.lit(True)).otherwise(
        F.raise_error(
            F.concat(F.lit(f"{columns} outside the listed values: "), key.cast("string"))
        ).cast("boolean")
    )
    cells = [
        F.when(F.count(F.when(key == F.lit(v), F.lit(1))) <= 1, F.max(F.when(key == F.lit(v), value)))
        .otherwise(F.raise_error(F.lit(f"two rows for {columns} {v}")).cast(kind))
        .alias(n)
        for v, n in zip(column_values, names)
    ]
    return df.filter(listed).groupBy(index).agg(*cells)


def long_form(
    df: DataFrame,
    ids: Sequence[str],
    measures: Sequence[str],
    name: str = "series",
    value: str = "value",
    cast: str | None = None,
) -> DataFrame:
    """Unpivot ``measures`` into (name, value) rows keyed by ``ids``."""
    cols = [F.col(m).cast(cast).alias(m) if cast else F.col(m) for m in measures]
    return df.select(*ids, *cols).unpivot(list(ids), list(measures), name, value)


def hierarchy_totals(
    df: DataFrame, levels: Sequence[str], measure: str, name: str | None = None
) -> DataFrame:
    """Leaf, intermediate and grand totals of ``measure`` over ``levels``
    (ROLLUP), with ``level`` = GROUPING_ID: 0 for leaves, all bits set for
    the grand total.  NULL level values stay apart from rolled-up NULLs."""
    return df.rollup(*levels).agg(
        F.grouping_id(*levels).alias("level"),
        F.sum(measure).cast("long").alias(name or measure),
    )


def stack_metrics(metrics: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Stack one-row, one-column DataFrames as (ord, metric, value)."""
    stacked = None
    for i, (label, df) in enumerate(metrics, start=1):
        row = df.select(
            F.lit(i).alias("ord"),
            F.lit(label).alias("metric"),
            F.col(df.columns[0]).cast("long").alias("value"),
        )
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked


def sum_all(df: DataFrame, measure: str, name: str | None = None) -> DataFrame:
    """One-row total of ``measure``."""
    return df.agg(F.sum(measure).cast("long").alias(name or measure))
