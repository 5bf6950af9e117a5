"""Selector options and optional equality filters (interactive filtering)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrostar.operators.joins import literal_table


def options(
    df: DataFrame, specs: Sequence[tuple[str, Sequence[str], str]]
) -> DataFrame:
    """Selector entries of one or more fields, in first-appearance order.

    ``specs`` lists (field, first_seen, all_label): ``first_seen`` are the
    leading sort keys of ``df``'s order that decide where a value first
    appears (its minimum per value).  Returns (field, ord, option), ord 0
    being the "all" entry.  All fields come from one pass over ``df``: the
    values are stacked, reduced to their first key, and numbered by a
    window per field over its distinct values.
    """
    width = max(len(keys) for _, keys, _ in specs)

    def key(cols: Sequence[str]) -> Column:
        parts = [F.col(c).cast("string") for c in cols]
        parts += [F.lit(None).cast("string")] * (width - len(parts))
        return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])

    entries = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"),
                F.col(field).cast("string").alias("option"),
                key(keys).alias("first"),
            )
            for field, keys, _ in specs
        ]
    )
    firsts = (
        df.select(F.inline(entries))
        .groupBy("field", "option")
        .agg(F.min("first").alias("first"))
    )
    numbered = firsts.select(
        "field",
        F.row_number().over(Window.partitionBy("field").orderBy("first", "option")).alias("ord"),
        "option",
    )
    heads = literal_table(
        df.sparkSession,
        [(field, 0, label) for field, _, label in specs],
        "field STRING, ord INT, option STRING",
    )
    return heads.unionByName(numbered)


def filter_by_choice(df: DataFrame, choices: Mapping[str, object | None]) -> DataFrame:
    """Keep rows equal to each chosen value; ``None`` means "all"."""
    out = df
    for col, value in choices.items():
        if value is not None:
            out = out.filter(F.col(col) == F.lit(value))
    return out
