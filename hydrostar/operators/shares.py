"""Shares of a total and grouped activity counts."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrostar.functions.numeric import ratio


def share_of_total(
    df: DataFrame,
    measure: str,
    total: Column | Sequence[str],
    digits: int = 2,
    name: str = "pct",
) -> DataFrame:
    """Add ``name = ROUND(measure * 100 / total, digits)``.

    ``total`` is either a scalar Column (e.g. ``table_count(...)`` or
    ``sum_of(df, measure)``: a denominator fixed outside ``df``) or a list of
    partition keys (the sum of ``measure`` within each partition of the
    already aggregated ``df``).
    """
    if isinstance(total, Column):
        denominator = total
    else:
        denominator = F.sum(measure).over(Window.partitionBy(*total))
    return df.withColumn(name, ratio(measure, denominator, digits, 100.0))


def sum_of(df: DataFrame, measure: str) -> Column:
    """``(SELECT SUM(measure) FROM df)`` as a scalar subquery."""
    return df.agg(F.sum(measure)).scalar()


def activity_by(
    rows: DataFrame,
    keys: Sequence[str],
    distinct: Mapping[str, str],
    records: str | None = "records",
    name: str = "measurements",
    having: Column | None = None,
    dense: Collection[str] = (),
) -> DataFrame:
    """Group pre-aggregated fact rows by ``keys``.

    ``distinct`` maps output names to key columns counted with exact
    COUNT(DISTINCT); ``name`` is the record count (sum of ``records``),
    left out when ``records`` is None.
    ``having`` filters the aggregated rows.  Where all counted columns are
    ``dense`` ids, they are counted by bitmaps.
    """
    if distinct and set(distinct.values()) <= set(dense):
        out = _by_bitmaps(rows, keys, distinct, records, name)
        return out if having is None else out.filter(having)
    aggs = [F.count_distinct(F.col(col)).alias(alias) for alias, col in distinct.items()]
    if records is not None:
        aggs.append(F.sum(records).cast("long").alias(name))
    out = rows.groupBy(*keys).agg(*aggs)
    return out if having is None else out.filter(having)


def activity_by_owner(
    rows: DataFrame,
    keys: Sequence[str],
    distinct: Mapping[str, str],
    owner: str,
    records: str = "records",
    name: str = "measurements",
    having: Column | None = None,
) -> DataFrame:
    """``activity_by`` for rows that lie together by ``owner``, whose attributes
    among ``keys`` are its own (one value an owner), counting owners and one
    more column.

    Owners are counted where they lie, by their first row in each group; the
    other column by one shuffle of its distinct values a group.  So what travels
    is at most one narrow row a row, however the ids are spread."""
    (owners,) = (alias for alias, col in distinct.items() if col == owner)
    ((others, other),) = ((alias, col) for alias, col in distinct.items() if col != owner)
    first = F.row_number().over(Window.partitionBy(owner, *keys).orderBy(other)) == 1
    out = (
        rows.filter(F.col(owner).isNotNull())
        .select(*keys, other, records, first.cast("long").alias(owners))
        .groupBy(*keys, other)
        .agg(F.sum(owners).alias(owners), F.sum(records).alias(name))
        .groupBy(*keys)
        .agg(
            *[
                F.sum(owners).alias(owners) if alias == owners else F.count(other).alias(others)
                for alias in distinct
            ],
            F.sum(name).alias(name),
        )
    )
    return out if having is None else out.filter(having)


def _by_bitmaps(
    rows: DataFrame,
    keys: Sequence[str],
    distinct: Mapping[str, str],
    records: str | None,
    name: str,
) -> DataFrame:
    """The same counts from bitmaps: an id is one bit of a 4 KB block, blocks
    of equal (group, column, block number) merge before the shuffle, and the
    bits are counted at the end.  What travels is at most a bit an id and
    group, in place of a row a distinct (group, id); nothing is expanded
    into grouping sets.  Blocks merge by OR, so partial results stay mergeable.
    """
    kinds = list(distinct.values())
    each = [
        F.struct(
            F.lit(k).alias("kind"),
            F.bitmap_bucket_number(c).alias("block"),
            F.bitmap_bit_position(c).alias("bit"),
            (F.col(records) if records and not k else F.lit(0).cast("long")).alias("n"),
        )
        for k, c in enumerate(kinds)
    ]
    # A NULL id has no bit but its rows count.
    blocks = (
        rows.select(*keys, F.inline(F.array(*each)))
        .groupBy(*keys, "kind", "block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"), F.sum("n").alias("n"))
    )
    bits = F.when(F.col("block").isNotNull(), F.bitmap_count("bits")).otherwise(0)
    aggs = [
        F.sum(F.when(F.col("kind") == k, bits).otherwise(0)).alias(alias)
        for k, alias in enumerate(distinct)
    ]
    if records is not None:
        aggs.append(F.sum("n").cast("long").alias(name))
    return blocks.groupBy(*keys).agg(*aggs)
