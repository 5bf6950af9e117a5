"""Sums of doubles that do not depend on the order of the rows.

A sum of doubles rounds after every addition, so its last bits change with
partitioning and retries.  Here every value is first cut into four whole
digits of 26 bits (remainders of exact scalings by powers of two, so no bit is
lost); the digits are summed as BIGINT, which is exact, through as many levels
of aggregation as wanted, and put together at the end in a fixed order.

Exact for values that are multiples of 2**-52 (finer parts are cut off, value
by value) and below 2**88 in size; a larger finite one fails.  A digit's sum
holds 2**37 rows of one group before BIGINT overflows, which under ANSI fails
instead of wrapping.  NaN and infinities are summed apart, as doubles (their sum
does not depend on the order either), and decide the result where they occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns are written as SQL text: one call each where building them from
# functions would take dozens.
BITS = 26
DIGITS = 4
LIMIT = 2.0**88
_BASE = f"{float(1 << BITS)!r}D"


def digit_names(name: str) -> list[str]:
    """The columns that stand for ``name``: its digits, and what is not finite."""
    return [f"{name}_{k}" for k in range(DIGITS)] + [f"{name}_x"]


def digits(value: str, name: str) -> list[Column]:
    """The four digits of a DOUBLE column as BIGINT columns, highest first,
    and the value itself where it is not finite; NULL has NULL in all."""
    v = f"CAST(`{value}` AS DOUBLE)"
    finite = f"abs({v}) < double('infinity')"
    large = f"CAST(raise_error('a value to sum exactly is not below {LIMIT}') AS DOUBLE)"
    rest = f"(CASE WHEN abs({v}) < {LIMIT!r}D THEN {v} WHEN {finite} THEN {large} END)"
    rest = f"({rest} / {_BASE})"
    out = []
    for _ in range(DIGITS):
        out.append(f"floor({rest})")
        rest = f"(({rest} - CAST(floor({rest}) AS DOUBLE)) * {_BASE})"
    out.append(f"CASE WHEN NOT {finite} THEN {v} END")
    return [F.expr(e).alias(n) for e, n in zip(out, digit_names(name))]


def sum_digits(name: str, weight: str | None = None) -> list[Column]:
    """Aggregates that sum digit columns, each row counted as often as the
    column ``weight`` says."""
    times = f" * `{weight}`" if weight else ""
    return [F.expr(f"sum({n}{times})").alias(n) for n in digit_names(name)]


def combined(name: str, within: Sequence[str] = ()) -> Column:
    """Digit sums as one DOUBLE; ``within`` names window partitions to sum
    over first.  Carries go up in whole numbers (an arithmetic shift is the floor of
    the division, also below zero), then the two halves are added, so equal
    sums give equal bits."""
    over = f" OVER (PARTITION BY {', '.join(f'`{c}`' for c in within)})" if within else ""
    a, b, c, d, other = (f"sum({n}){over}" if within else n for n in digit_names(name))
    mask = (1 << BITS) - 1
    c = f"({c} + shiftright({d}, {BITS}))"
    b = f"({b} + shiftright({c}, {BITS}))"
    low = f"(({c} & {mask}L) / {_BASE} + ({d} & {mask}L) / {_BASE} / {_BASE})"
    whole = f"(CAST({a} AS DECIMAL(20,0)) * {1 << BITS} + CAST({b} AS DECIMAL(20,0)))"
    return F.expr(f"coalesce({other}, CAST({whole} AS DOUBLE) + {low})")
