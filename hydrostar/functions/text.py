"""Text helpers: ordered pattern rules, labels and number formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrostar.functions.numeric import ColumnOrName, _c, py_round


def classify(col: ColumnOrName, rules: Sequence[tuple[str, object]], default: object) -> Column:
    """First matching ``LIKE`` pattern wins, ignoring case.

    The reference's store matches LIKE without regard to ASCII case, so
    ``ilike`` is used; the rules fold into one CASE expression.
    """
    c = _c(col)
    expr = None
    for pattern, label in rules:
        cond = c.ilike(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def bucket_label(col: ColumnOrName, bounds: Sequence[int], labels: Sequence[str]) -> Column:
    """``CASE WHEN col <= b0 THEN l0 WHEN col <= b1 THEN l1 ... ELSE last``.

    NULL compares false everywhere and so falls into the last label.
    """
    if len(labels) != len(bounds) + 1:
        raise ValueError("need one label more than bounds")
    c = _c(col)
    expr = None
    for bound, label in zip(bounds, labels):
        cond = c <= F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def substitute(col: ColumnOrName, old: str, new: str) -> Column:
    """Replace the exact text ``old`` by ``new``; NULL stays NULL."""
    c = _c(col)
    return F.when(c.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(c)


def cut_label(col: ColumnOrName, width: int, suffix: str = "...") -> Column:
    """First ``width`` characters followed by ``suffix`` (always added)."""
    return F.concat(F.substring(_c(col), 1, width), F.lit(suffix))


def thousands(col: ColumnOrName) -> Column:
    """Integer with comma grouping, e.g. 1,234,567."""
    return F.format_number(_c(col).cast("long"), 0)


def fixed_text(col: ColumnOrName, digits: int) -> Column:
    """``f"{x:.nf}"`` of a DOUBLE, with Python's exact half-even rounding."""
    c = _c(col)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", py_round(c, digits)))


def percent_text(col: ColumnOrName, digits: int = 1) -> Column:
    """``f"{x:.nf}%"``."""
    return F.concat(fixed_text(col, digits), F.lit("%"))
