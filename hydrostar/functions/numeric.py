"""Exact numeric helpers.

Two rounding rules meet in the reference: SQL ``ROUND`` (half away from
zero, applied to the decimal value) inside the queries, and the dashboard's
half-to-even rounding of means and of text output.  Spark's ``round`` on a
DOUBLE rounds the shortest decimal form half-up, which equals exact half-up
for the ratios of integers used here.  Means are formed from integers
(values scaled to whole units) so that ties are decided exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: ColumnOrName, den: ColumnOrName, digits: int, factor: float = 1.0) -> Column:
    """``ROUND(num * factor / den, digits)`` as DOUBLE; NULL when ``den`` is 0.

    ``try_divide`` keeps SQL's NULL-on-zero instead of an ANSI error.
    """
    scaled_num = _c(num).cast("double") * F.lit(float(factor))
    return F.round(F.try_divide(scaled_num, _c(den).cast("double")), digits)


def div_half_even(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Round ``a / b`` to an integer, ties to even, for integers a >= 0, b > 0.

    Pure integer arithmetic (``div`` and ``%``), so no binary fraction is
    involved.  NULL when ``b`` is 0 or NULL.
    """
    a, b = _c(a).cast("long"), _c(b).cast("long")
    b = F.when(b != 0, b)
    q = F.call_function("div", a, b)
    r2 = (a - q * b) * 2
    up = (r2 > b) | ((r2 == b) & (q % 2 == 1))
    return q + F.when(up, 1).otherwise(0)


def scaled(col: ColumnOrName, digits: int) -> Column:
    """A value already rounded to ``digits`` decimals, as whole units (BIGINT)."""
    return F.round(_c(col).cast("double") * F.lit(float(10**digits))).cast("long")


def mean_half_even(
    total_units: ColumnOrName, n: ColumnOrName, in_digits: int, out_digits: int
) -> Column:
    """Mean of values held as whole units of ``10**-in_digits``, rounded
    half-even to ``out_digits`` decimals, returned as DOUBLE.

    ``total_units`` is ``sum(scaled(x, in_digits))`` and ``n`` the count.
    """
    shift = out_digits - in_digits
    a, b = _c(total_units).cast("long"), _c(n).cast("long")
    if shift >= 0:
        a = a * F.lit(10**shift)
    else:
        b = b * F.lit(10 ** (-shift))
    return div_half_even(a, b).cast("double") / F.lit(float(10**out_digits))


def _split(x: Column) -> tuple[Column, Column]:
    # Veltkamp split: x == hi + lo exactly, each half with at most 26 bits.
    c = x * F.lit(134217729.0)
    hi = c - (c - x)
    return hi, x - hi


def py_round(x: ColumnOrName, digits: int) -> Column:
    """Round a DOUBLE to ``digits`` decimals exactly as Python's ``round``
    and ``format(x, '.nf')`` do: half to even, decided on the exact binary
    value (0.15 is stored below 0.15, so it gives 0.1).

    ``x * 10**digits`` is formed as an unevaluated sum ``p + err`` with an
    error-free product (Dekker), so the tie test sees the exact value.
    """
    x = _c(x).cast("double")
    ax = F.abs(x)
    m = float(10**digits)
    p = ax * F.lit(m)
    hi, lo = _split(ax)
    err = (hi * F.lit(m) - p) + lo * F.lit(m)
    f = F.floor(p).cast("double")
    r = p - f
    up = (r > 0.5) | ((r == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(f, F.lit(2.0)) == 1.0))))
    q = f + F.when(up, 1.0).otherwise(0.0)
    return F.when(x.isNull(), None).otherwise(F.signum(x) * q / F.lit(m))
