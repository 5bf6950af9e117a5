"""Property tests of the exact rounding helpers against Python arithmetic."""

from __future__ import annotations

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from hydrostar.functions.numeric import div_half_even, mean_half_even, py_round, ratio
from hydrostar.functions.text import fixed_text

PAIRS = st.lists(
    st.tuples(st.integers(0, 10**7), st.integers(1, 10**5)), min_size=1, max_size=40
)


def _half_up(fr: Fraction, digits: int) -> float:
    scaled = fr * 10**digits
    q, r = divmod(scaled.numerator, scaled.denominator)
    if 2 * r >= scaled.denominator:
        q += 1
    return q / 10**digits


def _half_even(a: int, b: int) -> int:
    q, r = divmod(a, b)
    if 2 * r > b or (2 * r == b and q % 2 == 1):
        q += 1
    return q


@settings(max_examples=15, deadline=None)
@given(PAIRS)
def test_ratio_is_exact_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [
        tuple(r)
        for r in df.select(ratio("a", "b", 2), ratio("a", "b", 2, 100.0), ratio("a", "b", 0)).collect()
    ]
    want = [
        (_half_up(Fraction(a, b), 2), _half_up(Fraction(100 * a, b), 2), _half_up(Fraction(a, b), 0))
        for a, b in pairs
    ]
    assert got == want


@settings(max_examples=15, deadline=None)
@given(PAIRS)
def test_half_even_division_and_means(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [tuple(r) for r in df.select(div_half_even("a", "b"), mean_half_even("a", "b", 1, 2)).collect()]
    want = [(_half_even(a, b), _half_even(a * 10, b) / 100) for a, b in pairs]
    assert got == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=40),
       st.integers(0, 3))
def test_py_round_and_text_match_python(spark, xs, digits):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [tuple(r) for r in df.select(py_round("x", digits), fixed_text("x", digits)).collect()]
    want = [(round(x, digits), f"{x:.{digits}f}") for x in xs]
    # -0.0 prints as "-0.0" in Python; Spark's sign handling gives "0.0"
    got = [(g, t.replace("-0.", "0.") if float(t) == 0 else t) for g, t in got]
    want = [(w, t.replace("-0.", "0.") if float(t) == 0 else t) for w, t in want]
    assert got == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 10**6).map(lambda k: k / 100), min_size=1, max_size=40))
def test_two_decimal_values_to_one_decimal_text(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(fixed_text("x", 1)).collect()]
    assert got == [f"{x:.1f}" for x in xs]
