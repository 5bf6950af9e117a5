"""Sums of doubles: exact against fractions, equal bits in any partitioning."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hydrostar.operators.exact_sum import combined, digits, sum_digits
from hydrostar.plans import base
from hydrostar.plans import params as P
from hydrostar.sources.tables import tables_from_frames
from tests.frames import bundle
from tests.test_copies import _data


def total(spark, values, parts=1):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
    sums = df.select(*digits("v", "s")).agg(*sum_digits("s")).select(combined("s").alias("x"))
    return sums.first()[0]


def test_exact_against_fractions(spark):
    rnd = random.Random(5)
    values = [rnd.choice([-1, 1]) * rnd.randrange(1 << 52) / 2 ** rnd.randrange(52) for _ in range(500)]
    values += [2.0**80, -(2.0**80), 1e15, 0.1, -0.1, 0.0, -0.0, 2.0**-52, -(2.0**-52)]
    cut = sum(Fraction(math.floor(Fraction(v) * 2**52), 2**52) for v in values)
    got = total(spark, values, 7)
    assert abs(Fraction(got) - cut) <= Fraction(math.ulp(float(cut))) * 2


def test_same_bits_in_any_order(spark):
    rnd = random.Random(6)
    values = [rnd.uniform(-1e6, 1e6) for _ in range(2000)] + [1e17, 3.3, -1e17]
    shuffled = rnd.sample(values, len(values))
    found = {total(spark, v, n).hex() for v in (values, shuffled) for n in (1, 3, 16)}
    assert len(found) == 1


def test_nulls_whole_numbers_and_bad_values(spark):
    assert total(spark, [None, None]) is None
    assert total(spark, [None, 3.0, 4.0]) == 7.0
    assert total(spark, [-3.5, 1.25]) == -2.25
    assert math.isnan(total(spark, [1.0, math.nan]))
    assert total(spark, [1.0, -math.inf, 5.0], 3) == -math.inf
    assert math.isnan(total(spark, [math.inf, 2.0, -math.inf], 3))
    with pytest.raises(Exception, match="sum exactly"):
        total(spark, [1.0, 1e30])


def test_band_query_has_equal_bits_under_any_partitioning(spark):
    data = _data()
    rnd = random.Random(3)
    data["measurement"] = [(*m[:5], rnd.uniform(0, 10) / 3, *m[6:]) for m in data["measurement"]]
    want = None
    t = bundle(spark, **data)
    frames = {n: getattr(t, n) for n in data}
    for parts in (1, 5, 13):
        fact = frames["measurement"].repartition(parts, F.rand(parts))
        moved = tables_from_frames(frames | {"measurement": fact})
        found = base.band_distribution(moved, min_records=3).collect()
        bits = [(r.filtration_type, r.parameter_name, r.band_name, r.analyses.hex(), r.pct.hex()) for r in found]
        want = want or bits
        assert bits == want and len(bits) > 3
    kept = {b for _, b in P.BAND_PAIRS}
    assert {r[2] for r in want} <= kept
