"""Repeated dimension rows and a hot key, against brute-force SQL.

The same hand-made rows go to Spark and to DuckDB; DuckDB runs the
dashboard-style SQL (plain multiplying joins).  The engine's weighted joins
and fact pre-aggregation must give identical results.
"""

from __future__ import annotations

import math
import random

import duckdb
import pytest

from hydrostar import oracle as O
from hydrostar.plans import base
from hydrostar.plans import params as P
from hydrostar.sources.schema import SCHEMAS
from tests.frames import bundle


def _data():
    rnd = random.Random(7)
    region = [(1, "North"), (2, "South"), (2, "South")]  # a copied region row
    state = [(s, 1 + s % 2, f"S{s}", f"State {s}") for s in range(1, 5)] + [(3, 2, "S3", "State 3")]
    municipality = [(m, 1 + m % 4) for m in range(1, 13)] + [(5, 2)] * 3  # municipality 5 x4
    office = [(o, 1 + o % 3) for o in range(1, 13)] + [(7, 2), (7, 2)]
    institution = [(i, f"Inst {i}", "T" if i % 2 else "U") for i in range(1, 4)] + [(2, "Inst 2", "U")]
    plant = [
        (p, 1 + p % 12, None if p % 9 == 0 else 1 + p % 12, ["A", "B", "", None][p % 4])
        for p in range(1, 41)
    ]
    plant += [(1, 2, 2, "B")] * 5  # the hot plant is also copied
    point = [(k, f"T{k % 3}", f"P{k % 5}") for k in range(1, 9)] + [(4, "T1", "P4")] * 2
    names = ["pH", "Cor (uH)", "Cloro Residual Livre (mg/L)", "Turbidez", None, ""]
    parameter = [(k, names[k % 6], ["mg", "None", None][k % 3], f"C{k % 2}") for k in range(1, 13)]
    parameter += [(3, names[3], "mg", "C1")] * 4  # parameter 3 x5
    band = [(1, P.BAND_PAIRS[0][1]), (2, P.BAND_PAIRS[1][1]), (3, P.BAND_PAIRS[3][1]),
            (4, P.BAND_PAIRS[5][1]), (5, P.BAND_PAIRS[6][1])]
    measurement = []
    for i in range(1, 1500):
        plant_id = 1 if i % 3 == 0 else rnd.randint(1, 45)  # a third on plant 1
        measurement.append((
            i if i % 50 else None,
            plant_id,
            None if i % 17 == 0 else rnd.randint(1, 9),
            None if i % 13 == 0 else rnd.randint(1, 13),
            rnd.randint(1, 5),
            float(rnd.randint(0, 9)),
            None if i % 97 == 0 else rnd.randint(1, 12),
            rnd.choice([2024, 2025]),
        ))
    return dict(region=region, state=state, municipality=municipality, office=office,
                institution=institution, plant=plant, point=point, parameter=parameter,
                band=band, measurement=measurement)


@pytest.fixture(scope="module")
def data():
    return _data()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for name, schema in SCHEMAS.items():
        cols = ", ".join(
            f"{f.name} {'BIGINT' if f.dataType.typeName() == 'long' else 'INTEGER' if f.dataType.typeName() == 'integer' else 'DOUBLE' if f.dataType.typeName() == 'double' else 'VARCHAR'}"
            for f in schema.fields
        )
        c.execute(f"CREATE TABLE f_{name} ({cols})")
        if data[name]:
            marks = ", ".join("?" for _ in schema.fields)
            c.executemany(f"INSERT INTO f_{name} VALUES ({marks})", data[name])
    return c


def _sql(parts) -> str:
    ctes, select, order = parts
    head = ("WITH " + ",\n".join(c.strip() for c in ctes) + "\n") if ctes else ""
    return f"{head}{select}\nORDER BY {order}"


def _norm(r):
    return tuple(None if isinstance(v, float) and math.isnan(v) else
                 round(v, 9) if isinstance(v, float) else v for v in r)


CASES = {
    "Q1": (base.filtration_share, {}, O.q1_filtration_share()),
    "Q3": (base.state_coverage, {}, O.q3_state_coverage()),
    "Q4": (base.point_volume, {}, O.q4_point_volume()),
    "Q5": (base.parameter_volume, {}, O.q5_parameter_volume()),
    "Q6": (base.geo_activity, {}, O.q6_geo_activity()),
    "Q7": (base.institution_performance, {"min_measurements": 10},
           O.q7_institution_performance(10)),
    "Q8": (base.band_distribution, {"min_records": 3}, O.q8_band_distribution(P.BAND_PAIRS, 3)),
    "Q9": (base.state_ranking, {"min_plants": 2}, O.q9_state_ranking(2)),
    "Q10": (base.monthly_evolution, {"min_measurements": 5},
            O.q10_monthly_evolution(2025, 5, P.PERIOD_BOUNDS, P.PERIOD_LABELS)),
    "Q11": (base.kpi_summary, {}, O.q11_kpi_summary(P.KPI_NAMES)),
}


@pytest.mark.parametrize("qid", sorted(CASES))
def test_weighted_joins_match_multiplying_sql(spark, data, con, qid):
    fn, kw, parts = CASES[qid]
    got = [_norm(r) for r in fn(bundle(spark, **data), **kw).collect()]
    want = [_norm(r) for r in con.sql(_sql(parts)).fetchall()]
    assert got, "case must keep rows"
    assert got == want
