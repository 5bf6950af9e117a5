"""Hand-made edge frames, one group per non-standard rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hydrostar.plans import base, derived
from hydrostar.plans import params as P
from hydrostar.sources.tables import conform
from tests.frames import bundle, geo


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1, 2: case-blind ordered LIKE rules, and a sort rank from another list ----------
def test_purpose_rules_and_sort_rank(spark):
    names = ["pH", "ph total", "COLIFORMES", "Cloro Residual Livre (mg/L)", "Cor (uH)", None, "", " "]
    t = bundle(spark, parameter=[(i, n, "u", "c") for i, n in enumerate(names)])
    got = rows(base.parameter_purpose(t))
    assert got == [
        ("Cloro Residual Livre (mg/L)", "u", "Desinfecção"),
        ("pH", "u", "Equilíbrio Químico"),
        ("ph total", "u", "Equilíbrio Químico"),
        ("COLIFORMES", "u", "Segurança Microbiológica"),
        (" ", "u", "Outros Indicadores"),
        ("Cor (uH)", "u", "Aspecto Físico"),
    ]


# 3, 14: denominators of all rows; blanks, NULLs and orphans ---------------------
def test_filtration_share_denominator_includes_blanks(spark):
    plant = [(1, 1, 1, "A"), (2, 1, 1, "A"), (3, 1, 1, "B"), (4, 1, 1, ""), (5, 1, 1, None)]
    t = bundle(spark, plant=plant)
    assert rows(base.filtration_share(t)) == [("A", 2, 40.0), ("B", 1, 20.0)]
    assert rows(derived.filtration_total(base.filtration_share(t))) == [(3, "3")]


def test_point_volume_counts_orphans_in_total_only(spark):
    point = [(1, "T1", "alpha"), (2, "T2", "alpha")]
    meas = [
        (1, 1, 1, 1, 1, 1.0, 1, 2025),
        (2, 1, 1, 1, 1, 1.0, 1, 2025),
        (3, 1, 2, 1, 1, 1.0, 1, 2025),
        (4, 1, None, 1, 1, 1.0, 1, 2025),  # no point
        (5, 1, 9, 1, 1, 1.0, 1, 2025),  # orphan point
    ]
    t = bundle(spark, point=point, measurement=meas)
    assert rows(base.point_volume(t)) == [("T1", "alpha", 2, 40.0), ("T2", "alpha", 1, 20.0)]
    # the name-only regrouping merges the two types and shares the shown sum
    assert rows(derived.point_name_share(base.point_volume(t))) == [("alpha", 3, 100.0)]


# 4, 5: band dropped by HAVING still counts in the total; zero total -> NULL ----
def test_band_share_total_before_having_and_zero_total(spark):
    plant = [(1, 1, 1, "F1"), (2, 1, 1, "F2"), (3, 1, 1, None)]
    parameter = [(10, "pH", "u", "c"), (11, "Other", "u", "c")]
    band = [(1, "lo"), (2, "hi"), (3, "mid")]
    meas = []
    mid = 100
    for i in range(3):  # F1/pH/lo: 3 records, 30 analyses
        meas.append((mid + i, 1, 1, 10, 1, 10.0, 1, 2025))
    meas.append((200, 1, 1, 10, 2, 10.0, 1, 2025))  # F1/pH/hi: 1 record (dropped)
    meas.append((201, 1, 1, 11, 1, 99.0, 1, 2025))  # not a listed parameter
    for i in range(2):  # F2/pH/lo: zero analyses
        meas.append((300 + i, 2, 1, 10, 1, 0.0, 1, 2025))
    meas.append((400, 3, 1, 10, 1, 5.0, 1, 2025))  # NULL filtration: dropped
    t = bundle(spark, plant=plant, parameter=parameter, band=band, measurement=meas)
    pairs = [("pH", "lo"), ("pH", "hi")]
    got = rows(base.band_distribution(t, band_pairs=pairs, min_records=2))
    assert got == [("F1", "pH", "lo", 30.0, 1, 75.0), ("F2", "pH", "lo", 0.0, 1, None)]


# 6, 7, 8: rounding ties --------------------------------------------------------
def test_half_up_ratios_and_half_even_means(spark):
    from hydrostar.functions.numeric import div_half_even, mean_half_even, ratio

    df = spark.createDataFrame([(1, 8), (1, 16), (3, 800), (5, 0)], "a long, b long")
    got = rows(
        df.select(
            ratio("a", "b", 2).alias("r"),
            ratio("a", "b", 2, 100.0).alias("pct"),
        )
    )
    assert got == [(0.13, 12.5), (0.06, 6.25), (0.0, 0.38), (None, None)]
    means = spark.createDataFrame([(1, 8), (5, 2), (7, 2), (9, 2)], "s long, n long")
    got = rows(
        means.select(
            mean_half_even("s", "n", 0, 2).alias("m2"),
            div_half_even("s", "n").alias("m0"),
        )
    )
    assert got == [(0.12, 0), (2.5, 2), (3.5, 4), (4.5, 4)]


@pytest.mark.parametrize(
    "x", [0.15, 0.25, 0.35, 0.45, 2.675, 1.005, 0.05, 12.25, 99.95, 0.0, 7.0, 1234.5678, 0.125]
)
def test_fixed_text_matches_python(spark, x):
    from hydrostar.functions.text import fixed_text

    df = spark.range(1).select(F.lit(x).alias("x"))
    for d in (0, 1, 2):
        assert df.select(fixed_text("x", d)).first()[0] == f"{x:.{d}f}"


# 9: NULL month falls into the last period -------------------------------------
def test_period_labels(spark):
    from hydrostar.functions.text import bucket_label

    df = spark.createDataFrame([(m,) for m in (1, 2, 3, 4, 5, 12, None)], "m int")
    got = [r[0] for r in df.select(bucket_label("m", P.PERIOD_BOUNDS, P.PERIOD_LABELS)).collect()]
    assert got == [
        "Início do Ano",
        "Início do Ano",
        "Meio do Ano",
        "Meio do Ano",
        "Segundo Semestre",
        "Segundo Semestre",
        "Segundo Semestre",
    ]


# 10, 11: NULL group keys dropped by the pandas layer; 'None' unit ---------------
def test_null_region_dropped_and_unit_substitution(spark):
    q6 = spark.createDataFrame(
        [("North", "S1", 1, 2, 10, 5.0), (None, "S2", 1, 1, 7, 7.0), ("North", "S3", 2, 2, 4, 2.0)],
        "region_name string, state_code string, municipalities long, plants long, "
        "measurements long, measurements_per_plant double",
    )
    assert rows(derived.region_share(q6)) == [("North", 14, 100.0)]
    assert rows(derived.regional_summary(q6)) == [("North", 14, 4, 3.5, 3)]
    q2 = spark.createDataFrame(
        [("a", "None", "X"), ("b", None, "X"), ("c", "mg", "Y")],
        "parameter_name string, unit string, purpose string",
    )
    assert rows(derived.purpose_detail(q2)) == [
        ("X", 2, "a", "Qualitativo"),
        ("X", 2, "b", None),
        ("Y", 1, "c", "mg"),
    ]


# Display order: first appearance in the base result, not the alphabet -----------
def test_first_appearance_orders(spark):
    q2 = spark.createDataFrame(
        [("zinc", "u", "A"), ("cloro", "u", "Z"), ("pH", "u", "M"), ("brom", "u", "A")],
        "parameter_name string, unit string, purpose string",
    )
    got = [(r[0], r[2]) for r in derived.purpose_detail(q2).collect()]
    assert got == [("Z", "cloro"), ("M", "pH"), ("A", "brom"), ("A", "zinc")]
    q8 = spark.createDataFrame(
        [("F1", "pH", "lo", 1.0), ("F2", "Cor", "lo", 2.0), ("F2", "pH", "lo", 3.0), ("F1", "pH", "mid", 4.0)],
        "filtration_type string, parameter_name string, band_name string, pct double",
    )
    got = [(r[0], r[1], r[2]) for r in derived.band_series(q8).collect()]
    assert got == [("pH", "F1", "mid"), ("pH", "F1", "lo"), ("pH", "F2", "lo"), ("Cor", "F2", "lo")]
    q3 = spark.createDataFrame(
        [("A", "a", 1, 1), ("Z", "z", 9, 3)],
        "state_code string, state_name string, plants long, municipalities long",
    )
    assert rows(derived.coverage_dual_axis(q3)) == [
        ("Z", "plants", 9), ("Z", "municipalities", 3), ("A", "plants", 1), ("A", "municipalities", 1),
    ]


# Heatmap: a second row for a cell, or an unlisted month, fails -------------------
def test_heatmap_loses_nothing(spark):
    kind = "region_name string, month int, intensity double"
    good = spark.createDataFrame([("N", 1, 1.5), ("N", 12, 2.5), ("S", 3, None)], kind)
    got = {r[0]: [v for v in r[1:] if v is not None] for r in derived.intensity_heatmap(good).collect()}
    assert got == {"N": [1.5, 2.5], "S": []}
    for bad in ([("N", 1, 1.0), ("N", 1, 2.0)], [("N", 13, 1.0)]):
        with pytest.raises(Exception, match="two rows|outside"):
            derived.intensity_heatmap(spark.createDataFrame(bad, kind)).collect()


# One row per point beyond the whiskers ---------------------------------------
def test_outlier_rows(spark):
    data = [("out", m, v) for m, v in enumerate((1.0, 1.1, 1.2, 1.3, 9.9), 1)] + [("in", 1, 5.0)]
    q10 = spark.createDataFrame(data, "region_name string, month int, intensity double")
    assert rows(derived.intensity_outliers(q10)) == [("out", 5, 9.9)]


# Q8: NULL record ids count as zero records, the group stays ------------------------
def test_band_null_ids_keep_their_group(spark):
    t = bundle(
        spark,
        plant=[(1, 1, 1, "F1")],
        parameter=[(10, "pH", "u", "c")],
        band=[(1, "lo")],
        measurement=[(None, 1, 1, 10, 1, 4.0, 1, 2025)],
    )
    got = rows(base.band_distribution(t, band_pairs=[("pH", "lo")], min_records=0))
    assert got == [("F1", "pH", "lo", 4.0, 1, 100.0)]


# 12: Hazen quartiles, whiskers and outliers -------------------------------------
def test_box_stats(spark):
    from hydrostar.operators.summary import box_stats

    data = [("n1", 3.0)]
    data += [("n2", 1.0), ("n2", 2.0)]
    data += [("n5", v) for v in (1.0, 2.0, 4.0, 8.0, 16.0)]
    data += [("out", v) for v in (1.0, 1.1, 1.2, 1.3, 9.9)] + [("out", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r[0]: tuple(r[1:]) for r in box_stats(df, "g", "v", 1).collect()}
    assert got["n1"] == (1, 3.0, 3.0, 3.0, 3.0, 3.0, 0)
    assert got["n2"] == (2, 1.0, 1.5, 2.0, 1.0, 2.0, 0)
    assert got["n5"] == (5, 1.75, 4.0, 10.0, 1.0, 16.0, 0)
    # positions 1.75, 3, 4.25 -> 1.075, 1.2, 3.45; upper fence 7.0125 leaves 9.9 out
    assert got["out"] == (5, 1.075, 1.2, 3.45, 1.0, 1.3, 1)


# 13: ties at rank k are cut by the tie-breaker, deterministically ---------------
def test_top_k_ties(spark):
    q3 = spark.createDataFrame(
        [("S3", "c", 5, 1, 5.0), ("S1", "a", 5, 1, 5.0), ("S2", "b", 5, 1, 5.0), ("S4", "d", 9, 1, 9.0)],
        "state_code string, state_name string, plants long, municipalities long, "
        "plants_per_municipality double",
    )
    assert [r[0] for r in derived.top_states(q3, k=3).collect()] == ["S4", "S1", "S2"]


# 15: text in numeric columns becomes NULL on ingestion ---------------------------
def test_conform_try_cast(spark):
    raw = spark.createDataFrame(
        [("1", "7", "3", "1", "1", "3", "1", "2025"), ("2", "7", "x", "1", "1", "abc", "1", "2025")],
        ", ".join(f"{c} string" for c in
                  "measurement_id plant_id point_id parameter_id band_id value month year".split()),
    )
    got = rows(conform(raw, "measurement").select("point_id", "value"))
    assert got == [(3, 3.0), (None, None)]


# sample deviation of one row is NULL ----------------------------------------
def test_std_one_row_is_null(spark):
    from hydrostar.operators.summary import Agg, summarise

    df = spark.createDataFrame([("a", 1.5), ("b", 1.0), ("b", 2.0)], "g string, x double")
    got = {r[0]: r[1] for r in summarise(df, ["g"], [Agg("s", "std", "x", 1, 2)]).collect()}
    assert got == {"a": None, "b": 0.71}


# Q3 / Q11: plants without measurements still count -------------------------------
def test_coverage_and_kpis_count_plants_without_measurements(spark):
    g = geo(2)
    muni = [(10, 1), (11, 1), (12, 2)]
    plant = [(100, 10, None, "A"), (101, 10, None, "A"), (102, 11, None, "B"), (103, 99, None, "C")]
    meas = [(1, 100, None, 5, 1, 1.0, 1, 2025)]
    parameter = [(5, "pH", None, "c")]
    t = bundle(spark, municipality=muni, plant=plant, measurement=meas, parameter=parameter, **g)
    assert rows(base.state_coverage(t)) == [("S1", "State 1", 3, 2, 1.5)]
    assert rows(base.kpi_summary(t)) == [
        (1, "Estados Monitorados", 1),
        (2, "ETAs Ativas", 4),
        (3, "Total de Medições", 1),
        (4, "Parâmetros Monitorados", 1),
        (5, "Municípios Atendidos", 2),
    ]


def test_empty_monthly_input_keeps_schema(spark):
    t = bundle(spark, **geo(1))
    q10 = base.monthly_evolution(t)
    assert q10.count() == 0
    for fn in (derived.period_summary, derived.intensity_box_stats, derived.consolidated_stats,
               derived.intensity_heatmap, derived.monthly_series):
        out = fn(q10)
        assert out.count() == 0
        assert len(out.columns) > 1
