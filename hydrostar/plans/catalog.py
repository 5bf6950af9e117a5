"""Registry of the queries run on the driver's test tables.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with its
DuckDB oracle.  The callables bind the fixture parameters of
``fixture_params``; the engine functions keep the dashboard's defaults.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hydrostar import oracle as O
from hydrostar.plans import base, derived
from hydrostar.plans import fixture_params as FX
from hydrostar.plans import params as P
from hydrostar.session import checkpoint_dir
from hydrostar.sources.fixture import fixture_tables
from hydrostar.sources.gold import write_gold
from hydrostar.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


def _on_fixture(fn, **kwargs) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fixture_tables(spark, sf_dir), **kwargs)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


Q2_KW = dict(
    rules=FX.PURPOSE_RULES,
    default=P.PURPOSE_DEFAULT,
    sort_rules=FX.PURPOSE_SORT_RULES,
    sort_default=P.PURPOSE_SORT_DEFAULT,
)
Q7_KW = dict(min_measurements=FX.MIN_INSTITUTION_MEASUREMENTS)
Q8_KW = dict(band_pairs=FX.BAND_PAIRS, min_records=FX.MIN_BAND_RECORDS)
Q9_KW = dict(min_plants=FX.MIN_RANKED_PLANTS)
Q10_KW = dict(
    year=FX.MONTHLY_YEAR,
    min_measurements=FX.MIN_MONTHLY_MEASUREMENTS,
    period_bounds=P.PERIOD_BOUNDS,
    period_labels=P.PERIOD_LABELS,
)

# Oracle parts of the base queries, reused by the derived oracles.
OQ = {
    "Q1": O.q1_filtration_share(),
    "Q2": O.q2_parameter_purpose(**Q2_KW),
    "Q3": O.q3_state_coverage(),
    "Q4": O.q4_point_volume(),
    "Q5": O.q5_parameter_volume(),
    "Q6": O.q6_geo_activity(),
    "Q7": O.q7_institution_performance(**Q7_KW),
    "Q8": O.q8_band_distribution(FX.BAND_PAIRS, FX.MIN_BAND_RECORDS),
    "Q9": O.q9_state_ranking(**Q9_KW),
    "Q10": O.q10_monthly_evolution(
        FX.MONTHLY_YEAR, FX.MIN_MONTHLY_MEASUREMENTS, P.PERIOD_BOUNDS, P.PERIOD_LABELS
    ),
    "Q11": O.q11_kpi_summary(P.KPI_NAMES),
}

# Spark side of the base queries bound to the fixture parameters.
SQ = {
    "Q1": (base.filtration_share, {}),
    "Q2": (base.parameter_purpose, Q2_KW),
    "Q3": (base.state_coverage, {}),
    "Q4": (base.point_volume, {}),
    "Q5": (base.parameter_volume, {}),
    "Q6": (base.geo_activity, {}),
    "Q7": (base.institution_performance, Q7_KW),
    "Q8": (base.band_distribution, Q8_KW),
    "Q9": (base.state_ranking, Q9_KW),
    "Q10": (base.monthly_evolution, Q10_KW),
    "Q11": (base.kpi_summary, {}),
}

BASE: dict[str, tuple[Query, str | None]] = {
    f"{qid}_{fn.__name__}": (
        _on_fixture(fn, **kw),
        O.q2_public(OQ[qid]) if qid == "Q2" else O.run(OQ[qid]),
    )
    for qid, (fn, kw) in SQ.items()
}



def _derived(pid: str, qid: str, fn, base_kw: dict, **kwargs) -> Query:
    base_fn = SQ[qid][0]
    ordered = pid not in derived.RESORTED

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = base_fn(fixture_tables(spark, sf_dir), ordered=ordered, **base_kw)
        return fn(rows, **kwargs)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


P18_KW = dict(filtration=FX.CHOSEN_FILTRATION, parameter=FX.CHOSEN_PARAMETER)
P5_KW = dict(sort_rules=FX.PURPOSE_SORT_RULES, sort_default=P.PURPOSE_SORT_DEFAULT)
# Other bindings of derived results, and of the base query below one.
DERIVED_KW: dict[str, dict] = {
    "P5": P5_KW,
    "P13": dict(k=FX.TOP_RANKED_STATES),
    "P18": P18_KW,
    "P24c": P18_KW,
}
OUTLIER_KW = Q10_KW | dict(year=FX.OUTLIER_YEAR, min_measurements=FX.OUTLIER_MIN_MEASUREMENTS)

DERIVED_ORACLES: dict[str, str] = {
    "P1": O.top("q3", OQ["Q3"], P.TOP_STATES),
    "P2": O.share_by("q6", OQ["Q6"], "region_name"),
    "P3": O.total_of("q1", OQ["Q1"], "plants"),
    "P4": O.p4_purpose_counts(OQ["Q2"]),
    "P5": O.p5_purpose_detail(OQ["Q2"], P.UNIT_NONE_TEXT, P.UNIT_QUALITATIVE),
    "P6": O.p6_state_coverage_display(OQ["Q3"]),
    "P7": O.share_by("q4", OQ["Q4"], "point_name"),
    "P8": O.total_of("q4", OQ["Q4"], "measurements"),
    "P9": O.p9_category_hierarchy(OQ["Q5"]),
    "P10": O.top(
        "q5",
        OQ["Q5"],
        P.TOP_PARAMETERS,
        order="measurements DESC, category NULLS FIRST, parameter_name NULLS FIRST",
    ),
    "P11": O.p11_regional_summary(OQ["Q6"]),
    "P12": O.p12_band_series(OQ["Q8"]),
    "P13": O.top("q9", OQ["Q9"], FX.TOP_RANKED_STATES),
    "P14": O.top("q9", OQ["Q9"], 1, "state_name, parameters"),
    "P15": O.p15_ranking_mean_parameters(OQ["Q9"]),
    "P16": O.total_of("q9", OQ["Q9"], "measurements"),
    "P17": O.p17_select_options(OQ["Q8"], P.ALL_FILTRATIONS, P.ALL_PARAMETERS),
    "P18": O.p18_filter_choice(OQ["Q8"], **P18_KW),
    "P19": O.p19_monthly_series(OQ["Q10"]),
    "P20": O.p20_intensity_heatmap(OQ["Q10"]),
    "P21": O.p21_period_summary(OQ["Q10"]),
    "P22": O.p22_intensity_box_stats(OQ["Q10"]),
    "P22b": O.p22_intensity_outliers(
        O.q10_monthly_evolution(
            FX.OUTLIER_YEAR, FX.OUTLIER_MIN_MEASUREMENTS, P.PERIOD_BOUNDS, P.PERIOD_LABELS
        )
    ),
    "P23": O.p23_consolidated_stats(OQ["Q10"]),
    "P24a": O.columns_of(
        "q6", OQ["Q6"],
        "plants, measurements, measurements_per_plant, region_name, state_code, municipalities",
    ),
    "P24b": O.columns_of(
        "q7", OQ["Q7"],
        "plants, measurements, measurements_per_plant, institution_type, institution_name",
    ),
    "P24c": O.columns_of(
        "q8", OQ["Q8"], "analyses, pct, plants, filtration_type, band_name",
        where=O.choice_where(FX.CHOSEN_FILTRATION, FX.CHOSEN_PARAMETER),
    ),
    "P24d": O.columns_of("q10", OQ["Q10"], "plants, diversity, measurements, region_name, month"),
    "P25": O.p25_coverage_dual_axis(OQ["Q3"]),
    "P26a": O.p26_labels(
        "q1", OQ["Q1"], "filtration_type", "filtration_type", P.FILTRATION_LABEL_WIDTH, "plants"
    ),
    "P26b": O.p26_labels(
        "q4", OQ["Q4"], "point_type, point_name", "point_name", P.POINT_LABEL_WIDTH, "measurements"
    ),
}

DERIVED: dict[str, tuple[Query, str | None]] = {}
IDS: dict[str, str] = {key: key.split("_", 1)[0] for key in BASE}
for pid, (qid, fn) in derived.DERIVED_ON.items():
    key = f"{re.sub(r'[a-z]$', '', pid)}_{fn.__name__}"
    base_kw = OUTLIER_KW if pid == "P22b" else SQ[qid][1]
    DERIVED[key] = (
        _derived(pid, qid, fn, base_kw, **DERIVED_KW.get(pid, {})),
        DERIVED_ORACLES.get(pid),
    )
    IDS[key] = pid

REGISTRY: dict[str, tuple[Query, str | None]] = {**BASE, **DERIVED}


def result_id(name: str) -> str | None:
    """The id behind an id or a registered key; an id without its letter
    ("P24") stands for the first of its results."""
    if name in IDS:
        return IDS[name]
    known = [*SQ, *derived.DERIVED_ON]
    if name in known:
        return name
    return next((i for i in known if i.rstrip("abcd") == name), None)


# The plant queries on a written store (S3).  Writing it takes jobs, so these
# are apart from the registry, whose queries run none before they are used.
_written: dict[tuple[str, str], Tables] = {}


def gold_of(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> Tables:
    """The store of a test folder, written once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _written:
        path = f"{checkpoint_dir(spark)}/hydrostar-gold-{uuid.uuid4().hex}"
        _written[at] = write_gold(fixture_tables(spark, sf_dir), path, buckets)
    return _written[at]


def _on_gold(qid: str) -> Query:
    fn, kw = SQ[qid]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(gold_of(spark, sf_dir), **kw)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


STORED: dict[str, tuple[Query, str | None]] = {
    f"S3_gold_{SQ[qid][0].__name__}": (_on_gold(qid), O.run(OQ[qid]))
    for qid in ("Q6", "Q7", "Q8", "Q9", "Q10")
}


def queries() -> dict[str, Query]:
    return {k: fn for k, (fn, _) in (REGISTRY | STORED).items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in (REGISTRY | STORED).items() if sql is not None}
