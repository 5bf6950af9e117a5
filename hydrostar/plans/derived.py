"""Derived results (P1-P26): the dashboard's second layer, re-expressed as
DataFrame transforms over the base queries' (already reduced) outputs.

Nothing is collected to the driver; every result is a lazy DataFrame.
Where the dashboard's pandas code drops NULL group keys (``groupby``,
``value_counts``), the same rows are filtered out here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrostar.functions.numeric import div_half_even
from hydrostar.functions.text import classify, cut_label, fixed_text, percent_text, substitute, thousands
from hydrostar.operators.choice import filter_by_choice, options
from hydrostar.operators.reshape import hierarchy_totals, long_form, pivot_matrix, sum_all
from hydrostar.operators.shares import share_of_total, sum_of
from hydrostar.operators.summary import Agg, box_stats, summarise
from hydrostar.operators.topk import top_k
from hydrostar.plans import params as P

MONTHS = list(range(1, 13))
MONTH_COLUMNS = [f"m{m:02d}" for m in MONTHS]


def _known(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


# Q3 -> P1, P6, P25 ---------------------------------------------------------------
def top_states(q3: DataFrame, k: int = P.TOP_STATES) -> DataFrame:
    """The first k states of the coverage ranking."""
    return top_k(q3, [F.desc("plants"), "state_code", "state_name"], k)


def state_coverage_display(q3: DataFrame) -> DataFrame:
    """Coverage rows plus the ratio as text with two decimals."""
    return q3.withColumn("efficiency", fixed_text("plants_per_municipality", 2))


def coverage_dual_axis(q3: DataFrame) -> DataFrame:
    """P25: plants and municipalities per state as two series, states in the
    coverage ranking's order."""
    ranked = q3.select("state_code", "state_name", F.col("plants").alias("_rank"), "plants", "municipalities")
    ids = ["state_code", "state_name", "_rank"]
    series = long_form(ranked, ids, ["plants", "municipalities"], "measure", "value")
    ordered = series.orderBy(F.desc("_rank"), "state_code", "state_name", F.desc("measure"))
    return ordered.select("state_code", "measure", "value")


# Q6 -> P2, P11 -------------------------------------------------------------------
def region_share(q6: DataFrame) -> DataFrame:
    """Records per region and their share of the shown sum."""
    per_region = (
        _known(q6, "region_name")
        .groupBy("region_name")
        .agg(F.sum("measurements").cast("long").alias("measurements"))
    )
    return share_of_total(per_region, "measurements", sum_of(per_region, "measurements")).orderBy(
        F.desc("measurements"), "region_name"
    )


def regional_summary(q6: DataFrame) -> DataFrame:
    """Per region, sums and the mean of the rounded records/plant."""
    spec = [
        Agg("measurements", "sum", "measurements"),
        Agg("plants", "sum", "plants"),
        Agg("measurements_per_plant", "mean", "measurements_per_plant", 0, 1),
        Agg("municipalities", "sum", "municipalities"),
    ]
    return summarise(_known(q6, "region_name"), ["region_name"], spec).orderBy("region_name")


# Q1 -> P3, P26 -------------------------------------------------------------------
def filtration_total(q1: DataFrame) -> DataFrame:
    """Plants over the listed filtration types (blanks excluded)."""
    total = sum_all(q1, "plants")
    return total.withColumn("plants_text", thousands("plants"))


def filtration_labels(q1: DataFrame, width: int = P.FILTRATION_LABEL_WIDTH) -> DataFrame:
    """Metric captions of the filtration panel."""
    return q1.select(
        "filtration_type",
        cut_label("filtration_type", width).alias("label"),
        thousands("plants").alias("value_text"),
        percent_text("pct", 1).alias("delta_text"),
    )


def point_labels(q4: DataFrame, width: int = P.POINT_LABEL_WIDTH) -> DataFrame:
    """Metric captions of the monitoring-point panel."""
    return q4.select(
        "point_type",
        "point_name",
        cut_label("point_name", width).alias("label"),
        thousands("measurements").alias("value_text"),
        percent_text("pct", 1).alias("delta_text"),
    )


# Q2 -> P4, P5 --------------------------------------------------------------------
def purpose_counts(q2: DataFrame) -> DataFrame:
    """Parameters per purpose, largest first."""
    return (
        _known(q2, "purpose")
        .groupBy("purpose")
        .agg(F.count(F.lit(1)).alias("parameters"))
        .orderBy(F.desc("parameters"), "purpose")
    )


def purpose_detail(
    q2: DataFrame,
    sort_rules: Sequence[tuple[str, int]] = P.PURPOSE_SORT_RULES,
    sort_default: int = P.PURPOSE_SORT_DEFAULT,
) -> DataFrame:
    """P5: each parameter under its purpose with the purpose's size; the
    unit text 'None' reads as qualitative (a NULL unit stays NULL).

    Purposes come in the order in which Q2 first shows them, parameters
    inside in Q2's order, so the sort rules are Q2's.  Size and first
    appearance are one grouped row per purpose, joined back on it.
    """
    known = _known(q2, "purpose").withColumn(
        "_rank", classify(F.col("parameter_name"), sort_rules, sort_default)
    )
    order = ["_rank", "parameter_name", "unit"]
    sizes = known.groupBy("purpose").agg(
        F.count(F.lit(1)).alias("purpose_parameters"), F.min(F.struct(*order)).alias("_first")
    )
    return (
        known.join(sizes, "purpose")
        .orderBy("_first", "purpose", *order)
        .select(
            "purpose",
            "purpose_parameters",
            "parameter_name",
            substitute("unit", P.UNIT_NONE_TEXT, P.UNIT_QUALITATIVE).alias("unit_label"),
        )
    )


# Q4 -> P7, P8 --------------------------------------------------------------------
def point_name_share(q4: DataFrame) -> DataFrame:
    """Records per point name (types merged) and share of the shown sum."""
    per_name = (
        _known(q4, "point_name")
        .groupBy("point_name")
        .agg(F.sum("measurements").cast("long").alias("measurements"))
    )
    return share_of_total(per_name, "measurements", sum_of(per_name, "measurements")).orderBy(
        F.desc("measurements"), "point_name"
    )


def point_total(q4: DataFrame) -> DataFrame:
    """Records over the joined monitoring points."""
    return sum_all(q4, "measurements").withColumn("measurements_text", thousands("measurements"))


# Q5 -> P9, P10 -------------------------------------------------------------------
def category_hierarchy(q5: DataFrame) -> DataFrame:
    """Parameter, category and grand totals of records."""
    return hierarchy_totals(q5, ["category", "parameter_name"], "measurements").orderBy(
        "level", "category", "parameter_name"
    )


def top_parameters(q5: DataFrame, k: int = P.TOP_PARAMETERS) -> DataFrame:
    """P10: the k parameters with most records (ties: category, name)."""
    return top_k(q5, [F.desc("measurements"), "category", "parameter_name"], k)


# Q8 -> P12, P17, P18 ---------------------------------------------------------------
def band_series(q8: DataFrame) -> DataFrame:
    """Per parameter, the (filtration x band) shares of one stacked bar;
    parameters in the order in which Q8 first shows them."""
    # One row per filtration and listed band: bounded by the rules.
    first = F.min("filtration_type").over(Window.partitionBy("parameter_name"))
    return (
        q8.withColumn("_first", first)
        .orderBy("_first", "parameter_name", "filtration_type", F.desc("band_name"))
        .select("parameter_name", "filtration_type", "band_name", "pct")
    )


def select_options(
    q8: DataFrame,
    all_filtrations: str = P.ALL_FILTRATIONS,
    all_parameters: str = P.ALL_PARAMETERS,
) -> DataFrame:
    """The two selectors' entries in first-appearance order of Q8
    (sorted by filtration, then parameter), each after its "all" entry."""
    specs = [
        ("filtration_type", ["filtration_type"], all_filtrations),
        ("parameter_name", ["filtration_type", "parameter_name"], all_parameters),
    ]
    return options(q8, specs).orderBy("field", "ord")


def filter_choice(
    q8: DataFrame, filtration: str | None = None, parameter: str | None = None
) -> DataFrame:
    """Q8 restricted to the chosen filtration and/or parameter; None
    keeps all.  Shares are not renormalised."""
    return filter_by_choice(q8, {"filtration_type": filtration, "parameter_name": parameter})


# Q9 -> P13-P16 -------------------------------------------------------------------
def _rank_order() -> list:
    return [F.desc("parameters"), F.desc("measurements"), "state_name"]


def top_ranked_states(q9: DataFrame, k: int = P.TOP_RANKED_STATES) -> DataFrame:
    """The first k states of the diversity ranking."""
    return top_k(q9, _rank_order(), k)


def ranking_leader(q9: DataFrame) -> DataFrame:
    """The leading state and its parameter count."""
    return top_k(q9, _rank_order(), 1).select(
        "state_name", F.col("parameters").cast("long").alias("parameters")
    )


def ranking_mean_parameters(q9: DataFrame) -> DataFrame:
    """Mean parameters per ranked state, shown with no decimals
    (half-even, as Python formats it)."""
    agg = q9.agg(F.sum("parameters").alias("s"), F.count("parameters").alias("n"))
    return agg.select(div_half_even("s", "n").alias("mean_parameters"))


def ranking_total(q9: DataFrame) -> DataFrame:
    """Records over the ranked states."""
    return sum_all(q9, "measurements").withColumn("measurements_text", thousands("measurements"))


# Q10 -> P19-P23 ------------------------------------------------------------------
def monthly_series(q10: DataFrame) -> DataFrame:
    """Records and intensity per (region, month) as two series."""
    return long_form(
        q10, ["region_name", "month"], ["measurements", "intensity"], "series", "value", "double"
    )


def intensity_heatmap(q10: DataFrame) -> DataFrame:
    """P20: region x month matrix of intensity (NULL if absent).  A month that
    is not 1-12, or a second row for a cell, fails."""
    return pivot_matrix(
        _known(q10, "month"), "region_name", "month", "intensity", MONTHS, MONTH_COLUMNS
    ).orderBy("region_name")


def period_summary(q10: DataFrame) -> DataFrame:
    """Per (region, period) records, mean intensity, mean diversity."""
    spec = [
        Agg("measurements", "sum", "measurements"),
        Agg("intensity", "mean", "intensity", 1, 2),
        Agg("diversity", "mean", "diversity", 2, 2),
    ]
    return summarise(_known(q10, "region_name"), ["region_name", "period"], spec).orderBy(
        "region_name", "period"
    )


def intensity_box_stats(q10: DataFrame) -> DataFrame:
    """Box-plot statistics of monthly intensity per region."""
    return box_stats(_known(q10, "region_name"), "region_name", "intensity", 1).orderBy(
        "region_name"
    )


def intensity_outliers(q10: DataFrame) -> DataFrame:
    """The points beyond the whiskers, one row each."""
    box = intensity_box_stats(q10).select("region_name", "lower_whisker", "upper_whisker")
    points = _known(q10, "region_name").select("region_name", "month", "intensity")
    beyond = (F.col("intensity") < F.col("lower_whisker")) | (
        F.col("intensity") > F.col("upper_whisker")
    )
    return (
        points.join(box, "region_name")
        .where(beyond)
        .select("region_name", "month", "intensity")
        .orderBy("region_name", "month", "intensity")
    )


def consolidated_stats(q10: DataFrame) -> DataFrame:
    """Per region, flat multi-aggregate of the monthly rows."""
    spec = [
        Agg("measurements_sum", "sum", "measurements"),
        Agg("measurements_mean", "mean", "measurements", 0, 2),
        Agg("plants_mean", "mean", "plants", 0, 2),
        Agg("parameters_mean", "mean", "parameters", 0, 2),
        Agg("intensity_mean", "mean", "intensity", 1, 2),
        Agg("intensity_std", "std", "intensity", 1, 2),
        Agg("diversity_mean", "mean", "diversity", 2, 2),
        Agg("diversity_std", "std", "diversity", 2, 2),
    ]
    return summarise(_known(q10, "region_name"), ["region_name"], spec).orderBy("region_name")


# P24 ---------------------------------------------------------------------------
# The scatter charts read column subsets, in chart-role order
# (x, y, size, colour, hover...).  No computation of their own.
def geo_scatter(q6: DataFrame) -> DataFrame:
    """Plants x records per state, sized by records/plant."""
    return q6.select(
        "plants", "measurements", "measurements_per_plant", "region_name", "state_code",
        "municipalities",
    )


def institution_scatter(q7: DataFrame) -> DataFrame:
    """Plants x records per institution, sized by records/plant."""
    return q7.select(
        "plants", "measurements", "measurements_per_plant", "institution_type", "institution_name"
    )


def choice_scatter(
    q8: DataFrame, filtration: str | None = None, parameter: str | None = None
) -> DataFrame:
    """Analyses x share of the filtered band rows, sized by plants."""
    return filter_choice(q8, filtration, parameter).select(
        "analyses", "pct", "plants", "filtration_type", "band_name"
    )


def monthly_scatter(q10: DataFrame) -> DataFrame:
    """Plants x diversity per region-month, sized by records."""
    return q10.select("plants", "diversity", "measurements", "region_name", "month")


DERIVED_ON: dict[str, tuple[str, object]] = {
    "P1": ("Q3", top_states),
    "P2": ("Q6", region_share),
    "P3": ("Q1", filtration_total),
    "P4": ("Q2", purpose_counts),
    "P5": ("Q2", purpose_detail),
    "P6": ("Q3", state_coverage_display),
    "P7": ("Q4", point_name_share),
    "P8": ("Q4", point_total),
    "P9": ("Q5", category_hierarchy),
    "P10": ("Q5", top_parameters),
    "P11": ("Q6", regional_summary),
    "P12": ("Q8", band_series),
    "P13": ("Q9", top_ranked_states),
    "P14": ("Q9", ranking_leader),
    "P15": ("Q9", ranking_mean_parameters),
    "P16": ("Q9", ranking_total),
    "P17": ("Q8", select_options),
    "P18": ("Q8", filter_choice),
    "P19": ("Q10", monthly_series),
    "P20": ("Q10", intensity_heatmap),
    "P21": ("Q10", period_summary),
    "P22": ("Q10", intensity_box_stats),
    "P22b": ("Q10", intensity_outliers),
    "P23": ("Q10", consolidated_stats),
    "P24a": ("Q6", geo_scatter),
    "P24b": ("Q7", institution_scatter),
    "P24c": ("Q8", choice_scatter),
    "P24d": ("Q10", monthly_scatter),
    "P25": ("Q3", coverage_dual_axis),
    "P26a": ("Q1", filtration_labels),
    "P26b": ("Q4", point_labels),
}

# Results that group or sort the rows themselves: the base query's own final
# sort would be wasted below them.
RESORTED = frozenset(
    "P1 P2 P3 P4 P5 P7 P8 P9 P10 P11 P12 P13 P14 P15 P16 P17 P20 P21 P22 P22b P23 P25".split()
)
