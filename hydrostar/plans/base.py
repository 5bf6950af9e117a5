"""The eleven base queries of the surveillance dashboard (Q1-Q11).

Each function takes the table bundle and the reference's parameters (as
keyword defaults) and returns a lazy, ordered DataFrame with engine column
names; defining a query runs no job.  Orders end with unique tie-breakers so
results are deterministic.  ``ordered=False`` leaves the final sort out, for
results that group or sort the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrostar.functions.numeric import ratio
from hydrostar.functions.text import bucket_label, classify
from hydrostar.operators.reshape import stack_metrics
from hydrostar.operators.exact_sum import combined, sum_digits
from hydrostar.operators.rollup import table_count
from hydrostar.operators.shares import activity_by, share_of_total
from hydrostar.plans import params as P
from hydrostar.plans.activity import activity, activity_rows
from hydrostar.plans.dims import (
    COPIES,
    band_keys,
    listed,
    plant_filtration,
    plant_geo,
    unweighted,
)
from hydrostar.sources.tables import Tables


def _sorted(df: DataFrame, ordered: bool, *order) -> DataFrame:
    return df.orderBy(*order) if ordered else df


def _present(col: str) -> F.Column:
    """NOT NULL and not the empty string (blanks of spaces are kept)."""
    return F.col(col).isNotNull() & (F.col(col) != F.lit(""))


# Q1 -------------------------------------------------------------------------
def filtration_share(t: Tables, ordered: bool = True) -> DataFrame:
    """Plants per filtration type; percent of *all* plants, blanks included."""
    counted = (
        t.plant.filter(_present("filtration_type"))
        .groupBy("filtration_type")
        .agg(F.count(F.lit(1)).alias("plants"))
    )
    out = share_of_total(counted, "plants", table_count(t.plant), 2)
    return _sorted(out, ordered, F.desc("plants"), "filtration_type")


# Q2 -------------------------------------------------------------------------
def parameter_purpose(
    t: Tables,
    rules: Sequence[tuple[str, str]] = P.PURPOSE_RULES,
    default: str = P.PURPOSE_DEFAULT,
    sort_rules: Sequence[tuple[str, int]] = P.PURPOSE_SORT_RULES,
    sort_default: int = P.PURPOSE_SORT_DEFAULT,
    ordered: bool = True,
) -> DataFrame:
    """One row per named parameter with its purpose; two separate rule lists
    give the purpose and the sort rank."""
    name = F.col("parameter_name")
    out = t.parameter.filter(_present("parameter_name")).select(
        "parameter_name",
        "unit",
        classify(name, rules, default).alias("purpose"),
        classify(name, sort_rules, sort_default).alias("_rank"),
        "parameter_id",
    )
    out = _sorted(out, ordered, "_rank", "parameter_name", "unit", "parameter_id")
    return out.select("parameter_name", "unit", "purpose")


# Q3 -------------------------------------------------------------------------
def state_coverage(t: Tables, ordered: bool = True) -> DataFrame:
    """Per state: distinct plants and municipalities having a plant."""
    # only distinct counts follow: repeated plant rows need no weighting
    rows = plant_geo(t, with_region=False, weigh_plants=False)
    out = (
        activity_by(
            rows,
            ["state_code", "state_name"],
            {"plants": "plant_id", "municipalities": "municipality_id"},
            records=None,
            having=F.col("plants") > 0,
        )
        .select(
            "state_code",
            "state_name",
            "plants",
            "municipalities",
            ratio("plants", "municipalities", 2).alias("plants_per_municipality"),
        )
    )
    return _sorted(out, ordered, F.desc("plants"), "state_code", "state_name")


# Q4 / Q5 --------------------------------------------------------------------
def _volume_by(
    t: Tables, fk: str, dim: DataFrame, keys: Sequence[str], ordered: bool, order: Sequence
) -> DataFrame:
    # one fact row per key: repeated dimension rows can only repeat that row
    per_key = t.rollup([fk]).select(fk, "records")
    grouped = (
        per_key.join(unweighted(dim, [fk, *keys]), fk)
        .groupBy(*keys)
        .agg(F.sum(F.col("records") * F.col(COPIES)).cast("long").alias("measurements"))
    )
    out = share_of_total(grouped, "measurements", table_count(t.measurement), 2)
    return _sorted(out, ordered, *order)


def point_volume(t: Tables, ordered: bool = True) -> DataFrame:
    """Records per monitoring point (type, name); percent of all records."""
    return _volume_by(
        t,
        "point_id",
        t.point,
        ["point_type", "point_name"],
        ordered,
        [F.desc("measurements"), "point_type", "point_name"],
    )


def parameter_volume(t: Tables, ordered: bool = True) -> DataFrame:
    """Records per (category, parameter name); percent of all records."""
    return _volume_by(
        t,
        "parameter_id",
        t.parameter,
        ["category", "parameter_name"],
        ordered,
        ["category", F.desc("measurements"), "parameter_name"],
    )


# Q6 -------------------------------------------------------------------------
def geo_activity(t: Tables, ordered: bool = True) -> DataFrame:
    """Per (region, state): municipalities, plants, records, records/plant."""
    rows = activity_rows(t, "region", ["plant_id"])
    out = (
        activity(
            t,
            rows,
            ["region_name", "state_code"],
            {"municipalities": "municipality_id", "plants": "plant_id"},
            F.col("measurements") > 0,
        )
        .select(
            "region_name",
            "state_code",
            "municipalities",
            "plants",
            "measurements",
            ratio("measurements", "plants", 0).alias("measurements_per_plant"),
        )
    )
    return _sorted(out, ordered, F.desc("measurements"), "region_name", "state_code")


# Q7 -------------------------------------------------------------------------
def institution_performance(
    t: Tables,
    min_measurements: int = P.MIN_INSTITUTION_MEASUREMENTS,
    ordered: bool = True,
) -> DataFrame:
    """Per institution: plants, parameters, records (> min), records/plant."""
    rows = activity_rows(t, "institution", ["plant_id", "parameter_id"])
    out = (
        activity(
            t,
            rows,
            ["institution_name", "institution_type"],
            {"plants": "plant_id", "parameters": "parameter_id"},
            F.col("measurements") > F.lit(min_measurements),
        )
        .select(
            "institution_name",
            "institution_type",
            "plants",
            "parameters",
            "measurements",
            ratio("measurements", "plants", 0).alias("measurements_per_plant"),
        )
    )
    return _sorted(out, ordered, F.desc("plants"), "institution_name", "institution_type")


# Q8 -------------------------------------------------------------------------
def band_distribution(
    t: Tables,
    band_pairs: Sequence[tuple[str, str]] = P.BAND_PAIRS,
    min_records: int = P.MIN_BAND_RECORDS,
    ordered: bool = True,
) -> DataFrame:
    """Analyses per (filtration, parameter, band) and their share of the
    (filtration, parameter) total over the listed bands.

    One pass: rows of the listed parameters and bands are aggregated to
    (plant, parameter, band), then joined to the keys that the pair rules
    select and to the plants' filtration; the share is a window over the
    *aggregated* rows taken before the HAVING filter, so dropped bands still
    count in the total.

    The semi joins are written above the aggregate, on its grouping keys: where
    the listed ids are small enough to broadcast Catalyst pushes them below it,
    into the fact scan; where they are not, the fact is still combined before
    it is shuffled.  Analyses are summed exactly, so the result does not
    depend on the order of the rows.
    """
    per = t.rollup(["plant_id", "parameter_id", "band_id"])
    params, bands = listed(t, band_pairs)
    per = per.join(params, "parameter_id", "left_semi").join(bands, "band_id", "left_semi")
    per_plant = (
        per.join(band_keys(t, tuple(band_pairs)), ["parameter_id", "band_id"])
        .groupBy("plant_id", "parameter_name", "band_name")
        .agg(
            F.sum(F.col("records") * F.col(COPIES)).alias("records"),
            *sum_digits("analyses", COPIES),
        )
    )
    grouped = (
        per_plant.join(plant_filtration(t), "plant_id")
        .groupBy("filtration_type", "parameter_name", "band_name")
        .agg(
            *sum_digits("analyses", COPIES),
            F.count_distinct("plant_id").alias("plants"),
            F.sum(F.col("records") * F.col(COPIES)).alias("records"),
        )
    )
    # Window partitions hold one row per listed band: bounded by the rules.
    total = combined("analyses", within=["filtration_type", "parameter_name"])
    summed = grouped.withColumn("analyses", combined("analyses"))
    shared = share_of_total(summed, "analyses", total, 2)
    out = (
        shared.filter(F.col("records") >= F.lit(min_records))
        .select("filtration_type", "parameter_name", "band_name", "analyses", "plants", "pct")
    )
    return _sorted(out, ordered, "filtration_type", "parameter_name", F.desc("band_name"))


# Q9 -------------------------------------------------------------------------
def state_ranking(
    t: Tables, min_plants: int = P.MIN_RANKED_PLANTS, ordered: bool = True
) -> DataFrame:
    """Per state: plants (>= min), distinct parameters, records."""
    rows = activity_rows(t, "state", ["plant_id", "parameter_id"])
    out = (
        activity(
            t,
            rows,
            ["state_name"],
            {"plants": "plant_id", "parameters": "parameter_id"},
            F.col("plants") >= F.lit(min_plants),
        )
        .select("state_name", "plants", "parameters", "measurements")
    )
    return _sorted(out, ordered, F.desc("parameters"), F.desc("measurements"), "state_name")


# Q10 ------------------------------------------------------------------------
def monthly_evolution(
    t: Tables,
    year: int = P.MONTHLY_YEAR,
    min_measurements: int = P.MIN_MONTHLY_MEASUREMENTS,
    period_bounds: Sequence[int] = P.PERIOD_BOUNDS,
    period_labels: Sequence[str] = P.PERIOD_LABELS,
    ordered: bool = True,
) -> DataFrame:
    """Per (region, month) of one year: records (>= min), plants, parameters,
    records/plant (1 dp), parameters/plant (2 dp) and the period label."""
    rows = activity_rows(
        t, "region", ["plant_id", "parameter_id", "month"], F.col("year") == F.lit(year)
    )
    out = (
        activity(
            t,
            rows,
            ["region_name", "month"],
            {"plants": "plant_id", "parameters": "parameter_id"},
            F.col("measurements") >= F.lit(min_measurements),
        )
        .select(
            "region_name",
            F.col("month").cast("int").alias("month"),
            "measurements",
            "plants",
            "parameters",
            ratio("measurements", "plants", 1).alias("intensity"),
            ratio("parameters", "plants", 2).alias("diversity"),
            bucket_label("month", period_bounds, period_labels).alias("period"),
        )
    )
    return _sorted(out, ordered, "region_name", "month")


# Q11 ------------------------------------------------------------------------
def kpi_summary(
    t: Tables, names: Sequence[str] = P.KPI_NAMES, ordered: bool = True
) -> DataFrame:
    """Five headline counts stacked as (ord, metric, value).

    "States" and "municipalities" count distinct values over the chains
    having a plant, so both sides are reduced to distinct keys first (a
    semi join): no plant-sized join output is formed.
    """
    served = t.municipality.select("municipality_id", "state_id").join(
        t.plant.select("municipality_id").distinct(), "municipality_id", "left_semi"
    )
    states = (
        t.state.select("state_id", "state_name")
        .join(served.select("state_id").distinct(), "state_id", "left_semi")
        .agg(F.count_distinct("state_name"))
    )
    metrics = [
        states,
        t.plant.agg(F.count(F.lit(1))),
        t.measurement.agg(F.count(F.lit(1))),
        t.parameter.agg(F.count(F.lit(1))),
        served.agg(F.count_distinct("municipality_id")),
    ]
    return _sorted(stack_metrics(list(zip(names, metrics))), ordered, "ord")
