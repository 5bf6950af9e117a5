"""Dimension chains joined to the pre-aggregated fact.

Weighted dimensions
-------------------
The reference joins with plain ``INNER JOIN``s, so a dimension row repeated
k times multiplies every matching fact row by k.  To keep exactly those
counts without materialising the multiplied rows, each dimension is first
reduced to its *distinct* rows with a ``copies`` count (a map-side combined
aggregate), and joins multiply the counts instead of the rows.  A key
repeated in a third of a table then costs one row, not a third of a join.

Only the looked-up side of a join needs this; a side joined to something
with one row per key can keep its repeats as rows (``unweighted``).

Join strategy
-------------
Each chain is a many-to-one path from ``plant`` (or the parameter keys); the
pre-aggregated fact joins it once.  No side is marked for broadcast and no job
runs while a query is defined: the planner broadcasts what its statistics show
to be small, AQE turns a sort-merge join into a broadcast when a finished
shuffle turns out small, and splits skewed partitions.  Where the same chains
serve many queries, write them once as Parquet and load them as the dimension
tables; then the planner knows their sizes.  Inner joins drop orphan keys and
NULL keys, as the reference's chains do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrostar.operators.joins import literal_table
from hydrostar.sources.tables import Tables

COPIES = "copies"

def weighted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows of ``cols`` with the number of source rows as ``copies``."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(COPIES))


def unweighted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``cols`` as they are, each with ``copies`` = 1.

    Used for the *many* side of a join, or for a side joined to something
    with at most one row per key: there repeated rows cannot multiply, so
    the aggregate (a shuffle) that weighting costs is skipped."""
    return df.select(*cols, F.lit(1).cast("long").alias(COPIES))


def wjoin(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner join of two weighted frames; copies multiply."""
    keys = [on] if isinstance(on, str) else list(on)
    skip = set(keys) | {COPIES}
    cols = [
        *keys,
        *[F.col(f"__l.{c}") for c in left.columns if c not in skip],
        *[F.col(f"__r.{c}") for c in right.columns if c not in skip],
        (F.col(f"__l.{COPIES}") * F.col(f"__r.{COPIES}")).alias(COPIES),
    ]
    return left.alias("__l").join(right.alias("__r"), keys).select(*cols)


def _looked_up(t: Tables, table: str, cols: Sequence[str], df: DataFrame | None = None) -> DataFrame:
    """The rows of a table as the looked-up side of a join: weighted, unless
    its key is proven not to repeat."""
    df = getattr(t, table) if df is None else df
    return (unweighted if table in t.keys.unique else weighted)(df, cols)


def state_geo(t: Tables, with_region: bool) -> DataFrame:
    """state_id -> state_code, state_name[, region_name], copies.

    States and regions are administrative tables of a few dozen rows, so
    they are joined first and weighted once: any repeat product is bounded
    by their own tiny sizes, and one aggregate replaces two."""
    st = t.state.select("state_id", "region_id", "state_code", "state_name")
    cols = ["state_id", "state_code", "state_name"]
    if with_region:
        st = st.join(t.region.select("region_id", "region_name"), "region_id")
        cols.append("region_name")
        if "region" not in t.keys.unique:
            return weighted(st, cols)
    return _looked_up(t, "state", cols, st)


def plant_geo(t: Tables, with_region: bool, weigh_plants: bool = True) -> DataFrame:
    """plant_id -> municipality_id, state_code, state_name[, region_name], copies.

    ``weigh_plants=False`` keeps repeated plant rows as rows: right when the
    other join side has one row per plant (or only distinct counts follow).
    The looked-up municipality and state sides are always weighted."""
    muni = wjoin(
        _looked_up(t, "municipality", ["municipality_id", "state_id"]),
        state_geo(t, with_region),
        "state_id",
    )
    columns = ["plant_id", "municipality_id"]
    plants = _looked_up(t, "plant", columns) if weigh_plants else unweighted(t.plant, columns)
    return wjoin(plants, muni, "municipality_id")


def plant_institution(t: Tables) -> DataFrame:
    """plant_id -> institution_name, institution_type, copies (via office)."""
    inst = wjoin(
        _looked_up(t, "office", ["office_id", "institution_id"]),
        _looked_up(t, "institution", ["institution_id", "institution_name", "institution_type"]),
        "institution_id",
    )
    return wjoin(_looked_up(t, "plant", ["plant_id", "office_id"]), inst, "office_id")


def parameter_keys(t: Tables) -> DataFrame:
    """parameter_id -> copies (the join only checks existence and counts)."""
    return _looked_up(t, "parameter", ["parameter_id"])


def parameters_proven(t: Tables) -> bool:
    """Does every measured parameter exist, once?  Then joining ``parameter``
    for existence is a NULL test."""
    return "parameter" in t.keys.unique and "measurement.parameter_id" in t.keys.contained


def plant_filtration(t: Tables) -> DataFrame:
    """plant_id -> filtration_type (NULL types dropped), copies."""
    known = t.plant.filter(F.col("filtration_type").isNotNull())
    return _looked_up(t, "plant", ["plant_id", "filtration_type"], known)


def listed(t: Tables, band_pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """parameter_id and band_id of the listed names: what a fact row must have
    to be counted at all."""
    params = t.parameter.filter(F.col("parameter_name").isin(sorted({p for p, _ in band_pairs})))
    bands = t.band.filter(F.col("band_name").isin(sorted({b for _, b in band_pairs})))
    return params.select("parameter_id"), bands.select("band_id")


def band_keys(t: Tables, band_pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """(parameter_id, band_id) -> parameter_name, band_name, copies for the
    listed (parameter name, band name) pairs.

    The names filter reaches the Parquet scans; the pair table is a literal.
    """
    spark = t.parameter.sparkSession
    pairs = literal_table(spark, sorted(set(band_pairs)), "parameter_name STRING, band_name STRING")
    names = sorted({p for p, _ in band_pairs})
    bands = sorted({b for _, b in band_pairs})
    params = weighted(
        t.parameter.filter(F.col("parameter_name").isin(names)), ["parameter_id", "parameter_name"]
    )
    band = weighted(t.band.filter(F.col("band_name").isin(bands)), ["band_id", "band_name"])
    pairs = pairs.withColumn(COPIES, F.lit(1).cast("long"))
    return wjoin(wjoin(params, pairs, "parameter_name"), band, "band_name")
