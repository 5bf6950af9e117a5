"""Pre-aggregated fact rows with the attributes of their plants.

The plant queries (Q6, Q7, Q9, Q10) all group the same kind of rows: the fact
at a grain that has the plant, with geography or institution.  The rows come
from one of three places, with the same result:

* the fact, aggregated and joined to the dimension chains;
* a stored grain of the fact (a page's lattice), joined the same way;
* a written, enriched grain (``sources.gold``), which has the attributes
  already: no join, and no shuffle, as it is bucketed by plant.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrostar.operators.shares import activity_by, activity_by_owner
from hydrostar.plans.dims import (
    COPIES,
    parameter_keys,
    parameters_proven,
    plant_geo,
    plant_institution,
    wjoin,
)
from hydrostar.sources.tables import Tables

# chain -> (key of the last row it inner-joins, attributes)
CHAINS = {
    "region": ("own_region", ["region_name", "state_code", "state_name", "municipality_id"]),
    "state": ("own_state", ["state_code", "state_name", "municipality_id"]),
    "institution": ("own_institution", ["institution_name", "institution_type"]),
}


def activity_rows(
    t: Tables, chain: str, keys: Sequence[str], where: Column | None = None
) -> DataFrame:
    """``keys``, the chain's attributes and ``records``, in which repeated
    dimension rows already count as in SQL's multiplying joins."""
    by_parameter = "parameter_id" in keys
    if t.enriched:
        own, attributes = CHAINS[chain]
        rows = t.grain.filter(F.col(own).isNotNull())
        if by_parameter:
            rows = rows.filter(F.col("own_parameter").isNotNull())
        rows = rows if where is None else rows.filter(where)
        return rows.groupBy(*keys, *attributes).agg(F.sum("records").alias("records"))
    rows = t.rollup(keys, where).select(*keys, "records")
    rows = rows.withColumn(COPIES, F.lit(1).cast("long"))
    if by_parameter and parameters_proven(t):
        rows = rows.filter(F.col("parameter_id").isNotNull())
    elif by_parameter:
        rows = wjoin(rows, parameter_keys(t), "parameter_id")
    if chain == "institution":
        dim = plant_institution(t)
    else:
        # with one fact row per plant, repeated plant rows cannot multiply
        dim = plant_geo(t, with_region=chain == "region", weigh_plants=list(keys) != ["plant_id"])
    rows = wjoin(rows, dim, "plant_id")
    return rows.withColumn("records", F.col("records") * F.col(COPIES)).drop(COPIES)


def activity(
    t: Tables, rows: DataFrame, keys: Sequence[str], distinct: Mapping[str, str], having: Column
) -> DataFrame:
    """``rows`` of ``activity_rows`` grouped by ``keys``: distinct counts and
    measurements.  Enriched rows lie by plant and give each plant one value of
    an attribute."""
    if t.enriched:
        return activity_by_owner(rows, keys, distinct, "plant_id", having=having)
    return activity_by(rows, keys, distinct, having=having, dense=t.keys.dense)
