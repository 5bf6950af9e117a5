"""The written store: an enriched fact grain and analysed dimensions.

``write_gold`` stores once what every query otherwise repeats:

* the fact at its finest query grain (plant, parameter, band, year, month) with
  record counts and exact sums, which is what all plant queries read.  A plant
  with a third of all measurements has at most one row for each parameter,
  band and month, so bucketing by plant is not skewed by it as bucketing the
  raw fact would be;
* ``enrich_measurements``: the attributes of each row's plant and parameter, by
  left joins on keys proven unique.  Each query then filters on exactly the
  dimension rows it would inner-join;
* partitioned by year (the monthly query reads one) and bucketed by plant, so
  grouping by plant needs no shuffle.  The number of buckets follows the rows,
  so a task's memory does not grow with the fact;
* the dimensions as tables with column statistics, so that the planner knows
  chain sizes without running a job;
* a manifest with the proofs (``sources.keys``).

``load_gold`` registers the tables in a new session and gives the bundle that
every query takes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostar.operators.rollup import GRAIN, fact_rollup
from hydrostar.plans.dims import parameters_proven
from hydrostar.sources.keys import KEY_OF, REFERENCES, Keys, verify
from hydrostar.sources.schema import SCHEMAS
from hydrostar.sources.tables import Tables

# The lookups of the enrichment; a repeated key would repeat fact rows.
LOOKUPS = ("region", "state", "municipality", "office", "institution", "plant", "parameter")
# Fact rows a bucket: a task that joins, sorts and writes one, or groups it in a
# query, holds some hundred MB.
ROWS_A_BUCKET = 1 << 20
MIN_BUCKETS = 8
# Proven from the written grain: its rows of unknown plants have no own_plant.
BY_GRAIN = ("measurement", "plant_id")


class RepeatedKeys(ValueError):
    """A lookup table repeats a key, so the fact cannot be enriched."""


def enrich_measurements(grain: DataFrame, t: Tables, buckets: int | None = None) -> DataFrame:
    """``grain`` (or any fact rows with plant_id and parameter_id) with the
    attributes of plant and parameter.  Orphans keep their row: ``own_...`` is
    the key of the dimension row found, NULL if there is none.

    With ``buckets`` the rows come dealt by plant into that many partitions,
    and are dealt before they are wide: the plants' attributes meet them there.
    Where every parameter is proven to exist, ``own_parameter`` takes no join."""
    repeated = [name for name in LOOKUPS if name not in t.keys.unique]
    if repeated:
        raise RepeatedKeys(f"keys not proven unique: {', '.join(repeated)}")

    def own(name: str) -> Column:
        return F.col(KEY_OF[name]).alias(f"own_{name}")

    state = t.state.join(
        t.region.select("region_id", "region_name", own("region")), "region_id", "left"
    ).drop("region_id")
    municipality = t.municipality.select("municipality_id", "state_id", own("municipality")).join(
        state.select("*", own("state")), "state_id", "left"
    )
    office = t.office.join(
        t.institution.select(
            "institution_id", "institution_name", "institution_type", own("institution")
        ),
        "institution_id",
        "left",
    )
    plant = (
        t.plant.select("plant_id", "municipality_id", "office_id", own("plant"))
        .join(municipality.drop("state_id"), "municipality_id", "left")
        .join(office.drop("institution_id"), "office_id", "left")
        .drop("office_id")
    )
    if parameters_proven(t):
        rows = grain.withColumn("own_parameter", F.col("parameter_id"))
    else:
        parameter = t.parameter.select("parameter_id", own("parameter"))
        rows = grain.join(parameter, "parameter_id", "left")
    if buckets is not None:
        rows, plant = (df.repartition(buckets, "plant_id") for df in (rows, plant))
    return rows.join(plant, "plant_id", "left")


def _name(path: str, table: str) -> str:
    return f"gold_{hashlib.sha256(path.encode()).hexdigest()[:12]}_{table}"


@contextmanager
def _shuffled_into(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Joins written in here shuffle into ``partitions``; the planner would
    raise a smaller number that their sides are dealt into to the session's."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def buckets_of(rows: int) -> int:
    """Buckets for a fact of ``rows`` rows."""
    return max(MIN_BUCKETS, -(-rows // ROWS_A_BUCKET))


def write_gold(t: Tables, path: str, buckets: int | None = None) -> Tables:
    """Verify the keys, write the store below ``path`` (a new folder on shared
    storage) and load it.

    ``buckets``: files a year; left out, they follow the number of rows."""
    spark = t.measurement.sparkSession
    if buckets is None:
        buckets = buckets_of(t.measurement.count())
    keys = verify(t, [reference for reference in REFERENCES if reference != BY_GRAIN])
    grain = enrich_measurements(
        fact_rollup(t.measurement, GRAIN), t.having(keys=keys), buckets
    )
    # One task a bucket, so a year has one file a bucket.
    with _shuffled_into(spark, buckets):
        (
            grain.write.partitionBy("year")
            .bucketBy(buckets, "plant_id")
            .sortBy("plant_id")
            .option("path", f"{path}/grain")
            .saveAsTable(_name(path, "grain"))
        )
    written = spark.table(_name(path, "grain"))
    if written.filter("plant_id IS NOT NULL AND own_plant IS NULL").isEmpty():
        keys = replace(keys, contained=keys.contained | {".".join(BY_GRAIN)})
    for name in SCHEMAS:
        getattr(t, name).write.parquet(f"{path}/{name}")
    manifest = {"keys": keys.to_json(), "buckets": buckets, "grain": grain.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(
        f"{path}/manifest"
    )
    return load_gold(spark, path)


def load_gold(spark: SparkSession, path: str) -> Tables:
    """The bundle of a written store.  Registers its tables where the session
    does not know them yet and has their statistics counted (dimensions only)."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    keys = Keys.from_json(manifest["keys"])
    fields = {f["name"]: f["type"] for f in manifest["grain"]["fields"]}
    # A partition column comes last in a table.
    columns = [c for c in fields if c != "year"] + ["year"]
    listed = ", ".join(f"`{c}` {'bigint' if fields[c] == 'long' else fields[c]}" for c in columns)
    grain = _name(path, "grain")
    if not spark.catalog.tableExists(grain):
        spark.sql(
            f"CREATE TABLE {grain} ({listed}) USING PARQUET PARTITIONED BY (year) "
            f"CLUSTERED BY (plant_id) SORTED BY (plant_id) INTO {manifest['buckets']} BUCKETS "
            f"LOCATION '{path}/grain'"
        )
        spark.catalog.recoverPartitions(grain)
    for name in SCHEMAS:
        table = _name(path, name)
        if not spark.catalog.tableExists(table):
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name].fields)
            spark.sql(f"CREATE TABLE {table} ({kinds}) USING PARQUET LOCATION '{path}/{name}'")
            if name != "measurement":
                spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    frames = {name: spark.table(_name(path, name)) for name in SCHEMAS}
    return Tables(frames, keys=keys, grain=spark.table(grain), enriched=True)
