"""Adaptor from the driver's TPC-H-style test tables to the ten-table schema.

The mapping (FIXTURES.md §2) renames columns and plants NULLs, blanks and the
text 'None' where the generated tables have none, so that every NULL rule of
the queries is exercised.  All of it is lazy column arithmetic: Catalyst
prunes the unused source columns and pushes filters through it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrostar.operators.joins import literal_table
from hydrostar.sources.tables import Tables

# FIXED VALUES of the fixture mapping: market segment -> office offset, and
# the three value bands (id, name).
SEGMENT_OFFSET = (
    ("AUTOMOBILE", 0),
    ("BUILDING", 1),
    ("FURNITURE", 2),
    ("HOUSEHOLD", 3),
)
SEGMENT_OTHER = 4
FIXTURE_BANDS = ((1, "A"), (2, "N"), (3, "R"))
RETURNFLAG_BAND = (("A", 1), ("N", 2))
RETURNFLAG_OTHER = 3


# Declared schemas of the source columns the mapping reads (no inference).
_I32, _I64, _F64, _STR = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
SOURCE_SCHEMAS: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(c, t, True) for c, t in cols])
    for name, cols in {
        "region": [("r_regionkey", _I32), ("r_name", _STR)],
        "nation": [("n_nationkey", _I32), ("n_name", _STR), ("n_regionkey", _I32)],
        "customer": [("c_custkey", _I64), ("c_nationkey", _I32), ("c_mktsegment", _STR)],
        "orders": [("o_orderkey", _I64), ("o_custkey", _I64), ("o_orderpriority", _STR)],
        "supplier": [("s_suppkey", _I64), ("s_name", _STR), ("s_nationkey", _I32)],
        "part": [
            ("p_partkey", _I64),
            ("p_name", _STR),
            ("p_brand", _STR),
            ("p_type", _STR),
            ("p_size", _I32),
        ],
        "lineitem": [
            ("l_orderkey", _I64),
            ("l_partkey", _I64),
            ("l_suppkey", _I64),
            ("l_linenumber", _I32),
            ("l_quantity", _F64),
            ("l_tax", _F64),
            ("l_returnflag", _STR),
            ("l_shipdate", T.TimestampNTZType()),
        ],
    }.items()
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _segment_offset(col: str) -> F.Column:
    expr = None
    for seg, off in SEGMENT_OFFSET:
        cond = F.col(col) == F.lit(seg)
        expr = F.when(cond, F.lit(off)) if expr is None else expr.when(cond, F.lit(off))
    return expr.otherwise(F.lit(SEGMENT_OTHER))


def _region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("region_id"),
        F.col("r_name").alias("region_name"),
    )


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("state_id"),
        F.col("n_regionkey").cast("long").alias("region_id"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias(
            "state_code"
        ),
        F.col("n_name").alias("state_name"),
    )


def _municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("municipality_id"),
        F.col("c_nationkey").cast("long").alias("state_id"),
    )


def _institution_key() -> F.Column:
    return (F.col("c_nationkey") * 5 + _segment_offset("c_mktsegment")).cast("long")


def _office(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("office_id"),
        _institution_key().alias("institution_id"),
    )


def _institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(
        _institution_key().alias("institution_id"),
        F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string")).alias(
            "institution_name"
        ),
        F.col("c_mktsegment").alias("institution_type"),
    ).distinct()


def _plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("plant_id"),
        F.col("o_custkey").cast("long").alias("municipality_id"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("long"))
        .otherwise(F.col("o_custkey").cast("long"))
        .alias("office_id"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
        .otherwise(F.col("o_orderpriority"))
        .alias("filtration_type"),
    )


def _point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("long").alias("point_id"),
        F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("point_type"),
        F.col("s_name").alias("point_name"),
    )


def _parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("parameter_id"),
        F.when(F.col("p_size") == 49, F.lit(None).cast("string"))
        .when(F.col("p_size") == 50, F.lit(""))
        .otherwise(F.col("p_name"))
        .alias("parameter_name"),
        F.when(F.col("p_size") <= 5, F.lit("None"))
        .when(F.col("p_size") <= 8, F.lit(None).cast("string"))
        .otherwise(F.col("p_brand"))
        .alias("unit"),
        F.col("p_type").alias("category"),
    )


def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_table(spark, FIXTURE_BANDS, "band_id BIGINT, band_name STRING")


def _measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag_band = None
    for flag, band_id in RETURNFLAG_BAND:
        cond = F.col("l_returnflag") == F.lit(flag)
        flag_band = F.when(cond, F.lit(band_id)) if flag_band is None else flag_band.when(
            cond, F.lit(band_id)
        )
    flag_band = flag_band.otherwise(F.lit(RETURNFLAG_OTHER))
    return _read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("measurement_id"),
        F.col("l_orderkey").cast("long").alias("plant_id"),
        F.when((F.col("l_linenumber") == 6) & (F.col("l_tax") == 0), F.lit(None).cast("long"))
        .otherwise(F.col("l_suppkey").cast("long"))
        .alias("point_id"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0), F.lit(None).cast("long"))
        .otherwise(F.col("l_partkey").cast("long"))
        .alias("parameter_id"),
        flag_band.cast("long").alias("band_id"),
        F.col("l_quantity").cast("double").alias("value"),
        F.month("l_shipdate").cast("long").alias("month"),
        F.year("l_shipdate").cast("long").alias("year"),
    )


_MAKERS = {
    "region": _region,
    "state": _state,
    "municipality": _municipality,
    "office": _office,
    "institution": _institution,
    "plant": _plant,
    "point": _point,
    "parameter": _parameter,
    "band": _band,
    "measurement": _measurement,
}


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The ten tables from ``<sf_dir>/{region,nation,...}.parquet``, each
    defined when it is first used."""
    makers = {name: partial(make, spark, sf_dir) for name, make in _MAKERS.items()}
    return Tables(makers)
