"""Explicit schemas of the ten base tables (never inferred).

Every column is nullable: the base data is external and its constraints
cannot be verified, so code treats each key as possibly NULL or orphaned.
Integers are BIGINT throughout: files with narrower ones widen in the scan,
and filters on them still reach it.
"""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _D = T.LongType(), T.StringType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SCHEMAS: dict[str, T.StructType] = {
    "region": _struct(("region_id", _L), ("region_name", _S)),
    "state": _struct(("state_id", _L), ("region_id", _L), ("state_code", _S), ("state_name", _S)),
    "municipality": _struct(("municipality_id", _L), ("state_id", _L)),
    "office": _struct(("office_id", _L), ("institution_id", _L)),
    "institution": _struct(
        ("institution_id", _L), ("institution_name", _S), ("institution_type", _S)
    ),
    "plant": _struct(
        ("plant_id", _L), ("municipality_id", _L), ("office_id", _L), ("filtration_type", _S)
    ),
    "point": _struct(("point_id", _L), ("point_type", _S), ("point_name", _S)),
    "parameter": _struct(
        ("parameter_id", _L), ("parameter_name", _S), ("unit", _S), ("category", _S)
    ),
    "band": _struct(("band_id", _L), ("band_name", _S)),
    "measurement": _struct(
        ("measurement_id", _L),
        ("plant_id", _L),
        ("point_id", _L),
        ("parameter_id", _L),
        ("band_id", _L),
        ("value", _D),
        ("month", _L),
        ("year", _L),
    ),
}

TABLE_NAMES: tuple[str, ...] = tuple(SCHEMAS)
