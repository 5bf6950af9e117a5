"""Sources: the ten-table schema, native loaders and the test-data adaptor."""

from hydrostar.sources.schema import SCHEMAS, TABLE_NAMES
from hydrostar.sources.tables import Tables, load_tables, tables_from_frames
from hydrostar.sources.fixture import fixture_tables

__all__ = [
    "SCHEMAS",
    "TABLE_NAMES",
    "Tables",
    "load_tables",
    "tables_from_frames",
    "fixture_tables",
]
