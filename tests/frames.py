"""Small hand-made table bundles for edge cases (built in memory)."""

from __future__ import annotations

from hydrostar.sources.schema import SCHEMAS
from hydrostar.sources.tables import Tables, tables_from_frames


def bundle(spark, **rows) -> Tables:
    """Tables from lists of tuples in schema column order; missing tables
    are empty."""
    frames = {}
    for name, schema in SCHEMAS.items():
        data = rows.get(name, [])
        frames[name] = spark.createDataFrame(data, schema)
    return tables_from_frames(frames)


def geo(n_states: int = 2):
    """Two regions, states 1..n with region (s % 2) + 1."""
    region = [(1, "North"), (2, "South")]
    state = [(s, (s % 2) + 1, f"S{s}", f"State {s}") for s in range(1, n_states + 1)]
    return dict(region=region, state=state)
