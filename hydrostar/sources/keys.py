"""Verified keys: what a check of the tables has proven about them.

The base data has no enforced constraints, so without proof every lookup is
weighted (a repeated key repeats its matches) and every inner join that only
tests existence is executed.  ``verify`` checks the keys once, when tables are
loaded or written, and the plans leave out what the proof makes unnecessary:

* ``unique``: the tables whose key never repeats; no weighting aggregate;
* ``contained``: the references (child column) whose non-NULL values all exist
  in their parent; an existence join becomes a NULL test;
* ``dense``: the keys that fill their range well enough for bitmaps.

A proof holds for the files it was made on.  It is stored with written tables
(``sources.gold``), never assumed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import functions as F

# table -> its key column
KEY_OF = {
    "region": "region_id",
    "state": "state_id",
    "municipality": "municipality_id",
    "office": "office_id",
    "institution": "institution_id",
    "plant": "plant_id",
    "point": "point_id",
    "parameter": "parameter_id",
    "band": "band_id",
}
# references that some query joins: (child, column) -> parent
REFERENCES = {
    ("state", "region_id"): "region",
    ("municipality", "state_id"): "state",
    ("office", "institution_id"): "institution",
    ("plant", "municipality_id"): "municipality",
    ("plant", "office_id"): "office",
    ("measurement", "plant_id"): "plant",
    ("measurement", "parameter_id"): "parameter",
}
# A bitmap spends a bit an id; at most this many bits a row of the table, and
# this many in all: a task that meets ids of every block of every group sends
# whole blocks for single ids, so there may be few blocks.
MAX_BITS_A_ROW = 64
MAX_BITS = 1 << 20


@dataclass(frozen=True)
class Keys:
    unique: frozenset[str] = frozenset()
    contained: frozenset[str] = frozenset()
    dense: frozenset[str] = frozenset()

    def to_json(self) -> dict[str, list[str]]:
        return {name: sorted(found) for name, found in asdict(self).items()}

    @classmethod
    def from_json(cls, value: dict[str, list[str]]) -> Keys:
        return cls(**{name: frozenset(found) for name, found in value.items()})


NOTHING = Keys()


def verify(tables, references: Iterable[tuple[str, str]] = tuple(REFERENCES)) -> Keys:
    """Check every key (one aggregate a dimension) and the given references (one
    anti join of its distinct values each).  Runs jobs; only one row of figures a
    check comes back."""
    unique, dense, contained = set(), set(), set()
    for table, key in KEY_OF.items():
        n, distinct, low, high = (
            getattr(tables, table)
            .agg(F.count(key), F.count_distinct(key), F.min(key), F.max(key))
            .first()
        )
        if n == distinct:
            unique.add(table)
        if n and low >= 0 and high < min(MAX_BITS_A_ROW * n, MAX_BITS):
            dense.add(key)
    for child, column in references:
        parent = REFERENCES[child, column]
        used = getattr(tables, child).select(column).where(F.col(column).isNotNull()).distinct()
        known = getattr(tables, parent).select(F.col(KEY_OF[parent]).alias(column))
        if used.join(known, column, "left_anti").isEmpty():
            contained.add(f"{child}.{column}")
    return Keys(frozenset(unique), frozenset(contained), frozenset(dense))
