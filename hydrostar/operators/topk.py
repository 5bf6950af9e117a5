"""Top-k by an order that is made total with unique tie-breakers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows of ``df`` in ``order``.

    ``order`` must end with keys that make it total, otherwise ties at rank
    k are cut arbitrarily.  Planned as ``TakeOrderedAndProject``: each task
    keeps its own k best, one task merges k per task.
    """
    return df.orderBy(*order).limit(k)
