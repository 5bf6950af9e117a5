"""Reusable DataFrame operators shared by the base and derived queries."""

from hydrostar.operators.joins import literal_table
from hydrostar.operators.rollup import fact_rollup, table_count
from hydrostar.operators.shares import activity_by, share_of_total, sum_of
from hydrostar.operators.topk import top_k

__all__ = [
    "activity_by",
    "fact_rollup",
    "literal_table",
    "share_of_total",
    "sum_of",
    "table_count",
    "top_k",
]
