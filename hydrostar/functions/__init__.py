"""Column-level helpers, all built from JVM-side Spark functions (no UDFs)."""

from hydrostar.functions.numeric import (
    div_half_even,
    mean_half_even,
    py_round,
    ratio,
    scaled,
)
from hydrostar.functions.text import (
    bucket_label,
    classify,
    cut_label,
    fixed_text,
    percent_text,
    substitute,
    thousands,
)

__all__ = [
    "bucket_label",
    "classify",
    "cut_label",
    "div_half_even",
    "fixed_text",
    "mean_half_even",
    "percent_text",
    "py_round",
    "ratio",
    "scaled",
    "substitute",
    "thousands",
]
