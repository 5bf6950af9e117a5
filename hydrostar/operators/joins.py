"""Literal rule tables.  Join strategies are left to the planner and AQE."""

from __future__ import annotations

from pyspark.sql import DataFrame


def literal_table(spark, rows, schema: str) -> DataFrame:
    """A rule table given in code.

    ``schema`` is a DDL list such as ``"name STRING, rank INT"``.  Built as
    an inline ``VALUES`` table with bound parameters (values are passed, not
    spliced into SQL text): Spark keeps it as a local relation, so it needs
    no Python worker and no RDD, and the planner knows its size.
    """
    fields = [f.strip().split() for f in schema.split(",")]
    args: dict[str, object] = {}
    tuples = []
    for i, row in enumerate(rows):
        marks = []
        for j, (value, (_, dtype)) in enumerate(zip(row, fields)):
            args[f"v{i}_{j}"] = value
            marks.append(f"CAST(:v{i}_{j} AS {dtype})")
        tuples.append("(" + ", ".join(marks) + ")")
    names = ", ".join(n for n, _ in fields)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(tuples)} AS t({names})", args=args)
