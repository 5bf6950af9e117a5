"""Operator 11, source divergence audit: count-cell ranking.

How far each source of a language is from the whole language (part ``term``)
and from each other source (part ``pair``).  The divergence of a term depends
on its two counts alone, so terms are grouped by these counts: a cell is
(count in the group, count in the language), or (count in one source, count in
the other), with the number of its terms.  The function f is evaluated once a
cell, in whole numbers.

* ``term``: cells with equal values are merged, values ranked by cumulative
  number of terms, and only the values that begin within the wanted ranks are
  expanded to their terms, in UTF-8 order.
* ``pair``: terms that both sources have give joint cells; the cells with a
  zero follow from each source's own cells minus the joint ones, and the cell
  (0, 0) from the number of kept terms.  No row is made for a term that a
  source does not have.

Texts are cut and counted in Arrow batches, combined within a task up to
``MAX_ENTRIES`` entries, and shuffled once by (language, term).  One row of the
stored table is a kept term with its counts by source, as many as the language
has sources; the result itself is quadratic in that number.

Rows: a null text, lang or source is empty.  Every row counts as a document,
also repeated rows and ids.  Texts of any length, ties, empty tables and
columns of other names are fine; a language without kept terms has pairs of
value 0 and no terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrostar.llm.common import LOWER_TABLE, map_in_arrow, sliced, stored

MIN_DOCUMENTS = 3
TOP_TERMS = 200
# Fixed value: shares are in units of one in so many.
SCALE = 1_000_000_000

# Fixed value: the characters of terms; others are blanked.
TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_TABLE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).translate(
    LOWER_TABLE
)
# A task hands on its counts when it holds more different (group, term).
MAX_ENTRIES = 200_000
SLICE_BYTES = 4 << 20


def _stretches(raw: bytes) -> Iterator[bytes]:
    """A long text in stretches that end before a blank."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        keys, terms, n, docs = [], [], [], []
        for key, (occurring, holding) in held.items():
            keys += [key] * len(occurring)
            terms += occurring
            n += occurring.values()
            docs += map(holding.__getitem__, occurring)
        held.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(n, pa.int64()),
                pa.array(docs, pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        for part in sliced(batch, SLICE_BYTES):
            langs, sources = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts = part.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(langs, sources, texts):
                occurring, holding = held.setdefault((lang, source), (Counter(), Counter()))
                here: set[bytes] = set()
                for stretch in _stretches(text.translate(_TERM_TABLE)):
                    words = stretch.split()
                    occurring.update(words)
                    here.update(words)
                holding.update(here)
            if sum(len(occurring) for occurring, _ in held.values()) > MAX_ENTRIES:
                yield out()
    if held:
        yield out()


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, lang_n, counts (source, n; by source): the terms that at
    least ``min_documents`` documents of the language have."""
    rows = map_in_arrow(
        docs, _count, "lang string, source string, term string, n long, docs long"
    )
    # One shuffle serves both levels of the aggregate.
    by_source = (
        rows.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    return (
        by_source.groupBy("lang", "term")
        .agg(
            F.sum("n").alias("lang_n"),
            F.sum("docs").alias("docs"),
            F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"),
        )
        .where(F.col("docs") >= min_documents)
        .drop("docs")
    )


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact."""
    return F.expr(
        f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(19,0)))"
        f" div nullif(CAST({total} + {terms} AS DECIMAL(20,0)), 0)"
    )


def _f(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, group_total, lang_total, terms of every group."""
    totals = (
        kept.select("lang", F.inline("counts"))
        .groupBy("lang", "source")
        .agg(F.sum("n").alias("group_total"))
    )
    langs = kept.groupBy("lang").agg(
        F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms")
    )
    groups = docs.select("lang", "source").distinct()
    return (
        groups.join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(0, ["group_total", "lang_total", "terms"])
    )


def _top_terms(kept: DataFrame, cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The ``top`` first terms of each group by falling value."""
    valued = (
        cells.join(groups, ["lang", "source"])
        .withColumn("p", _share("n", "group_total", "terms"))
        .withColumn("q", _share("lang_n", "lang_total", "terms"))
        .where("p > q")
        .withColumn("value", _f("p", "q"))
        .select("lang", "source", "n", "lang_n", "cell_terms", "value")
    )
    # A value has at least one term, so the first values suffice; the limit on
    # row_number() is applied before the shuffle as well.
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = (
        valued.groupBy("lang", "source", "value")
        .agg(F.sum("cell_terms").alias("value_terms"))
        .withColumn("place", F.row_number().over(falling))
        .where(F.col("place") <= top)
        .withColumn(
            "before",
            F.coalesce(
                F.sum("value_terms").over(falling.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .where(F.col("before") < top)
        .select("lang", "source", "value", "before")
    )
    wanted = stored(
        valued.join(first, ["lang", "source", "value"]).drop("cell_terms"), "divergence-cells"
    )
    terms = kept.select("lang", "term", "lang_n", F.inline("counts"))
    within = Window.partitionBy("lang", "source", "value").orderBy("term")
    return (
        terms.join(wanted, ["lang", "source", "n", "lang_n"])
        .withColumn("place", F.row_number().over(within))
        .where(F.col("place") <= top)
        .withColumn("rank", F.col("before") + F.col("place"))
        .where(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


def _joint_cells(kept: DataFrame) -> DataFrame:
    """lang, x, y (x before y), nx, ny, w: terms that both sources have."""
    one = kept.select("lang", "counts", F.posexplode("counts").alias("at", "x"))
    rest = F.slice("counts", F.col("at") + 2, F.size("counts"))
    both = one.select("lang", "x", F.explode(rest).alias("y"))
    return both.groupBy(
        "lang",
        F.col("x.source").alias("x"),
        F.col("y.source").alias("y"),
        F.col("x.n").alias("nx"),
        F.col("y.n").alias("ny"),
    ).agg(F.count("*").alias("w"))


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of a language's sources with its divergence."""

    def named(prefix: str) -> DataFrame:
        return groups.select(
            "lang", F.col("source").alias(prefix), F.col("group_total").alias(f"{prefix}_total")
        )

    # The result's own pairs, one row for both directions.
    pairs = stored(
        named("x")
        .join(named("y"), "lang")
        .where("x < y")
        .join(groups.select("lang", "terms").distinct(), "lang"),
        "divergence-pairs",
    )
    keys = ["lang", "x", "y"]
    own = cells.groupBy("lang", "source", "n").agg(F.sum("cell_terms").alias("w"))

    def spread(rows: DataFrame, *parts: tuple[str, str, str]) -> DataFrame:
        each = F.array(*[F.struct(*[F.expr(v).cast("long").alias(c) for v, c in zip(p, ("nx", "ny", "w"))]) for p in parts])
        return rows.select(*keys, F.inline(each))

    weights = (
        spread(_joint_cells(kept), ("nx", "ny", "w"), ("nx", "0", "-w"), ("0", "ny", "-w"), ("0", "0", "w"))
        .unionByName(
            spread(
                pairs.join(own.withColumnRenamed("source", "x"), ["lang", "x"]),
                ("n", "0", "w"),
                ("0", "0", "-w"),
            )
        )
        .unionByName(
            spread(
                pairs.join(own.withColumnRenamed("source", "y"), ["lang", "y"]),
                ("0", "n", "w"),
                ("0", "0", "-w"),
            )
        )
        .unionByName(spread(pairs, ("0", "0", "terms")))
    )
    full = weights.groupBy(*keys, "nx", "ny").agg(F.sum("w").alias("w")).where("w <> 0")
    wide = "decimal(20,0)"
    sums = (
        full.join(pairs, keys)
        .withColumn("px", _share("nx", "x_total", "terms"))
        .withColumn("py", _share("ny", "y_total", "terms"))
        .groupBy(*keys)
        .agg(
            F.sum(F.col("w").cast("decimal(18,0)") * _f("px", "py").cast(wide)).alias("xy"),
            F.sum(F.col("w").cast("decimal(18,0)") * _f("py", "px").cast(wide)).alias("yx"),
        )
    )
    both = F.array(
        F.struct(F.col("x").alias("source"), F.col("y").alias("item"), F.col("xy").alias("value")),
        F.struct(F.col("y").alias("source"), F.col("x").alias("item"), F.col("yx").alias("value")),
    )
    values = (
        pairs.join(sums, keys, "left")
        .select("lang", F.inline(both))
        .withColumn("value", F.coalesce(F.col("value").cast("long"), F.lit(0)))
    )
    # One row for each other source of the language.
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def audit(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group:
    all other sources of its language, and its ``top_terms`` first terms."""
    docs = docs.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    )
    kept = stored(kept_terms(docs, min_documents), "divergence-terms")
    groups = stored(_groups(docs, kept), "divergence-groups")
    cells = stored(
        kept.select("lang", "lang_n", F.inline("counts"))
        .groupBy("lang", "source", "n", "lang_n")
        .agg(F.count("*").alias("cell_terms")),
        "divergence-counts",
    )
    found = _pairs(kept, cells, groups).unionByName(_top_terms(kept, cells, groups, top_terms))
    return found.withColumns(
        {"value": F.col("value").cast("long"), "rank": F.col("rank").cast("int")}
    )
