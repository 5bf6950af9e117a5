"""Operator 12, filter interaction audit: existential self-join.

Five filters are applied to every whole text (fixed values of the contract,
below).  Four look at the text alone; the fifth fails a text that a document
with a smaller id has too.  It is an existential question, so it is a left-semi
join of the documents with themselves on (hash, exact text, smaller id); only
texts whose hash more than one id has reach it, and its right side is one row a
text, the smallest id, so a text that a third of all rows share costs one row
there.  The marked ids are united with the ids that fail another filter, and
the documents of a part are counted by combination of failures: at most 31
counts a part, from which all 120 orders follow without another look at the
documents.

Rows: a null text or lang is empty, a null id is smaller than none and larger
than none, so it never fails filter E, and matches no label.  Rows with one id
count one by one (two equal texts under one id are not copies of each other).
A document is good or toxic if any of its label rows says so.  Texts of any length, ties, repeated
rows and columns of other names are fine; an empty table gives no part.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrostar.llm.common import UPPER, arrow_pass, stored

# The filters, their letters and their limits.
FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SYMBOLS = b"#$%&*|"

BIT = {letter: 1 << k for k, letter in enumerate(FILTERS)}
_UPPER = UPPER.encode()
_CONTINUED = bytes(range(0x80, 0xC0))


def text_failures(raw: bytes) -> int:
    """The filters A to D that a text (in UTF-8) fails, as bits.

    ``bytes.split`` cuts at exactly the characters that separate words."""
    words = raw.split()
    n = len(words)
    bits = BIT["A"] if n < MIN_WORDS else 0
    if 100 * len(set(words)) < MIN_DISTINCT_PERCENT * n:
        bits |= BIT["B"]
    upper = len(raw) - len(raw.translate(None, _UPPER))
    if 100 * upper > MAX_UPPER_PERCENT * len(raw.translate(None, _CONTINUED)):
        bits |= BIT["C"]
    if len(raw.translate(None, SYMBOLS)) != len(raw):
        bits |= BIT["D"]
    return bits


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash, bits (A to D) of every row, in its own order."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array(map(text_failures, texts), pa.int32()),
            ],
            names=["doc_id", "part", "hash", "bits"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(
        docs, rows, f"doc_id {kind}, part string, hash binary, bits int", slice_bytes=4 << 20
    )


def _copies(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """doc_id, part, hash of the rows whose text a smaller id has."""
    ids = measured.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = stored(ids.where("low < high").select("hash"), "audit-hashes")
    hashed = docs.withColumn("hash", F.unhex(F.sha2("text", 256)))
    # Both sides of each join are stored tables, plain shuffles that AQE can
    # split where one text fills much of the table.  Either side grows with the
    # table, so neither join is ever a broadcast.
    mine = stored(hashed.join(shared.hint("merge"), "hash"), "audit-copies")
    first = mine.groupBy("hash", "text").agg(F.min("doc_id").alias("first"))
    first = stored(first, "audit-firsts").alias("theirs")
    mine = mine.alias("mine")
    same = (
        (F.col("mine.hash") == F.col("theirs.hash"))
        & (F.col("mine.text") == F.col("theirs.text"))
        & (F.col("theirs.first") < F.col("mine.doc_id"))
    )
    return mine.join(first.hint("merge"), same, "left_semi").select("doc_id", "part", "hash")


def failures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, part, bits, n) of the documents that fail a filter, n equal
    rows each, and (part, total) of all documents."""
    texts = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    measured = stored(_measured(texts), "audit-measured")
    alone = measured.where("bits > 0").withColumns({"alone": F.lit(1), "copied": F.lit(0)})
    copied = _copies(texts, measured).withColumns(
        {"bits": F.lit(BIT["E"]), "alone": F.lit(0), "copied": F.lit(1)}
    )
    # Rows with equal id, part and text fail the same filters, so either count
    # of them is their number.
    failing = (
        alone.unionByName(copied)
        .groupBy("doc_id", "part", "hash")
        .agg(
            F.bit_or("bits").alias("bits"),
            F.greatest(F.sum("alone"), F.sum("copied")).alias("n"),
        )
        .drop("hash")
    )
    return failing, measured.groupBy("part").agg(F.count("*").alias("total"))


def _combinations(failing: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: documents by combination of failures."""

    def says(label: str) -> Column:
        return F.max(F.coalesce(F.col(label) == 1, F.lit(False)).cast("int")).alias(label)

    known = stored(
        labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic")),
        "audit-labels",
    )
    return (
        failing.join(known, "doc_id", "left")
        .groupBy("part", "bits")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"),
            F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley of the step's filter."""
    failing, totals = failures(docs)
    cells = totals.join(_combinations(failing, labels), "part", "left")
    orders = [F.lit("".join(p)) for p in permutations(FILTERS)]
    rows = (
        cells.withColumn("filter_order", F.explode(F.array(*orders)))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    )
    order, step, bits = F.col("filter_order"), F.col("step"), F.col("bits")

    def mask(letters: Column) -> Column:
        return sum(
            (F.when(F.contains(letters, F.lit(x)), bit).otherwise(0) for x, bit in BIT.items()),
            F.lit(0),
        )

    mine = mask(F.substring(order, step, F.lit(1)))
    before = mask(F.substring(order, F.lit(1), step - 1))
    fails, gone = bits.bitwiseAND(mine) > 0, bits.bitwiseAND(before) > 0
    # The filter of a document with k failures comes first in 120 / k orders.
    orders_first = F.lit(len(orders)) / F.bit_count(bits)

    def count(value: Column | str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")

    n = F.col("n")
    return rows.groupBy("part", "filter_order", "step").agg(
        (F.first("total") - count(n, fails | gone)).alias("kept"),
        count(n, fails & ~gone).alias("removed"),
        count(n, fails & gone).alias("redundant"),
        count(n, bits == mine).alias("unique_fails"),
        count(F.col("good"), fails & ~gone).alias("good_lost"),
        count(F.col("toxic"), fails & ~gone).alias("toxic_lost"),
        count(n * orders_first.cast("long"), fails).alias("shapley"),
    )
