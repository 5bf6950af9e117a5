"""Awkward rows that every operator must take: null ids and texts, empty and
blank texts, a very long text, repeated rows, one id with two texts, and
columns whose names the operators use themselves."""

from __future__ import annotations

import random

CLASHING = (
    "id row source fp node root first word batch k c ids toxicity spans items label n_words "
    "text_hash shard gram asked"
).split()


def prose(seed: int, words: int, vocabulary: int = 60) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}x" for _ in range(words))


def awkward_rows() -> list[tuple[int | None, str | None]]:
    shared = prose(1, 80)
    return [
        (10, shared),
        (11, prose(2, 30) + " " + shared + " " + prose(3, 20)),
        (11, prose(4, 70)),
        (12, None),
        (13, ""),
        (14, " \t\n \x0b\x0c\r "),
        (15, "one"),
        (16, "Ünï ÇØDÉ ß İΣ 漢字 \U0001f600\u2028x"),
        (17, prose(5, 30_000, 3_000)),
        (18, shared),
        (18, shared),
        (None, shared),
        (None, None),
        (19, "same " * 200),
    ]


def documents(spark, rows=None):
    """``rows`` with the clashing columns added, all null."""
    df = spark.createDataFrame(awkward_rows() if rows is None else rows, "doc_id long, text string")
    return df.selectExpr("*", *[f"CAST(NULL AS STRING) AS `{c}`" for c in CLASHING])


def tuples(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def key(row: tuple) -> tuple:
    return tuple((v is None, v if v is not None else 0) for v in row)
