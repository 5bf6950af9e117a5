"""The corpus pipeline: documents in, clean encoded documents out.

Each stage works on everything that its predecessor kept, applies one
operator of ``hydrostar.llm`` and returns the columns of ``documents``, except
the last, which returns the encoded documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostar.llm import bpe, decontam, simhash, substrings, toxicity
from hydrostar.llm.common import stored, table
from hydrostar.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _columns(rows: DataFrame, columns: list[str], changed: Column | None = None) -> DataFrame:
    """``columns`` of the struct ``source``; n_chars follows a text that
    changed."""
    picked = []
    for c in columns:
        value = F.col(f"source.`{c}`")
        if c == "n_chars" and changed is not None:
            kind = rows.schema["source"].dataType[c].dataType
            value = F.when(changed, F.length("source.text").cast(kind)).otherwise(value)
        picked.append(value.alias(c))
    return rows.select(*picked)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labelled
    documents still there, outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return _columns(scored.where(F.col("toxicity") < 0.5), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.keep_first(docs, shingle=4, distance=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that a document with a
    smaller id has too; a text that loses every word stays as an empty one."""
    freed = substrings.remove_repeats(docs, window=50)
    return _columns(freed, docs.columns, F.col("n_removed") > 0)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans of words that benchmark phrases cover."""
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"), clean=True)
    return _columns(found, docs.columns, F.size("spans") > 0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers), their number, and the
    digests of the ids and of the text decoded from them."""
    return bpe.digests(bpe.round_trip(docs, tokenizer_path()), more=["ids"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("BPE encoding and decoding", encode),
]

# No SQL: the toxicity stage is a trained model and the near-copy stage needs
# XXH64; tests/llm hold the rows against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each stage's rows are written as
    Parquet in the shared folder and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
