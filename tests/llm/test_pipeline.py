from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from hydrostar.llm import bpe
from hydrostar.llm.queries import tokenizer_path
from tests.conftest import SF001, SF01
from tests.llm.frames import awkward_rows, prose
from tests.llm.test_substrings import brute as brute_repeats
from tests.llm.test_toxicity import corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KIND = "doc_id long, text string, lang string, source string, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder of tables with planted toxic texts, copies, a repeated
    passage and a benchmark passage."""
    folder = str(tmp_path_factory.mktemp("world"))
    toxic = corpus(400)
    text = {i: t for i, t, _ in toxic}
    rows = list(text.items())
    passage, item, twin = prose(901, 70, 5000), prose(902, 30, 5000), prose(903, 1500, 5000)
    own = [prose(1000 + k, 60, 5000) for k in range(6)]
    edited = twin.split()
    edited[75] = "edited"
    rows += [
        (5001, f"{own[0]} {passage}"),
        (5002, f"{own[1]} {passage} {own[2]}"),
        (5003, twin),
        (5004, twin),
        (5005, " ".join(edited)),
        (5006, f"{own[3]} {item} {own[4]}"),
        (5007, own[5]),
    ]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, toxic, own, passage


def test_planted_cases(spark, world):
    folder, toxic, own, passage = world
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    encoder = bpe.Encoder(open(tokenizer_path(), encoding="utf-8").read())
    ids = lambda text: encoder.encode([text])[0]
    bad = {i for i, _, y in toxic if y}
    assert len(bad & set(out)) <= 0.05 * len(bad)
    clean = {i: t for i, t, y in toxic if not y and len(t.split()) > 30}
    assert all(bytes(out[i]["ids"]) == ids(t) for i, t in clean.items())
    assert 5003 in out and not {5004, 5005} & set(out)
    assert bytes(out[5001]["ids"]) == ids(f"{own[0]} {passage}")
    assert bytes(out[5002]["ids"]) == ids(f"{own[1]} {own[2]}")
    assert bytes(out[5006]["ids"]) == ids(f"{own[3]} {own[4]}")
    assert bytes(out[5007]["ids"]) == ids(own[5])
    for r in out.values():
        assert r["n_tokens"] == len(np.frombuffer(bytes(r["ids"]), "<u4"))


def test_stages_keep_the_columns(spark, world):
    folder = world[0]
    docs = frame(spark, awkward_rows())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        for r in out.collect():
            assert r["n_chars"] == len(r["text"] or "")
        assert stage(spark, docs.where("false"), folder).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count()


def test_substring_stage_counts(spark, world):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = corpus_pipeline.cut_repeats(spark, docs, SF001).collect()
    want = {i: n - gone for i, n, gone, _ in brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], 50)}
    assert {r["doc_id"]: len((r["text"] or "").encode().split()) for r in out} == want


def test_whole_pipeline_on_the_given_tables(spark):
    out = corpus_pipeline.run(spark, SF01)
    n = out.count()
    assert 500 < n < 1000 and out.select("doc_id").distinct().count() == n
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
