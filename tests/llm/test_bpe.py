from __future__ import annotations

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hydrostar.llm import bpe
from hydrostar.llm.queries import tokenizer_path
from tests.conftest import SF01
from tests.llm.frames import awkward_rows, documents

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(open(PATH, encoding="utf-8").read())
DECODER = bpe.Decoder(open(PATH, encoding="utf-8").read())


def same(texts):
    for text, ids in zip(texts, ENCODER.encode(texts)):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert DECODER.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40).filter(lambda t: t.isprintable() or "\ud800" not in t), max_size=5))
def test_any_text_as_the_library(texts):
    same([t.encode("utf-8", "ignore").decode() for t in texts])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("the ing 's 'll é É ß \x1c \x85 <|endoftext|> < Σ ς ŉ 1 ½ ª , \n ́".split(" ")), max_size=12))
def test_awkward_pieces_as_the_library(parts):
    same(["".join(parts), " ".join(parts)])


def test_long_words_and_cache_restarts(monkeypatch):
    monkeypatch.setattr(ENCODER, "cached_words", 50)
    same(["a" * 3000, "ab" * 700 + "c", "漢" * 500, *[f"word{k} other{k}" for k in range(200)]])
    same([f"again{k} the" for k in range(120)])


def test_documents(spark):
    rows = awkward_rows()
    df = documents(spark, rows).repartition(3)
    out = bpe.digests(bpe.decode(bpe.encode(df, PATH), PATH))
    got = sorted(map(str, out.collect()))

    def want(i, text):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return spark.createDataFrame(
            [(i, len(ids), sha(raw), sha(decoded.encode()))], out.schema
        ).first()

    assert got == sorted(str(want(*r)) for r in rows)
    once = bpe.digests(bpe.round_trip(df, PATH))
    assert sorted(map(str, once.collect())) == got
    assert bpe.digests(bpe.decode(bpe.encode(documents(spark, []), PATH), PATH)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in bpe.encode(df, PATH).collect():
        want = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want


def changed(**parts) -> str:
    spec = json.loads(open(PATH, encoding="utf-8").read())
    return json.dumps(spec | parts)


SPEC = json.loads(open(PATH, encoding="utf-8").read())
OTHER_FILES = {
    "case kept": changed(normalizer={"type": "NFC"}),
    "no normalizer, runs of digits, spaces kept": changed(
        normalizer=None,
        pre_tokenizer={
            "type": "Sequence",
            "pretokenizers": [
                {
                    "type": "Split",
                    "pattern": {"Regex": r"\p{N}+| ?[^\s\p{N}]+"},
                    "behavior": "Isolated",
                    "invert": False,
                },
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
    "no word ends": open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(),
}
TEXTS = [
    "Hello World 2024",
    "it's  ÇØDÉ ß İΣ 漢字 \U0001f600\u2028x <|endoftext|>",
    " \t\n ",
    "",
    "don't 12345 they'll\n\nNEW line " + "a" * 200,
]


@pytest.mark.parametrize("name", sorted(OTHER_FILES))
def test_other_files_rule_as_they_say(name):
    library = Tokenizer.from_str(OTHER_FILES[name])
    encoder, decoder = bpe.Encoder(OTHER_FILES[name]), bpe.Decoder(OTHER_FILES[name])
    for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_files_with_rules_not_followed_are_refused():
    for text in (
        changed(model=SPEC["model"] | {"dropout": 0.1}),
        changed(model=SPEC["model"] | {"continuing_subword_prefix": "##"}),
        changed(pre_tokenizer={"type": "Whitespace"}),
        changed(added_tokens=[SPEC["added_tokens"][0] | {"lstrip": True}]),
    ):
        with pytest.raises(ValueError, match="not supported"):
            bpe.Encoder(text)


def test_vocabulary_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 1000)
    with pytest.raises(ValueError, match="larger"):
        bpe.encode(documents(spark, []), PATH)
