from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hydrostar.llm import decontam
from tests.llm.frames import awkward_rows, documents, prose


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(decontam.WORD_PATTERN, text)


def brute(rows, items):
    phrases: dict = {}
    for item, text in items:
        ws = words(text)
        if item is None or not ws:
            continue
        for k in range(max(len(ws) - 9, 1)):
            phrases.setdefault(tuple(ws[k : k + 10]), set()).add(str(item))
    out = []
    for i, text in rows:
        ws = words(text)
        hit, named = set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(ws) - n + 1):
                if found := phrases.get(tuple(ws[k : k + n])):
                    hit.update(range(k, k + n))
                    named |= found
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((i, len(ws), len(hit), len(named), sha, bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, items):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    found = decontam.find(documents(spark, rows).repartition(3), bench)
    return sorted((tuple(r) for r in decontam.report(found).collect()), key=str)


def cases(seed):
    rnd = random.Random(seed)
    items = [(k, prose(seed * 50 + k, rnd.randrange(1, 40), 300)) for k in range(30)]
    items += [(30, "Short ITEM"), (31, "w1x"), (32, None), (33, "?!"), (None, "w2x"), (3, items[3][1])]
    rows = []
    for i in range(50):
        parts = [prose(rnd.random(), rnd.randrange(40), 300)]
        for _ in range(rnd.randrange(4)):
            ws = (rnd.choice(items)[1] or "").split()
            a, b = rnd.randrange(len(ws) + 1), rnd.randrange(len(ws) + 1)
            parts.append("-".join(ws[min(a, b) : max(a, b)]).upper())
            parts.append(rnd.choice(["", "W", "short item.", "w1x"]))
        rows.append((rnd.choice([i, None]), " ".join(parts)))
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows, items = cases(seed)
    assert run(spark, rows, items) == brute(rows, items)


def test_blocks_of_phrases_give_the_same(spark, monkeypatch):
    rows, items = cases(3)
    rows += rows[:5] * 4 + [(7, None), (None, "")]
    monkeypatch.setattr(decontam, "BLOCK_PHRASES", 60)
    assert run(spark, rows, items) == brute(rows, items)


def test_blocks_run_one_after_another(spark, monkeypatch):
    """Many blocks: the result's plan has one Python pass, and texts are cut
    as with one block."""
    rows, items = cases(4)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def cut():
        out = decontam.find(documents(spark, rows), bench, clean=True)
        passes = out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        return passes, sorted((str(r) for r in out.collect()))

    passes, whole = cut()
    monkeypatch.setattr(decontam, "BLOCK_PHRASES", 100)
    many, parts = cut()
    assert passes == many == 1 and parts == whole


def test_awkward_rows_and_empty_tables(spark):
    rows = awkward_rows()
    items = [(1, prose(1, 80)), (2, "ünï çødé"), (3, "same " * 12)]
    assert run(spark, rows, items) == brute(rows, items)
    assert run(spark, rows, []) == brute(rows, [])
    assert run(spark, [], items) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=6))
def test_index_finds_every_occurrence(seq, phrase):
    seq = np.array(seq, np.int64)
    index = decontam.FMIndex(seq, 5)
    padded = np.zeros((1, decontam.WINDOW), np.int64)
    padded[0, decontam.WINDOW - len(phrase) :] = phrase
    lo, hi = index.search(padded, np.array([len(phrase)]))
    found = sorted(index.locate(np.arange(int(lo[0]), int(hi[0]))).tolist())
    n = len(phrase)
    assert found == [k for k in range(len(seq) - n + 1) if seq[k : k + n].tolist() == phrase]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120))
def test_suffix_array(seq):
    want = sorted(range(len(seq)), key=lambda k: seq[k:])
    assert decontam.suffix_array(np.array(seq)).tolist() == want


def test_cuts(spark):
    item = prose(7, 20, 500)
    rows = [(1, f"Intro ({item.upper()}), end."), (2, item), (3, "clean, text.\n"), (4, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontam.find(documents(spark, rows), bench, clean=True).collect()
    got = {r["source"]["doc_id"]: r["source"]["text"] for r in out}
    assert got == {1: "Intro (), end.", 2: "", 3: "clean, text.\n", 4: None}
