"""Contexts that run on across words, against the definition."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from hydrostar.llm import ctw
from tests.llm.frames import awkward_rows, documents
from tests.llm.test_ctw import Tree, blended, cut, held


class WholeTree(Tree):
    """The tree whose contexts run on across words, node by node."""

    def __init__(self, train, depth):
        super().__init__([], depth)
        for words in train:
            line = self.line(words)
            for k in range(depth, len(line)):
                self.event(line[k - depth : k], line[k])
            for w in words:
                closed = w + b" "
                for k in range(depth, len(closed)):
                    at = self.prefix.setdefault(closed[:k], {})
                    at[closed[k]] = at.get(closed[k], 0) + 1

    def line(self, words):
        return b"\n" * (self.depth - 1) + b" " + b"".join(w + b" " for w in words) + b"\n"

    def leaf(self, context):
        return len(context) == self.depth

    def text(self, words):
        line, d = self.line(words), self.depth
        shallow = sum(math.log10(self.byte(line[k - d : k], line[k])) for k in range(d, len(line)))
        return shallow + sum(self.added(w) for w in words)

    def added(self, w):
        """What the whole word so far adds (Tree.word has the word's own
        bytes without it in the same places)."""
        kept, self.prefix = self.prefix, {}
        without = self.word(w)
        self.prefix = kept
        return self.word(w) - without


def scores(spark, rows, depth, **how):
    out = ctw.score(documents(spark, rows), ctw.contract_fold(), depth=depth, across_words=True, **how)
    return {r["doc_id"]: r["score"] for r in out.collect()}


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_across_words_against_the_definition(spark, depth, monkeypatch):
    monkeypatch.setattr(ctw, "PIECE_BYTES", 64)
    monkeypatch.setattr(ctw, "SHARD_BYTES", 150)
    rnd = random.Random(depth)
    parts = ["th", "er", "on", "a", "ing", "é", "\0"]
    word = lambda: "".join(rnd.choices(parts, k=rnd.randrange(1, 5)))
    rows = [(k, " ".join(word() for _ in range(rnd.randrange(30)))) for k in range(40)]
    tree = WholeTree([cut(t) for i, t in rows if not held(i)], depth)
    got = scores(spark, rows, depth)
    for i, t in rows:
        assert math.isclose(got[i], tree.text(cut(t)), rel_tol=1e-8), i


def test_order_of_words_matters(spark):
    rows = [(k, "new york is not old york " * 3) for k in range(40)]
    rows += [(100, "new york is not old"), (101, "york new old not is")]
    got = scores(spark, rows, 4)
    assert got[100] > got[101] + 1


def test_awkward_rows_across_words(spark):
    rows = awkward_rows()
    out = ctw.score(documents(spark, rows), ctw.contract_fold(), across_words=True).collect()
    assert len(out) == len(rows) and all(r["score"] < 0 for r in out)


def many_words(rnd):
    stems = ["https://example.org/a/long/path/that/many/pages/share/", "zz" * 30, "\x01q" * 25, "é" * 9]
    words = {
        (rnd.choice(stems)[: rnd.choice([1, 3, 40, 60])] + "".join(rnd.choices("ab\x02", k=rnd.randrange(4)))).encode()
        for _ in range(120)
    } | {b"lone" + bytes(rnd.choices(b"cdefgh", k=300)), b"x", b"never-seen" * 9}
    return sorted(words), [0 if w[:1] == b"n" else rnd.randrange(4) for w in sorted(words)]


@pytest.mark.parametrize("depth", [1, 2, 4])
@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_prefixes_of_any_length(depth, shards, monkeypatch):
    """Prefixes of far more than 32 bytes, shared, lone and nested, within a
    range of words and across many: every word against the definition, with
    its own prefix table."""
    monkeypatch.setattr(ctw, "REST_BYTES", 37)
    rnd = random.Random(depth)
    words, counts = many_words(rnd)
    table: dict = {}
    for w, n in zip(words, counts):
        for k, byte in enumerate(w + b" "):
            at = table.setdefault(w[:k], {})
            at[byte] = at.get(byte, 0) + n
    one: dict = {}

    def before(context, node):
        return one.setdefault((context, node), rnd.uniform(0.01, 0.99))

    def path(byte):
        return [((256 + byte) >> (8 - t), byte >> (7 - t) & 1) for t in range(8)]

    def want(w):
        total = 0.0
        for k, byte in enumerate(w + b" "):
            if k >= depth:
                for node, bit in path(byte):
                    p = before(w[k - depth : k], node)
                    total += math.log10(blended(table[w[:k]], node, bit, p) / (p if bit else 1 - p))
        return total

    wanted = [want(w) for w in words]
    grams = np.unique(ctw.grams(words, depth)[0])
    bits = []
    for g in grams.tolist():
        context = (g >> 8 & (1 << 48) - 1).to_bytes(depth, "big")
        given = [(before(context, node), bit) for node, bit in path(g & 255)]
        bits.append([math.log(p if bit else 1 - p) for p, bit in given])
    cuts = sorted(rnd.sample(range(1, len(words)), shards - 1))
    ranges = list(zip([0, *cuts], [*cuts, len(words)]))
    outer = [list(ctw.outer_prefixes(words[a:b], counts[a:b], depth)) for a, b in ranges]
    got = []
    for (a, b), mine in zip(ranges, outer):
        others: dict = {}
        for digest, side, length in {x[:3] for x in mine}:
            if sum(any(x[0] == digest for x in rows) for rows in outer) > 1:
                everywhere: dict = {}
                for rows in outer:
                    for x in rows:
                        if x[0] == digest:
                            everywhere[x[3]] = everywhere.get(x[3], 0) + x[4]
                key = np.array(list(everywhere))
                n = np.array(list(everywhere.values()))
                others[length, side] = key & 255, n, np.searchsorted(grams, key)
        key, place, _ = ctw.grams(words[a:b], depth)
        gram_of = np.zeros(sum(map(len, words[a:b])) + b - a, np.int32)
        gram_of[place] = np.searchsorted(grams, key)
        got += ctw.whole_prefixes(
            words[a:b], np.array(counts[a:b]), gram_of, np.array(bits), depth, others
        ).tolist()
    assert got == pytest.approx(wanted, rel=1e-8, abs=1e-9)


def test_a_long_word_counts_to_its_end(spark):
    """A hash of 64 bytes that training holds often is cheap to its end."""
    rnd = random.Random(9)
    often, other = ("".join(rnd.choices("0123456789abcdef", k=64)) for _ in range(2))
    rows = [(k, f"id {often}") for k in range(60)]
    rows += [(100, f"id {often}"), (101, f"id {often[:40]}{other[40:]}")]
    got = scores(spark, rows, 4)
    assert got[100] > got[101] + 20


def test_long_words_give_the_driver_a_bounded_sample(spark, monkeypatch):
    """Ranges are found by a sample on the driver: its bytes do not follow the
    vocabulary's, and shards keep their size and order."""
    monkeypatch.setattr(ctw, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(ctw, "SAMPLE_BYTES", 3 * 300 * (2_000 + 128))
    rnd = random.Random(4)
    long = [b"".join(rnd.choices([b"a", b"b", b"\xff"], k=rnd.randrange(1_000, 3_000))) for _ in range(300)]
    n_bytes = sum(len(w) + 1 for w in long)
    words = spark.createDataFrame([(bytearray(w), 1) for w in long], "word binary, c long")
    dealt = ctw.in_shards(words, len(long), n_bytes)
    assert dealt.select(F.spark_partition_id()).distinct().count() <= 3
    shards: dict = {}
    for r in dealt.collect():
        shards.setdefault(r["shard"], []).append(bytes(r["word"]))
    assert sorted(w for some in shards.values() for w in some) == sorted(long)
    assert n_bytes / 10_000 <= len(shards) <= n_bytes / 10_000 + 4
    assert max(sum(len(w) + 1 for w in some) for some in shards.values()) < 10_000 + 3_001
    in_order = [w for shard in sorted(shards) for w in sorted(shards[shard])]
    assert in_order == sorted(long)


def test_cut_ranges_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(ctw, "SHARD_BYTES", 100)
    monkeypatch.setattr(ctw, "SAMPLE_BYTES", 1)
    rnd = random.Random(7)
    parts = ["th", "er", "on", "a", "ing", "é", "\0", "a/long/path/that/many/pages/share/"]
    word = lambda: "".join(rnd.choices(parts, k=rnd.randrange(1, 5)))
    rows = [(k, " ".join(word() for _ in range(rnd.randrange(20)))) for k in range(30)]
    tree = WholeTree([cut(t) for i, t in rows if not held(i)], 2)
    got = scores(spark, rows, 2)
    for i, t in rows:
        assert math.isclose(got[i], tree.text(cut(t)), rel_tol=1e-8), i


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """Whatever their files' sizes: only the nodes of the first two depths,
    of which there are 256 * 255 at most, may be."""
    plans: dict = {}
    keep = ctw.stored

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def stored(df, name):
        plans[name] = plan(df)
        return keep(df, name)

    monkeypatch.setattr(ctw, "stored", stored)
    out = ctw.score(documents(spark, awkward_rows()), ctw.contract_fold(), across_words=True)
    plans["scores"] = plan(out)
    assert {name for name, text in plans.items() if "Broadcast" in text} <= {"ctw-mix-1", "ctw-mix-2"}
    assert sum("SortMergeJoin" in text for text in plans.values()) > 3
