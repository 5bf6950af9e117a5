from __future__ import annotations

import math
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hydrostar.llm import ctw
from tests.llm.frames import awkward_rows, documents

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return (text or "").encode().translate(LOWER).split()


def ln_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def blended(following, node, bit, one):
    """The bit's probability after a whole prefix with ``following`` (next
    byte: count), where the depths before it give a 1 the probability ``one``."""
    pair = [0, 0]
    for y, n in following.items():
        for t in range(8):
            if (256 + y) >> (8 - t) == node:
                pair[y >> (7 - t) & 1] += n
    if not sum(pair):
        return one if bit else 1 - one
    before = pair[0] * math.log(1 - one) + pair[1] * math.log(one)
    weight = 1 / (1 + math.exp(min(max(before - ln_kt(*pair), -700), 700)))
    own = (pair[bit] + 0.5) / (sum(pair) + 1)
    return weight * own + (1 - weight) * (one if bit else 1 - one)


class Tree:
    """The same model from its definition, node by node."""

    def __init__(self, train, depth):
        self.depth, self.count, self.prefix, self.contexts = depth, {}, {}, set()
        self.known: dict = {}
        for words in train:
            for w in words:
                self.add(w)
            self.event(b" ", 10)

    def add(self, w):
        line = b" " + w + b" "
        for k in range(1, len(line)):
            self.event(line[max(0, k - self.depth) : k], line[k])
            if k > self.depth:
                at = self.prefix.setdefault(line[1:k], {})
                at[line[k]] = at.get(line[k], 0) + 1

    def event(self, context, byte):
        for d in range(len(context) + 1):
            suffix = context[len(context) - d :]
            for node, bit in self.path(byte):
                pair = self.count.setdefault((suffix, node), [0, 0])
                pair[bit] += 1
        self.contexts.add(context)

    def path(self, byte):
        return [((256 + byte) >> (8 - t), byte >> (7 - t) & 1) for t in range(8)]

    def leaf(self, context):
        return context[:1] == b" " or len(context) == self.depth

    def weighted(self, context, node):
        if (context, node) not in self.known:
            self.known[context, node] = self._weighted(context, node)
        return self.known[context, node]

    def _weighted(self, context, node):
        pair = self.count.get((context, node), (0, 0))
        kt = ln_kt(*pair)
        if self.leaf(context):
            return kt
        below = sum(
            self.weighted(bytes([c]) + context, node)
            for c in range(256)
            if (bytes([c]) + context, node) in self.count
        )
        high, low = max(kt, below), min(kt, below)
        return high + math.log1p(math.exp(low - high)) - math.log(2)

    def bit(self, context, node, bit):
        done, rest, last = 0.0, 1.0, 0.5
        for d in range(len(context) + 1):
            suffix = context[len(context) - d :]
            a, b = self.count.get((suffix, node), (0, 0))
            if a + b == 0:
                break
            one = (b + 0.5) / (a + b + 1)
            weight = 1.0
            if not self.leaf(suffix):
                weight = math.exp(ln_kt(a, b) - math.log(2) - self.weighted(suffix, node))
            last = done + rest * one
            done, rest = done + rest * weight * one, rest * (1 - weight)
        return last if bit else 1 - last

    def byte(self, context, byte):
        return math.prod(self.bit(context, n, x) for n, x in self.path(byte))

    def word(self, w):
        line, total = b" " + w + b" ", 0.0
        for k in range(1, len(line)):
            context = line[max(0, k - self.depth) : k]
            p = self.byte(context, line[k])
            at = self.prefix.get(line[1:k])
            if k > self.depth and at:
                p = math.prod(
                    blended(at, node, x, self.bit(context, node, 1)) for node, x in self.path(line[k])
                )
            total += math.log10(p)
        return total


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def check(spark, rows, depth):
    out = ctw.score(documents(spark, rows), ctw.contract_fold(), depth=depth).collect()
    train = [cut(t) for i, t in rows if not held(i)]
    tree = Tree(train, depth)
    counts: dict = {}
    for words in train:
        for w in [*words, b"\n"]:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    scale = total + 0.5 * (len(counts) + 1)
    cache: dict = {}
    want = []
    for i, t in rows:
        words = cut(t)
        for w in words:
            if w not in cache:
                cache[w] = tree.word(w)
        base = sum(math.log10((counts.get(w, 0) + 0.5) / scale) for w in [*words, b"\n"])
        lp = sum(cache[w] for w in words) + math.log10(tree.byte(b" ", 10))
        known = sum(w in counts for w in [*words, b"\n"])
        want.append((i, held(i), len(words) + 1, known, total, round(base, 5), round(lp, 5)))
    got = [(*tuple(r)[:5], round(r["base_score"], 5), round(r["score"], 5)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_against_the_definition(spark, depth):
    rnd = random.Random(depth)
    parts = ["th", "er", "on", "a", "ing", "é", "\0"]
    word = lambda: "".join(rnd.choices(parts, k=rnd.randrange(1, 5)))
    rows = [(k, " ".join(word() for _ in range(rnd.randrange(12)))) for k in range(40)]
    rows += [(100, "X" * 90 + " " + "x" * 89), (101, "x" * 90)]
    check(spark, rows, depth)


def test_awkward_rows_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(ctw, "SHARD_BYTES", 40)
    rows = [r for r in awkward_rows() if r[0] != 17]
    check(spark, rows, 2)


def test_very_long_text_and_empty_tables(spark):
    rows = [r for r in awkward_rows() if r[0] in (17, 10)]
    out = ctw.score(documents(spark, rows), ctw.contract_fold()).collect()
    assert {r["doc_id"] for r in out} == {17, 10} and all(r["score"] < 0 for r in out)
    assert ctw.score(documents(spark, []), ctw.contract_fold()).count() == 0


def test_without_training_texts(spark):
    out = ctw.score(documents(spark, [(1, "ab c"), (2, None)]), F.lit(True)).collect()
    got = {r["doc_id"]: r for r in out}
    assert got[2]["n_tokens"] == 1 and got[2]["train_tokens"] == 0
    assert math.isclose(got[1]["bits_per_byte"], 8.0) and math.isclose(got[2]["bits_per_byte"], 8.0)


def test_copies_of_texts_far_apart_travel_small(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("aeilnorst", k=6)) for _ in range(3000)) for _ in range(40)]
    texts += texts
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    docs = docs.selectExpr("id", "false AS held_out", "text")
    sent = ctw.number_words(docs, 2, True).selectExpr("sum(length(line)) AS n").first()["n"]
    whole = b"".join(b" " + t.encode() + b" \n" for t in texts)
    assert sent < 0.8 * len(pa.compress(whole, codec="zstd", asbytes=True))
