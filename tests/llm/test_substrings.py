from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from hydrostar.llm import substrings
from tests.llm.frames import awkward_rows, documents, prose


def brute(rows, window):
    """(id, words, removed, kept text) of every row, from the definition."""
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in cut:
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in cut:
        gone = set()
        if i is not None:
            for k in range(len(words) - window + 1):
                if first[tuple(words[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window):
    df = documents(spark, rows).repartition(4)
    freed = substrings.remove_repeats(df, window=window, join_words=True)
    return sorted((tuple(r) for r in substrings.digests(freed).collect()), key=str)


def mosaic(seed, documents_, window):
    """Texts made of own words, shared passages of many lengths, edits at
    their ends and inside, and passages twice in one text."""
    rnd = random.Random(seed)
    pool = [prose(seed * 100 + k, rnd.randrange(window // 2, 4 * window), 400) for k in range(6)]
    rows = []
    for i in range(documents_):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            part = rnd.choice(pool).split() if rnd.random() < 0.7 else prose(rnd.random(), 30).split()
            if rnd.random() < 0.4:
                part = part[rnd.randrange(len(part)) :]
            if rnd.random() < 0.4:
                part[rnd.randrange(len(part))] = f"edit{rnd.random()}"
            parts += part
        rows.append((rnd.randrange(documents_), " ".join(parts)))
    return rows


@pytest.mark.parametrize("window,seed", [(4, 1), (7, 2), (50, 3), (50, 4)])
def test_against_brute_force(spark, window, seed):
    rows = mosaic(seed, 60, window)
    assert run(spark, rows, window) == brute(rows, window)


def test_awkward_rows(spark):
    rows = awkward_rows()
    assert run(spark, rows, 50) == brute(rows, 50)
    assert run(spark, [], 50) == []


def test_rows_of_one_smaller_id_are_not_one_text(spark):
    """Two rows of an id share words 0-39 and 20-79 of a later document."""
    rows = []
    for k in range(40):
        words = prose(500 + k, 80, 100_000).split()
        rows += [(3 * k, " ".join(words[:40] + [f"x{k}"] * 40))]
        rows += [(3 * k, " ".join([f"y{k}"] * 20 + words[20:80]))]
        rows += [(3 * k + 1, " ".join(words))]
    assert run(spark, rows, 50) == brute(rows, 50)


def test_low_variety_text(spark):
    rows = [(k, " ".join("ab"[(j * j // 7 + k) % 2] for j in range(130))) for k in range(8)]
    rows += [(20, "a " * 300), (21, "a " * 120), (22, "b a " * 90)]
    assert run(spark, rows, 50) == brute(rows, 50)


def test_texts_keep_their_form_outside_of_cuts(spark):
    passage = prose(9, 60, 500)
    rows = [(1, passage), (2, f"Before,\n\tthis.  {passage}\nAfter  that.\n"), (3, "clean  text\n"), (4, passage)]
    out = substrings.remove_repeats(documents(spark, rows))
    got = {r["source"]["doc_id"]: r["source"]["text"] for r in out.collect()}
    assert got == {1: passage, 2: "Before,\n\tthis.  After  that.\n", 3: "clean  text\n", 4: ""}


def test_rolling_hashes_depend_on_order_and_content():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    both = np.concatenate([words, words[::-1], words])
    h = substrings.rolling(both, 50, substrings._ROLL[0])
    assert (h[:351] == h[800:1151]).all()
    assert len(set(h[:351].tolist()) | set(h[400:751].tolist())) == 702
