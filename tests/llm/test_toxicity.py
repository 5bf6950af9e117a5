from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from hydrostar.llm import toxicity
from tests.llm.frames import awkward_rows, documents, prose

INSULTS = ("blockhead", "nitwitted", "scoundrel")


def misspelt(rnd, word):
    k = rnd.randrange(1, len(word) - 1)
    return word[:k] + rnd.choice("aeiou310") + word[k + 1 :]


def corpus(n, start=0):
    rnd = random.Random(start)
    rows = []
    for k in range(n):
        ws = prose(start * n + k, rnd.choice([3, 8, 40, 300]), 4000).split()
        toxic = k % 5 == 0
        if toxic:
            ws.insert(rnd.randrange(len(ws)), rnd.choice(INSULTS) + rnd.choice(["", ",", "."]))
        rows.append((start * n + k, " ".join(ws), int(toxic)))
    return rows


def fitted(spark, rows):
    docs = documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    return toxicity.fit(docs, labels)


def test_held_out_accuracy_and_unseen_misspellings(spark):
    model = fitted(spark, corpus(900))
    fresh = corpus(500, start=7)
    found = toxicity.scores([r[1] for r in fresh], model) >= 0.5
    truth = np.array([r[2] == 1 for r in fresh])
    assert (found & truth).sum() >= 0.95 * truth.sum()
    assert (found & ~truth).sum() <= 0.01 * (~truth).sum()
    rnd = random.Random(3)
    spelt = [prose(k, 6) + " " + misspelt(rnd, w) for k in range(20) for w in INSULTS]
    assert (toxicity.scores(spelt, model) >= 0.5).mean() >= 0.6
    long = prose(1, 20_000, 3000).split()
    assert toxicity.scores([" ".join(long)], model)[0] < 0.5
    long[12_345] = "BLOCKHEAD"
    assert toxicity.scores([" ".join(long)], model)[0] >= 0.5


def test_rows_and_order_do_not_change_the_model(spark):
    rows = corpus(120)
    a, b = fitted(spark, rows), fitted(spark, rows[::-1])
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_awkward_rows(spark):
    model = fitted(spark, corpus(120))
    rows = awkward_rows()
    out = toxicity.score(documents(spark, rows), model)
    got = out.select("source.doc_id", "source.text", F.col("toxicity").alias("score")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if not (r["text"] or "").strip(" \t\n\x0b\x0c\r")}
    assert len(blank) == 1 and blank.pop() < 0.5
    same = {r["score"] for r in got if r["doc_id"] == 18}
    assert len(same) == 1
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_one_class_or_no_labels(spark):
    rows = corpus(30)
    clean = [(i, t, 0) for i, t, _ in rows]
    assert (toxicity.scores(["any text", ""], fitted(spark, clean)) < 0.5).all()
    nothing = toxicity.fit(documents(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scores(["any"], nothing)[0] == 0.5


def test_windows_cover_every_run_of_words():
    texts = [" ".join(f"a{j}" for j in range(n)) for n in (0, 1, 7, 8, 9, 12, 13, 40)] + [None]
    words = toxicity.Words.of(texts)
    for at_once in (1 << 18, 5):
        toxicity.WORDS_AT_ONCE, before = at_once, toxicity.WORDS_AT_ONCE
        try:
            found = toxicity.Windows.of(words, 8, 4)
        finally:
            toxicity.WORDS_AT_ONCE = before
        got = [[] for _ in found.of_text]
        for w, k in zip(found.window.tolist(), found.word.tolist()):
            got[w].append(words.unique[k].decode())
        want, owner = [], []
        for k, text in enumerate(texts):
            ws = (text or "").split()
            starts = [0, *(s for s in range(4, len(ws), 4) if s + 4 < len(ws))]
            want += [sorted(ws[s : s + 8]) for s in starts]
            owner += [k] * len(starts)
        assert [sorted(g) for g in got] == want and found.of_text.tolist() == owner


def test_evidence_at_any_place(spark):
    """A cue of two words is found as often wherever it stands."""
    rnd = random.Random(5)
    rows, place = [], {}
    for k in range(1500):
        ws = [f"word{rnd.randrange(400)}" for _ in range(rnd.choice([20, 60]))]
        if k % 3 == 0:
            at = rnd.randrange(len(ws) - 1)
            ws[at : at + 2] = ["velvet", "hammer"]
            place[k] = at % 8 == 7
        elif k % 3 == 1:
            ws[rnd.randrange(len(ws))] = rnd.choice(["velvet", "hammer"])
        rows.append((k, " ".join(ws), int(k % 3 == 0)))
    model = fitted(spark, [r for r in rows if r[0] < 900])
    fresh = [r for r in rows if r[0] >= 900 and r[2]]
    found = toxicity.scores([r[1] for r in fresh], model) >= 0.5
    across = np.array([place[r[0]] for r in fresh])
    assert abs(found[across].mean() - found[~across].mean()) <= 0.2
    assert found.mean() >= 0.5


def test_sample_is_bounded_and_takes_one_text_an_id(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: taken.append((texts, labels)))
    rows = [(k, f"text of {k} " * 10) for k in range(30)]
    rows += [(1, f"another text {j}") for j in range(50)] + [(2, None)] * 20
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    toxicity.fit(documents(spark, rows), labels)
    assert len(taken[0][0]) == 30
    toxicity.fit(documents(spark, rows), labels, fit_bytes=1000)
    assert 5 <= len(taken[1][0]) < 30 and sum(map(len, taken[1][0])) <= 1000
    toxicity.fit(documents(spark, rows[::-1]), labels, fit_bytes=1000)
    assert taken[2] == taken[1]
