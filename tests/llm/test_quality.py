from __future__ import annotations

import random
import re
from collections import Counter

from hydrostar.llm import quality
from tests.llm.frames import awkward_rows, documents, prose


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
    covered = set()
    for k in range(len(ws) - 7):
        if windows[tuple(ws[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    n, m = len(ws), len(covered)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, m, n < 20 or 100 * m > 30 * n


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts(spark):
    rnd = random.Random(4)
    rows = awkward_rows()
    for k in range(60):
        lines = [prose(rnd.randrange(8), rnd.randrange(14), 9) + rnd.choice(["", " ", "\r", " #|<", "!\n\n"]) for _ in range(rnd.randrange(9))]
        rows.append((100 + k, "\n".join(lines)))
    out = quality.judge(documents(spark, rows), labels(spark, []))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = sorted(((i, *brute(t), not brute(t)[5]) for i, t in rows), key=str)
    assert got == want


def planted(n):
    """Bad texts shout or are full of symbols; some labels are missing."""
    rnd = random.Random(6)
    rows, marks = [], []
    for k in range(n):
        ws = prose(k, 60, 3000).split()
        bad = k % 4 == 0
        if bad and k % 8 == 0:
            ws = [w.upper() + "!" for w in ws]
        elif bad:
            ws = [w + rnd.choice(["$$", "%%"]) for w in ws]
        rows.append((k, " ".join(ws)))
        if k % 3:
            marks.append((k, 0 if bad else 1, 0))
    return rows, marks


def test_learns_planted_rules_and_keeps_the_clean(spark):
    rows, marks = planted(400)
    marks += [(None, 0, 0), (5, None, 0), (10_000, 0, 0)]
    out = quality.judge(documents(spark, rows), labels(spark, marks)).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[k] == bool(k % 4) for k in kept)


def test_rules_are_ordered_threshold_conjunctions(spark):
    rows, marks = planted(400)
    sample = quality.labelled(documents(spark, rows), labels(spark, marks), "quality", 200, "doc_id", "text")
    assert sample.count() <= 200
    rules = quality.learn(quality.stored(sample, "test"))
    assert 1 <= len(rules) <= 8 and all(1 <= len(r) <= 4 for r in rules)
    assert {c.measure for r in rules for c in r} <= set(quality.MEASURES)


def test_no_bad_labels_or_no_rows(spark):
    rows, _ = planted(60)
    out = quality.judge(documents(spark, rows), labels(spark, [(k, 1, 0) for k in range(60)]))
    assert all(r["kept"] for r in out.collect())
    assert quality.judge(documents(spark, []), labels(spark, [(1, 0, 0)])).count() == 0


def test_no_python_in_the_plan(spark):
    rows, marks = planted(60)
    df = quality.judge(documents(spark, rows), labels(spark, marks))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
