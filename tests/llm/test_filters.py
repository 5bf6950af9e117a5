"""Filter interaction audit against brute force over documents and orders."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import permutations

from hydrostar.llm import filters
from tests.llm import frames


def failed(text: str, copied: bool) -> str:
    words = text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ")
    words = [w for w in words.replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    out = ""
    if len(words) < 100:
        out += "A"
    if 100 * len(set(words)) < 80 * len(words):
        out += "B"
    if 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) > 10 * len(text):
        out += "C"
    if any(c in "#$%&*|" for c in text):
        out += "D"
    return out + ("E" if copied else "")


def brute(rows: list[tuple], labels: list[tuple]) -> set[tuple]:
    ids = defaultdict(list)
    for doc_id, text, _ in rows:
        if doc_id is not None:
            ids[text or ""].append(doc_id)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts = defaultdict(list)
    for doc_id, text, lang in rows:
        copied = doc_id is not None and min(ids[text or ""]) < doc_id
        parts[lang or ""].append((doc_id, failed(text or "", copied)))
    out = set()
    for part, found in parts.items():
        shapley, lines = defaultdict(int), []
        for order in map("".join, permutations("ABCDE")):
            left = found
            for step, x in enumerate(order, 1):
                fails = [(i, f) for i, f in left if x in f]
                n_fail = sum(x in f for _, f in found)
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(fails)
                lines.append(
                    (part, order, step, len(left), len(fails), n_fail - len(fails),
                     sum(f == x for _, f in found), sum(i in good for i, _ in fails),
                     sum(i in toxic for i, _ in fails))
                )
        out |= {(*line, shapley[line[1][line[2] - 1]]) for line in lines}
    return out


COLUMNS = (
    "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley"
).split()


def check(spark, rows, labels, extra=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if extra:
        docs = docs.selectExpr(
            "*", *[f"CAST(NULL AS STRING) AS `{c}`" for c in ("part", "hash", "bits", "n", "total")]
        )
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = known.selectExpr("*", "'x' AS part", "'y' AS lang")
    got = filters.audit(docs, known).select(*COLUMNS)
    assert set(frames.tuples(got)) == brute(rows, labels)


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    texts = [frames.prose(k, n, v) for k, n, v in
             [(1, 99, 5000), (2, 100, 5000), (3, 150, 40), (4, 10, 5000), (5, 300, 90)]]
    texts += [t + " #" for t in texts] + [t.upper() for t in texts] + ["", " \n", "ABC", "É" * 9 + "A"]
    rows = [(rnd.randrange(60), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for k in range(0, 60, 2)]
    check(spark, rows, labels)


def test_awkward_rows_and_repeated_labels(spark):
    rows = [(i, t, "en" if k % 3 else None) for k, (i, t) in enumerate(frames.awkward_rows())]
    labels = [(11, 0, 1), (11, 1, 0), (18, 1, 1), (18, 1, 1), (None, 1, 1), (99, 1, 1)]
    check(spark, rows, labels)


def test_a_text_that_most_rows_share(spark):
    hot = frames.prose(9, 120, 5000)
    rows = [(k, hot if k % 3 else frames.prose(k, 120, 5000), "en") for k in range(400)]
    check(spark, rows, [(k, k % 2, k % 5 == 0 and 1 or 0) for k in range(400)])


def test_clean_and_empty_tables(spark):
    check(spark, [(1, frames.prose(1, 120, 50_000), "en")], [])
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(docs, labels).collect() == []
