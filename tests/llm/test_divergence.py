"""Source divergence audit against brute force over all terms and sources."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from hydrostar.llm import divergence
from tests.llm import frames

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows: list[tuple], minimum: int = 3, top: int = 200) -> set[tuple]:
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(divergence.TERM_PATTERN, lower(text or ""))
        groups[lang].add(source)
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= minimum)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c: Counter, total: int) -> dict:
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        def of(c: Counter) -> dict:
            return share(c, sum(c[t] for t in kept))

        p, q = {s: of(counts[lang, s]) for s in sources}, of(whole)
        for s in sources:
            pairs = [
                (o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept))
                for o in sources
                if o != s
            ]
            terms = [
                (t, (p[s][t] - q[t]) ** 2 // q[t])
                for t in kept
                if counts[lang, s][t] and p[s][t] > q[t]
            ]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(found[:limit], 1)}
    return out


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr(
        "*", *[f"CAST(NULL AS STRING) AS `{c}`" for c in ("term", "n", "counts", "x", "y", "w", "value")]
    )
    got = frames.tuples(divergence.audit(docs, **how).select(*COLUMNS))
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, *how.values())


def some_rows(seed: int, n: int, words: list[str]) -> list[tuple]:
    rnd = random.Random(seed)
    return [
        (
            k,
            rnd.choice(" -\n1") .join(rnd.choice(words) for _ in range(rnd.randrange(40))),
            rnd.choice(["en", "de", None, ""]),
            rnd.choice(["a", "b", "Ü", "c", None]),
        )
        for k in range(n)
    ]


def test_equals_brute_force(spark):
    words = [f"W{a}x{b}" for a in "abcdefgh" for b in "éÄ漢 \U0001f600z"]
    check(spark, some_rows(1, 160, words))


def test_ties_are_cut_at_the_rank_limit(spark):
    words = [a + b + c for a in "abcdefgh" for b in "abcdef" for c in "xyzé￮\U00010000"]
    rows = some_rows(2, 200, words)
    check(spark, rows, min_documents=3, top_terms=7)
    check(spark, rows, min_documents=1, top_terms=200)


def test_awkward_rows(spark):
    rows = [
        (i, t, ("en", None, "")[k % 3], ("s", None)[k % 2])
        for k, (i, t) in enumerate(frames.awkward_rows())
    ]
    rows += [(1, "lonely words only", "xx", "s"), (2, None, "xx", "t"), (3, "12 34", "yy", "s")]
    check(spark, rows)
    check(spark, rows + rows + rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(docs).collect() == []


def test_long_texts_and_full_tables_are_counted_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 50)
    monkeypatch.setattr(divergence, "MAX_ENTRIES", 20)
    text = "Aé b1c-dd " * 40
    rows = list(divergence._stretches(text.encode().translate(divergence._TERM_TABLE)))
    assert len(rows) > 3 and all(not r[:-1] or r.split() for r in rows)
    again = b"".join(rows)
    assert again.split() == text.encode().translate(divergence._TERM_TABLE).split()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"l": ["en"] * 3, "s": ["a", "b", "a"], "t": [text] * 3})
    out = list(divergence._count(iter([batch, batch])))
    total = Counter()
    for b in out:
        for r in b.to_pylist():
            total[r["term"]] += r["n"]
    assert total == Counter({"aé": 240, "b": 240, "c": 240, "dd": 240})
    assert sum(d for b in out for d, t in zip(b["docs"].to_pylist(), b["term"].to_pylist()) if t == "dd") == 6
