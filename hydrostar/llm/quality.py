"""Operator 9, quality rules: base measures and a learned decision list.

Everything is DataFrame functions.  A decision list is an ordered list of
conjunctions of thresholds; the first that holds rejects the text, and a text
that none holds for is kept.  Sequential covering learns it from counts: each
growth step is one GROUP BY over the labelled rows that the rule still
covers, giving for every measure a histogram of good and bad rows; the best
threshold by information gain is added.  A grown rule is pruned on rows that
did not grow it, and rows that an accepted rule covers leave the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrostar.llm.common import fold, stored

WINDOW = 8
BROADCAST_ROWS = 200_000
# The base rule's limits.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
_SPACE = r"[\x20\x09-\x0D]+"

MEASURES = (
    "n_words",
    "chars_per_word",
    "symbols_per_word",
    "upper_share",
    "marks_per_word",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "words_per_line",
)


@dataclass(frozen=True)
class Condition:
    """``measure <= limit`` or, with ``above``, ``measure > limit``."""

    measure: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = F.col(self.measure)
        return (value > self.limit) if self.above else (value <= self.limit)


Rule = tuple[Condition, ...]


def _length(col: Column) -> Column:
    return F.length(col).cast("long")


def base_measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the contract's counts of every whole text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = df.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.array_remove(F.split(text, _SPACE, -1), "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # Hashes of the 8-word windows; two hashes from one text meet by chance
    # once in 10^11 texts of 20,000 words.  Windows are zipped from shifted
    # copies: a lambda that looked back into ``words`` could make the optimizer
    # split the text again for every window.
    n = F.size("words") - (WINDOW - 1)
    shifted = [F.slice("words", F.lit(k + 1), F.greatest(n, F.lit(0))) for k in range(WINDOW)]
    names = [f"w{k}" for k in range(WINDOW)]
    zipped = F.arrays_zip(*[x.alias(k) for x, k in zip(shifted, names)])
    cut = cut.select(
        "*", F.transform(zipped, lambda z: F.xxhash64(*[z[k] for k in names])).alias("windows")
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    cut = cut.select("*", F.when(repeated, pairs).alias("pairs"))
    cut = cut.select("*", F.when(F.col("pairs").isNotNull(), _repeated_starts("pairs")).alias("starts"))
    return cut.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        _length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", "")))
        .cast("long")
        .alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered("starts"), F.lit(0)).cast("long").alias("n_repeat_words"),
        _length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        _length(F.regexp_replace("text", r"[^!?]+", "")).alias("n_marks"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _repeated_starts(pairs: str) -> Column:
    """Ascending starts of the windows whose hash occurs twice or more, from
    sorted (hash, start) pairs: each stands zipped beside its neighbours."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    n = F.size(pairs)
    zipped = F.arrays_zip(
        F.col(pairs).alias("x"),
        F.concat(none, F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(0)))).alias("before"),
        F.concat(F.slice(pairs, F.lit(2), F.greatest(n, F.lit(0))), none).alias("after"),
    )
    twice = F.filter(
        zipped,
        lambda z: F.coalesce(z["x"]["h"] == z["before"]["h"], F.lit(False))
        | F.coalesce(z["x"]["h"] == z["after"]["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(twice, lambda z: z["x"]["i"]))


def _covered(starts: str) -> Column:
    """Words in the union of windows at these ascending starts."""
    end = F.array(F.lit(1 << 30))
    steps = F.zip_with(
        starts,
        F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(0))), end),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def measures(base: DataFrame) -> DataFrame:
    """The rates that rules may test, beside the base counts."""

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).cast("double")

    return base.select(
        "*",
        per("word_chars", "n_words").alias("chars_per_word"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_upper", "word_chars").alias("upper_share"),
        per("n_marks", "n_words").alias("marks_per_word"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_distinct", "n_words").alias("distinct_share"),
        per("n_words", "n_lines").alias("words_per_line"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, fit_rows: int, id_col: str, text_col: str
) -> DataFrame:
    """Measures of at most ``fit_rows`` labelled texts that pass the base rule
    (chosen by a hash of the id), with bad (1: label 0) and grow."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(fit_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = chosen.select(F.col("label_id").alias("id"))
    if fit_rows <= BROADCAST_ROWS:
        # At most fit_rows ids: the texts need not be shuffled to find them.
        ids = F.broadcast(ids)
    texts = texts.join(ids, "id", "left_semi")
    # Stored before the filter: pushed below the measures, it would repeat them.
    rows = stored(measures(base_measures(texts, "id", "text")), "measures").where(~base_failed())
    rows = rows.join(chosen, rows["id"] == chosen["label_id"])
    return rows.select(
        *[F.col(m).cast("double").alias(m) for m in MEASURES],
        (F.col("label") == 0).cast("int").alias("bad"),
        (fold(F.col("id"), 5) < 3).alias("grow"),
    )


def _holds(rule: Rule) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.column()
    return found


def _histograms(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, list[int]]]:
    """measure -> bin -> [good, bad]; one GROUP BY, at most one row per
    measure, bin and label."""
    bins = [
        F.struct(
            F.lit(m).alias("measure"),
            sum(((F.col(m) > c).cast("int") for c in cuts[m]), F.lit(0)).alias("bin"),
        )
        for m in cuts
    ]
    counted = (
        rows.select("bad", F.explode(F.array(*bins)).alias("x"))
        .groupBy("x.measure", "x.bin", "bad")
        .agg(F.count("*").alias("n"))
    )
    found: dict[str, dict[int, list[int]]] = {m: {} for m in cuts}
    for r in counted.collect():
        found[r["measure"]].setdefault(r["bin"], [0, 0])[r["bad"]] += r["n"]
    return found


def _best(hist: dict[str, dict[int, list[int]]], cuts: dict[str, list[float]]):
    """The condition with the largest information gain, and the good rows it
    leaves.  Of thresholds with equal gain in a row the middle is taken, as
    far from the good rows as from the bad ones."""
    top, found, left = 0.0, None, 0
    for m, bins in hist.items():
        good, bad = (sum(b[k] for b in bins.values()) for k in (0, 1))
        if not bad:
            continue
        start = log2(bad / (bad + good))
        low = [0, 0]
        for k, cut in enumerate(cuts[m]):
            low = [low[i] + bins.get(k, [0, 0])[i] for i in (0, 1)]
            for above in (False, True):
                g, b = (good - low[0], bad - low[1]) if above else low
                gain = b * (log2(b / (b + g)) - start) if b else 0.0
                if gain > top + 1e-9:
                    top, found, left = gain, (m, above, cut, cut), g
                elif found and found[:2] == (m, above) and abs(gain - top) <= 1e-9:
                    found = (m, above, found[2], cut)
    if found is None:
        return None, 0
    m, above, lo, hi = found
    return Condition(m, above, (lo + hi) / 2), left


def learn(
    rows: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_bad: int = 5,
) -> list[Rule]:
    """Sequential covering over a table from ``labelled``.

    A rule is kept if, on the rows that did not grow it, at least ``min_bad``
    bad rows and at most ``1 - min_precision`` good ones match.  Without bad
    rows the list is empty.
    """
    shares = [0.005, 0.01, 0.02, 0.05] + [k / 10 for k in range(1, 10)] + [0.95, 0.98, 0.99, 0.995]
    points = F.array(*[F.lit(s) for s in shares])
    both = rows.groupBy("bad").agg(*[F.percentile(m, points).alias(m) for m in MEASURES]).collect()
    cuts = {m: sorted({c for r in both for c in r[m]}) for m in MEASURES}
    rules: list[Rule] = []
    if not both:
        return rules
    left = rows
    while len(rules) < max_rules:
        rule: Rule = ()
        good = 1
        while len(rule) < max_conditions and good:
            hist = _histograms(left.where(F.col("grow") & _holds(rule)), cuts)
            condition, good = _best(hist, cuts)
            if condition is None:
                break
            rule = (*rule, condition)
        if not rule:
            break
        counts = left.where(~F.col("grow")).agg(
            *[
                F.sum(F.when(_holds(rule[:n]) & (F.col("bad") == b), 1).otherwise(0)).alias(f"c{n}_{b}")
                for n in range(1, len(rule) + 1)
                for b in (0, 1)
            ]
        ).first()
        worth = {
            n: ((counts[f"c{n}_1"] or 0), (counts[f"c{n}_0"] or 0)) for n in range(1, len(rule) + 1)
        }
        value = {n: (b - g) / (b + g) if b + g else -1.0 for n, (b, g) in worth.items()}
        n = max(value, key=lambda k: (value[k], -k))
        bad, good = worth[n]
        if bad < min_bad or bad < min_precision * (bad + good):
            break
        rules.append(rule[:n])
        left = left.where(~_holds(rule[:n]))
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """True to keep: the list as one ordered CASE expression."""
    found = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        found = found.when(_holds(rule), F.lit(False))
    return found.otherwise(F.lit(True))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    fit_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base counts, base_failed and kept of every row.

    Null and empty texts have no words and fail the base rule.  Repeated rows
    and null ids are judged like any other; labels that are null, or without
    a document, are not learnt from; of several labels of one id the smallest
    counts.  Without usable labels only the base rule rejects.  Store the
    result before filtering on it: Spark would push the filter below the
    measures and compute them twice.
    """
    rules = learn(stored(labelled(docs, labels, label, fit_rows, id_col, text_col), "labelled"))
    rows = measures(base_measures(docs, id_col, text_col))
    failed = base_failed()
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"),
    )
