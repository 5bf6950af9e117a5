"""Operator 4, toxicity: subword bags, mean embeddings, a linear softmax.

A word's bag holds the hashes of its 3- to 5-byte n-grams with word borders,
so a misspelt word shares most vectors with the word it stands for.  A text is
read in windows of ``WINDOW`` words, one from every ``STRIDE``-th word on, so
that evidence never falls apart at a border; a window's embedding is the mean over
the bags of its different words (with ``PRIOR`` zero vectors, so that a few
unusual words in a short text do not weigh like a whole window), a linear
softmax on it gives the window's score, and a text scores as its highest
window: one insult in 20,000 words counts as much as in ten.

Embeddings and softmax are trained jointly in numpy (Adam) on a bounded,
hash-chosen sample of labelled rows (``fit_rows`` toxic, twice as many
others, one text an id, ``fit_bytes`` in all): first on whole texts, then on the highest window of each text and a
random one of each clean text, chosen anew every epoch.  The model goes back
to the tasks as one weight for each of the ``BUCKETS`` buckets (a fixed
256 KB), because mean and difference of classes are both linear.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hydrostar.llm.common import LOWER_TABLE, arrow_pass, fold, stored, utf8

BUCKETS = 1 << 16
WORD_BLOCK = 1 << 15
NGRAMS = (3, 4, 5)
DIM = 8
WINDOW = 8
STRIDE = 4
WORDS_AT_ONCE = 1 << 18
PRIOR = 150
DECAY = 0.1
BATCH = 128
TOXIC_WEIGHT = 4.0
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word's n-grams, word after word, and the word each
    belongs to.  Words go through in blocks, so working memory is bounded."""
    parts = [_subwords(words[at : at + WORD_BLOCK], at) for at in range(0, len(words), WORD_BLOCK)]
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _subwords(words: list[bytes], start: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int32, len(words)) + 2
    owner = np.repeat(np.arange(start, start + len(words), dtype=np.int32), sizes)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        h = raw + np.uint64(1)
        for n in range(2, max(NGRAMS) + 1):
            if len(raw) < n:
                break
            h = h[:-1] * _PRIME ^ (raw[n - 1 :] + np.uint64(1))
            if n in NGRAMS:
                inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
                mixed = h[inside] * _MIX
                buckets.append((mixed >> np.uint64(64 - 16)).astype(np.int32))
                owners.append(owner[n - 1 :][inside])
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


@dataclass
class Words:
    """The words of several texts, numbered; ``unique`` by number."""

    ids: np.ndarray
    counts: np.ndarray
    unique: list[bytes]

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        number: dict[bytes, int] = {}
        ids: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = utf8(text).translate(LOWER_TABLE).split()
            counts[k] = len(words)
            ids += [number.setdefault(w, len(number)) for w in words]
        return cls(np.array(ids, np.int64), counts, list(number))


def sample(labels: DataFrame, label: str, fit_rows: int, id_col: str) -> DataFrame:
    """id and label of at most ``fit_rows`` rows of class 1 and twice as many
    of class 0, by id hash.

    Of several labels of one id the largest counts; null ids and labels are
    left out.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    order = [F.xxhash64("label_id"), "label_id"]
    classes = [
        known.where(F.col("label") == k).orderBy(*order).limit((2 - k) * fit_rows) for k in (0, 1)
    ]
    return classes[0].unionByName(classes[1])


@dataclass
class Model:
    """Score weight of every bucket, and the bias."""

    weights: np.ndarray
    bias: float


@dataclass
class Windows:
    """The windows of several texts: each window's different words."""

    of_text: np.ndarray  # the text of each window; every text has one at least
    window: np.ndarray  # for each (window, word) pair, its window
    word: np.ndarray  # and its word's number

    @classmethod
    def of(cls, words: Words, size: int, stride: int) -> Windows:
        """Windows of ``size`` words from every ``stride``-th word on, to the
        one that reaches the text's end."""
        n = np.maximum(-(-(words.counts - size) // stride), 0) + 1
        first = np.cumsum(n) - n
        ends = np.cumsum(words.counts)
        span = max(len(words.unique), 1)
        pairs = []
        # Texts go through in blocks, so working memory is bounded.
        at = 0
        while at < len(n):
            stop = int(np.searchsorted(ends, ends[at] + WORDS_AT_ONCE, side="right"))
            counts = words.counts[at:stop]
            text = np.repeat(np.arange(at, stop), counts)
            head = int(ends[at] - words.counts[at])
            nearest = (np.arange(head, int(ends[stop - 1])) - (ends - words.counts)[text]) // stride
            ids = words.ids[head : int(ends[stop - 1])]
            keys = []
            for back in range(-(-size // stride)):
                inside = (nearest >= back) & (nearest - back < n[text])
                keys.append((first[text] + nearest - back)[inside] * span + ids[inside])
            found = np.unique(np.concatenate(keys))
            pairs.append(((found // span).astype(np.int32), (found % span).astype(np.int32)))
            at = stop
        window, word = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.empty(0, np.int32),) * 2
        return cls(np.repeat(np.arange(len(n)), n), window, word)

    def logits(self, weight: np.ndarray, size: np.ndarray, bias: float) -> np.ndarray:
        """Score of each window from its words' weights and bag sizes."""
        n = len(self.of_text)
        total = np.bincount(self.window, weight[self.word], minlength=n)
        count = np.bincount(self.window, size[self.word], minlength=n)
        return total / (count + PRIOR) + bias


class Trainer:
    """Joint training of bucket vectors and softmax on windows of a sample."""

    def __init__(self, texts: list[str | None], labels: list[int], seed: int):
        self.y = np.array(labels, np.int64)
        self.words = Words.of(texts)
        self.bucket, owner = subwords(self.words.unique)
        self.size = np.bincount(owner, minlength=len(self.words.unique))
        self.first = np.cumsum(self.size) - self.size
        self.rng = np.random.default_rng(seed)
        self.params = [
            self.rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32),
            self.rng.normal(0, 0.5, (DIM, 2)).astype(np.float32),
            np.zeros(2, np.float32),
        ]
        self.first_moment = [np.zeros_like(p) for p in self.params]
        self.second_moment = [np.zeros_like(p) for p in self.params]
        self.steps = 0

    def model(self) -> Model:
        e, w, b = self.params
        return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]))

    def word_weights(self, model: Model) -> np.ndarray:
        # Every word has a bag: its borders and one byte make an n-gram.
        if not len(self.size):
            return np.empty(0)
        return np.add.reduceat(model.weights[self.bucket], self.first, dtype=np.float64)

    def epoch(self, windows: Windows, chosen: np.ndarray, rate: float) -> None:
        """One pass over the chosen windows in random order."""
        ends = np.searchsorted(windows.window, np.arange(len(windows.of_text) + 1))
        order = self.rng.permutation(chosen)
        for at in range(0, len(order), BATCH):
            mine = order[at : at + BATCH]
            words = [windows.word[ends[k] : ends[k + 1]] for k in mine]
            rows = np.repeat(np.arange(len(mine)), [int(self.size[w].sum()) for w in words])
            flat = np.concatenate(words)
            sizes = self.size[flat]
            ahead = np.cumsum(sizes) - sizes
            buckets = self.bucket[np.arange(len(rows)) + np.repeat(self.first[flat] - ahead, sizes)]
            # Only the buckets that the minibatch uses take part.
            used, where = np.unique(buckets, return_inverse=True)
            x = np.bincount(rows * len(used) + where, minlength=len(mine) * len(used))
            x = x.reshape(len(mine), len(used)).astype(np.float32)
            x /= x.sum(axis=1, keepdims=True) + PRIOR
            self._step(x, used, self.y[windows.of_text[mine]], rate)

    def _step(self, x: np.ndarray, used: np.ndarray, y: np.ndarray, rate: float) -> None:
        e, w, b = self.params
        h = x @ e[used]
        z = h @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = z / z.sum(axis=1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        # A text's highest window is one among many clean ones.
        g *= np.where(y == 1, TOXIC_WEIGHT, 1.0).astype(np.float32)[:, None] / np.float32(len(y))
        grads = [x.T @ (g @ w.T), h.T @ g, g.sum(axis=0)]
        self.steps += 1
        fix1, fix2 = 1 - 0.9**self.steps, 1 - 0.99**self.steps
        for k, (p, grad) in enumerate(zip(self.params, grads)):
            at = used if k == 0 else slice(None)
            m = self.first_moment[k][at] * 0.9 + 0.1 * grad
            v = self.second_moment[k][at] * 0.99 + 0.01 * grad * grad
            self.first_moment[k][at], self.second_moment[k][at] = m, v
            # Decay draws vectors that the labels do not need back to zero.
            decay = DECAY * p[at] if k == 0 else 0
            p[at] -= rate * ((m / fix1) / (np.sqrt(v / fix2) + 1e-9) + decay)


def _highest(windows: Windows, logits: np.ndarray, texts: int) -> np.ndarray:
    """The highest window of each text."""
    order = np.lexsort((logits, windows.of_text))
    last = np.searchsorted(windows.of_text[order], np.arange(texts), side="right") - 1
    return order[last]


def train(
    texts: list[str | None],
    labels: list[int],
    warm: int = 1,
    epochs: int = 10,
    min_steps: int = 500,
    seed: int = 7,
) -> Model:
    """Rows must come in a fixed order; small samples get more epochs, so that
    training takes ``min_steps`` minibatches at least.  With one class only, every text gets
    that class; without rows, every score is one half."""
    if not labels or min(labels) == max(labels):
        bias = 0.0 if not labels else (4.0 if labels[0] else -4.0)
        return Model(np.zeros(BUCKETS, np.float32), bias)
    t = Trainer(texts, labels, seed)
    longest = max(int(t.words.counts.max()), 1)
    whole = Windows.of(t.words, longest, longest)
    for k in range(max(warm, -(-min_steps // 8 // -(-len(texts) // BATCH)))):
        t.epoch(whole, np.arange(len(texts)), 0.05)
    windows = Windows.of(t.words, WINDOW, STRIDE)
    clean = np.flatnonzero(t.y[windows.of_text] == 0)
    epochs = max(epochs, -(-min_steps // -(-(len(texts) + int((t.y == 0).sum())) // BATCH)))
    for k in range(epochs):
        model = t.model()
        top = _highest(windows, windows.logits(t.word_weights(model), t.size, model.bias), len(texts))
        some = t.rng.choice(clean, int((t.y == 0).sum()))
        t.epoch(windows, np.concatenate([top, some]), 0.05 * (1 - 0.9 * k / epochs))
    return t.model()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    fit_rows: int = 2_000,
    fit_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Train on whole texts of the sample: ``3 * fit_rows`` at most, of
    ``fit_bytes`` in UTF-8 together.

    Of several rows of a chosen id the text with the smallest hash counts
    (null texts are empty).  A text that would take the sample over
    ``fit_bytes``, in the order of the ids' hashes, is left out.
    """
    chosen = sample(labels, label, fit_rows, id_col)
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = (
        texts.join(chosen, texts["id"] == chosen["label_id"])
        .groupBy("id", "label")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
        .select("id", "label", F.col("least.text").alias("text"))
    )
    rows = stored(rows, "toxicity-sample")
    sizes = rows.select(F.xxhash64("id"), "id", F.octet_length("text")).collect()
    kept, total = [], 0
    for _, i, size in sorted(map(tuple, sizes)):
        if total + size <= fit_bytes:
            kept.append(i)
            total += size
    if len(kept) < len(sizes):
        rows = rows.where(F.col("id").isin(kept))
    found = sorted(map(tuple, rows.collect()))
    return train([r[2] for r in found], [r[1] for r in found])


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    """Probability of class 1 of each whole text: that of its highest window.
    A text without words has the probability that the bias alone gives."""
    if not texts:
        return np.empty(0)
    words = Words.of(texts)
    bucket, owner = subwords(words.unique)
    weight = np.bincount(owner, model.weights[bucket], minlength=len(words.unique))
    size = np.bincount(owner, minlength=len(words.unique))
    windows = Windows.of(words, WINDOW, STRIDE)
    logits = windows.logits(weight, size, model.bias)
    starts = np.searchsorted(windows.of_text, np.arange(len(texts)))
    top = np.maximum.reduceat(logits, starts)
    return 1 / (1 + np.exp(-np.clip(top, -50, 50)))


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """source (the whole row) and toxicity of every row; one pass, no shuffle.

    Null texts count as empty; repeated rows, null ids and any other column
    go through unchanged in ``source``.
    """
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("source"))
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.struct_field(batch.column(0), at).to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores(texts, shared.value), pa.float64())],
            names=["source", "toxicity"],
        )

    schema = StructType([*source.schema.fields, StructField("toxicity", DoubleType())])
    return arrow_pass(source, rows, schema, slice_bytes=2 << 20)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return fold(F.col(id_col), folds) == 0
