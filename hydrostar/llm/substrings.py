"""Operator 6, substring dedup by De Bruijn compaction.

The graph's edges are k-mers of words (half a window and one more), sampled
so that every window holds one: the smallest hash among the k-mers of each
window, and the first and last k-mer of a document.  A join gives each k-mer
that occurs in several documents its source coordinate, the place in the
smallest document (its id, row and position).  Walking a document, consecutive
k-mers whose source coordinates advance in step within one row form a nonbranching path: the smallest document
walks the same edges.  Since neighbouring samples overlap or touch, such a
path is word for word a span of that document, and compacts to one row.

Windows that lie in no path but hold a k-mer of a smaller document (at the
ends of repeated spans, and where the smallest document branches off) are
verified exactly, by 128-bit hashes of their whole word sequence, against all
windows of all documents that share their k-mer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydrostar.llm.common import SPACES, arrow_pass, stored, utf8, with_field

SLICE_BYTES = 4 << 20
# Odd multipliers of two rolling hashes, and of their mixing.
_ROLL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def kmer_words(window: int) -> int:
    """Words of a k-mer: neighbouring samples are then k - 1 apart at most."""
    return window // 2 + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _MIX
        return h ^ (h >> np.uint64(29))


def rolling(words: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes, from prefix sums."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.full(len(words), multiplier, np.uint64)
        down = np.full(n, pow(multiplier, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * np.multiply.accumulate(up), out=total[1:])
        return _mixed((total[size:] - total[:-size]) * np.multiply.accumulate(down))


class Slice:
    """The words of several texts as hashes, and the k-mer that each window
    is filed under."""

    def __init__(self, texts: list[str | None], window: int):
        digest = xxhash.xxh3_64_intdigest
        split = [utf8(t).split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.cumsum(self.counts) - self.counts
        self.words = np.fromiter(
            (digest(w) for ws in split for w in ws), np.uint64, int(self.counts.sum())
        )
        k = kmer_words(window)
        self.kmers = rolling(self.words, k, _ROLL[0])
        per = window - k + 1
        starts = np.arange(max(len(self.words) - window + 1, 0))
        doc = np.repeat(np.arange(len(split)), self.counts)
        self.doc = doc
        starts = starts[doc[starts] == doc[starts + window - 1]] if len(starts) else starts
        self.starts = starts
        if len(starts):
            view = np.lib.stride_tricks.sliding_window_view(self.kmers, per)
            # In pieces: picking rows of the view copies them.
            pieces = np.split(starts, range(1 << 15, len(starts), 1 << 15))
            self.sample = starts + np.concatenate([view[p].argmin(axis=1) for p in pieces])
        else:
            self.sample = starts


def samples(docs: DataFrame, window: int) -> DataFrame:
    """(id, row, n, pos, node): the sampled k-mers of every text that has a
    whole window; n is the text's number of words."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Slice(batch.column(2).to_pylist(), window)
        long = np.flatnonzero(s.counts >= window)
        ends = [s.first[long], s.first[long] + s.counts[long] - kmer_words(window)]
        at = np.unique(np.concatenate([s.sample, *ends]))
        doc = s.doc[at]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(doc)),
                batch.column(1).take(pa.array(doc)),
                pa.array(s.counts[doc].astype(np.int32)),
                pa.array((at - s.first[doc]).astype(np.int32)),
                pa.array(s.kmers[at].view(np.int64)),
            ],
            names=["id", "row", "n", "pos", "node"],
        )

    kind = docs.schema["id"].dataType.simpleString()
    return arrow_pass(
        docs, rows, f"id {kind}, row long, n int, pos int, node long", slice_bytes=SLICE_BYTES
    )


def walked(found: DataFrame, window: int) -> DataFrame:
    """Every occurrence of a k-mer of several documents, with the path it is
    on (path_start, path_end in words of its text).

    ``open`` marks occurrences in a later document whose windows may reach
    beyond their path.
    """
    k = kmer_words(window)
    source = (
        found.groupBy("node")
        .agg(F.min(F.struct("id", "row", "pos")).alias("source"), F.max("id").alias("last"))
        .where(F.col("source.id") < F.col("last"))
        .select("node", *[F.col(f"source.{c}").alias(f"source_{c}") for c in ("id", "row", "pos")])
    )
    # Stored, so that both sides of the join are plain shuffles and AQE can
    # split a k-mer that very many texts share.
    joined = found.join(stored(source, "sources"), "node")
    joined = joined.withColumn("later", F.col("source_id") < F.col("id"))
    along = Window.partitionBy("id", "row").orderBy("pos")
    offset = F.col("source_pos") - F.col("pos")
    follows = (
        F.col("later")
        & (F.lag("source_id").over(along) == F.col("source_id"))
        & (F.lag("source_row").over(along) == F.col("source_row"))
        & (F.lag(offset).over(along) == offset)
        & (F.col("pos") - F.lag("pos").over(along) <= k)
    )
    numbered = joined.withColumn("head", (~F.coalesce(follows, F.lit(False))).cast("int"))
    numbered = numbered.withColumn("path", F.sum("head").over(along))
    path = Window.partitionBy("id", "row", "path")
    numbered = numbered.withColumn("path_start", F.min("pos").over(path)).withColumn(
        "path_end", F.max("pos").over(path) + k
    )
    reach_start = F.greatest(F.col("pos") - (window - k), F.lit(0))
    reach_end = F.least(F.col("pos") + window, F.col("n"))
    inside = (F.col("path_start") <= reach_start) & (F.col("path_end") >= reach_end)
    return numbered.select(
        "id", "row", "node", "pos", "path_start", "path_end", "later",
        (F.col("later") & ~inside).alias("open"),
    )


_SPANS = "array<struct<start:int,end:int>>"


def paths(nodes: DataFrame, window: int) -> DataFrame:
    """(id, row, start, end) of the compacted paths of a window or more."""
    whole = F.col("later") & (F.col("path_end") - F.col("path_start") >= window)
    return nodes.where(whole).select(
        "id", "row", F.col("path_start").alias("start"), F.col("path_end").alias("end")
    ).distinct()


def _spans(rows: DataFrame, name: str) -> DataFrame:
    """One row per text: its spans, equal ones once."""
    return rows.groupBy("id", "row").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias(name)
    )


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _marks(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place, in how many of the ranges it is."""
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(steps)[:size]


def window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """(id, row, start, a, b): 128-bit hashes of the windows filed under the
    k-mers ``asked`` (their positions) that lie in none of ``spans``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        s = Slice(batch.column(2).to_pylist(), window)
        if not len(s.starts):
            return None
        doc, asked = _flat(batch.column(3))
        wanted = np.zeros(len(s.words), bool)
        wanted[s.first[doc] + asked.to_numpy()] = True
        keep = wanted[s.sample]
        doc, spans = _flat(batch.column(4))
        if len(doc):
            lo = s.first[doc] + spans.field("start").to_numpy()
            hi = s.first[doc] + spans.field("end").to_numpy() - window + 1
            keep &= _marks(len(s.words), lo, hi)[s.starts] == 0
        at = s.starts[keep]
        second = _mixed(s.words ^ np.uint64(_ROLL[1]))
        a, b = rolling(s.words, window, _ROLL[0])[at], rolling(second, window, _ROLL[1])[at]
        doc = s.doc[at]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(doc)),
                batch.column(1).take(pa.array(doc)),
                pa.array((at - s.first[doc]).astype(np.int32)),
                pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)),
            ],
            names=["id", "row", "start", "a", "b"],
        )

    kind = texts.schema["id"].dataType.simpleString()
    return arrow_pass(
        texts, rows, f"id {kind}, row long, start int, a long, b long", slice_bytes=SLICE_BYTES
    )


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(id, row, spans): word ranges that some window of a smaller document
    covers.  ``docs`` has id, row and text; null ids take no part."""
    docs = docs.where(F.col("id").isNotNull())
    nodes = stored(walked(stored(samples(docs, window), "samples"), window), "nodes")
    compact = paths(nodes, window)
    # All occurrences of the k-mers that some later document leaves open.
    asked = stored(nodes.where("open").select("node").distinct(), "asked")
    asked = (
        nodes.join(asked, "node", "left_semi")
        .groupBy("id", "row")
        .agg(F.sort_array(F.collect_set("pos")).alias("asked"))
    )
    spans = _spans(compact, "spans")
    asked = asked.join(spans, ["id", "row"], "left").select(
        "id", "row", "asked", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")
    )
    texts = docs.join(asked, ["id", "row"]).select("id", "row", "text", "asked", "spans")
    hashes = stored(window_hashes(texts, window), "windows")
    first = (
        hashes.groupBy("a", "b")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last")
        .select("a", "b", "first")
    )
    exact = hashes.join(stored(first, "firsts"), ["a", "b"]).where(F.col("id") > F.col("first"))
    exact = exact.select("id", "row", "start", (F.col("start") + window).alias("end"))
    return _spans(compact.unionByName(exact), "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Union of sorted spans."""
    out: list[tuple[int, int]] = []
    for x in spans or ():
        s, e = x["start"], x["end"]
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def kept_words(text: str | None, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """Kept words joined by a space, number of words, number removed."""
    words = utf8(text).split()
    out, at = [], 0
    for s, e in spans:
        out += words[at:s]
        at = e
    out += words[at:]
    return b" ".join(out).decode("utf-8"), len(words), len(words) - len(out)


def cut_text(text: str | None, spans: list[tuple[int, int]]) -> tuple[str | None, int, int]:
    """The text as it was, without the characters from each span's first word
    up to the next kept word, and the same two counts."""
    if not spans:
        return text, len(utf8(text).split()), 0
    raw = utf8(text)
    starts = list(_word_starts(raw))
    ends = [*starts, len(raw)]
    out, at, gone = bytearray(), 0, 0
    for s, e in spans:
        out += raw[at : ends[s]]
        at, gone = ends[e], gone + e - s
    out += raw[at:]
    return out.decode("utf-8").rstrip(SPACES) if at == len(raw) else out.decode("utf-8"), len(starts), gone


def _word_starts(raw: bytes) -> Iterator[int]:
    flags = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(SPACES.encode(), np.uint8))
    yield from np.flatnonzero(~flags & np.concatenate([[True], flags[:-1]])).tolist()


def remove_repeats(
    df: DataFrame,
    window: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    join_words: bool = False,
) -> DataFrame:
    """(source, n_words, n_removed): every row, its text freed of words that a
    window of ``window`` words covers whose word sequence also starts in a
    document with a smaller id.

    ``source`` is the row with the new text.  Windows are judged on the input.
    Null texts have no words and stay null (with ``join_words``: empty);
    null ids neither lose words nor make others lose any; rows of one id are
    judged each by its own text, and never against one another; repeated
    rows get equal results.  A text that loses every word becomes empty.
    """
    row = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0).cast("long"))
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("source"),
        F.col(id_col).alias("id"),
        row.alias("row"),
    )
    texts = df.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    spans = repeated_spans(texts, window)
    both = keyed.join(spans, ["id", "row"], "left").select("source", "spans")
    at = df.columns.index(text_col)
    finish = kept_words if join_words else cut_text

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        source = batch.column(0)
        texts = pc.struct_field(source, at)
        pairs = zip(texts.to_pylist(), batch.column(1).to_pylist())
        done = [finish(t, merged(x)) for t, x in pairs]
        text, n, gone = zip(*done)
        return pa.RecordBatch.from_arrays(
            [
                with_field(source, at, pa.array(text, pa.string())),
                pa.array(n, pa.int64()),
                pa.array(gone, pa.int64()),
            ],
            names=["source", "n_words", "n_removed"],
        )

    schema = StructType(
        [both.schema["source"], *StructType.fromDDL("n_words long, n_removed long").fields]
    )
    return arrow_pass(both, rows, schema, slice_bytes=SLICE_BYTES)


def digests(freed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns (of a column ``text`` with ``join_words``)."""
    return freed.select(
        F.col(f"source.{id_col}").alias(id_col),
        "n_words",
        "n_removed",
        F.sha2(F.col("source.text").cast("binary"), 256).alias("kept_sha256"),
    )
