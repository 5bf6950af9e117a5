"""Operator 7, benchmark decontamination by an FM-index per training shard.

Benchmark items become phrases: every run of ten words, or the whole item if
it is shorter.  Each shard (a slice of the documents in one task) numbers its
words by the phrases' vocabulary; a word outside of it can be in no phrase and
ends a run, and runs shorter than the shortest phrase are left out.  Over the
remaining runs the shard builds a suffix array, its Burrows-Wheeler text in a
wavelet matrix, and sampled suffix positions.  All phrases are searched
backward at once through wavelet ranks, occurrences are located by walking to
the next sampled suffix, and merged into removal spans.

Phrases reach the tasks in blocks of bounded size (``BLOCK_PHRASES``), one
pass over the shards for each block.  With one block documents are not
shuffled; with more, one join on a text hash brings all blocks' hits together.
Nothing about documents reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydrostar.llm.common import UPPER, arrow_pass, lower_ascii, stored, utf8, with_field

# Fixed value: the contract's word pattern (after lower-casing A-Z).
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BLOCK_PHRASES = 50_000
SHARD_BYTES = 4 << 20
SAMPLE = 8

# The same words by bytes: A-Z to a-z, other ASCII that is no letter or digit
# to a space, bytes of non-ASCII characters unchanged.
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz")
WORD_TABLE = bytes(
    c + 32 if c in UPPER.encode() else c if c in _KEEP or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, one bit per level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = list(range(max(1, (symbols - 1).bit_length()) - 1, -1, -1))
        self.bits, self.ones, self.zeros = [], [], []
        for level in self.levels:
            bit = (seq >> level & 1).astype(bool)
            self.bits.append(bit)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start = np.zeros_like(at)
        for level, ones, zeros in zip(self.levels, self.ones, self.zeros):
            bit = (symbol >> level & 1).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return at - start

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for bits, ones, zeros in zip(self.bits, self.ones, self.zeros):
            bit = bits[at]
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return symbol, at - start


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes that still share their
    rank with others are sorted again."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.diff(rank[order], prepend=-1))
    rank = np.repeat(starts, np.diff(starts, append=n))[np.argsort(order, kind="stable")]
    step = 1
    while step < n:
        sizes = np.bincount(rank, minlength=n)
        open_rows = np.flatnonzero(sizes[rank[order]] > 1)
        if not len(open_rows):
            break
        rows = order[open_rows]
        behind = rows + step
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        sub = np.lexsort((second, rank[rows]))
        rows, second = rows[sub], second[sub]
        order[open_rows] = rows
        first = rank[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads = open_rows[np.flatnonzero(new)]
        rank[rows] = heads[np.cumsum(new) - 1]
        step *= 2
    return order


class FMIndex:
    """Counts and places of phrases in a sequence of word numbers >= 1,
    where 0 separates runs.  Inside, numbers are one higher and the only 0
    ends the text, so that stepping back is exact for every symbol."""

    def __init__(self, seq: np.ndarray, symbols: int):
        seq, symbols = np.append(seq + 1, 0), symbols + 1
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.wavelet = WaveletMatrix(bwt, symbols)
        sampled = sa % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = sa[sampled]
        self.size = len(seq)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of right-aligned phrases (columns), all at once."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for k in range(width):
            go = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(go):
                break
            symbol = phrases[go, width - 1 - k] + 1
            lo[go] = self.before[symbol] + self.wavelet.rank(symbol, lo[go])
            hi[go] = self.before[symbol] + self.wavelet.rank(symbol, hi[go])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, at, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            here = rows[todo]
            done = self.sampled[here]
            at[todo[done]] = self.samples[self.sample_rank[here[done]]] + steps
            todo, here = todo[~done], here[~done]
            symbol, rank = self.wavelet.access_rank(here)
            rows[todo] = self.before[symbol] + rank
            steps += 1
        return at


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (words, items): each phrase and the items that hold it.

    Items without a word (null, empty) have no phrase; null item ids are
    dropped, repeated items count once.
    """
    words = F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(WORD_PATTERN), 0)
    cut = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), words.alias("words")
    )
    cut = cut.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)))
    cut = cut.select("item", "words", F.explode(starts).alias("start"))
    cut = cut.select("item", F.slice("words", F.col("start"), WINDOW).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


class Block:
    """A bounded set of phrases as numbers of their own vocabulary."""

    def __init__(self, rows: list[tuple[list[str], list[str]]]):
        self.vocabulary: dict[bytes, int] = {}
        numbered = []
        for words, _ in rows:
            numbered.append(
                [self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in words]
            )
        self.lengths = np.array([len(n) for n in numbered], np.int64)
        self.phrases = np.zeros((len(rows), WINDOW), np.int64)
        for k, n in enumerate(numbered):
            self.phrases[k, WINDOW - len(n) :] = n
        self.items = [items for _, items in rows]
        self.shortest = int(self.lengths.min()) if rows else 0

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, list[list], list[set]]:
        """Word counts, and for each text its merged spans and its items."""
        number = self.vocabulary.get
        split = [t.translate(WORD_TABLE).split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((number(w, 0) for ws in split for w in ws), np.int64, int(counts.sum()))
        del split
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        first = np.concatenate([[0], np.cumsum(counts)])
        if len(flat) and self.shortest:
            doc = np.repeat(np.arange(len(texts)), counts)
            seq, place = self._runs(flat, doc)
            if len(seq):
                self._find(seq, place, first, doc, spans, items)
        return counts, spans, items

    def _runs(self, flat: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of known words within one text, long enough for a phrase, each
        closed by a 0; and the place of every symbol in ``flat``."""
        known = flat > 0
        head = known.copy()
        head[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(head)
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        tail = known.copy()
        tail[:-1] &= ~known[1:] | (doc[1:] != doc[:-1])
        ends = np.flatnonzero(tail) + 1
        long = ends - starts >= self.shortest
        starts, sizes = starts[long], (ends - starts)[long]
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        out = np.concatenate([[0], np.cumsum(sizes + 1)])
        place = np.arange(out[-1]) - np.repeat(out[:-1] - starts, sizes + 1)
        seq = flat[np.minimum(place, len(flat) - 1)]
        seq[out[1:] - 1] = 0
        return seq, place

    def _find(self, seq, place, first, doc, spans, items) -> None:
        index = FMIndex(seq, len(self.vocabulary) + 1)
        lo, hi = index.search(self.phrases, self.lengths)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return
        sizes = (hi - lo)[found]
        which = np.repeat(found, sizes)
        ahead = np.cumsum(sizes) - sizes
        rows = np.arange(int(sizes.sum())) - np.repeat(ahead - lo[found], sizes)
        start = place[index.locate(rows)]
        owner = doc[start]
        for d, k in np.unique(np.stack([owner, which]), axis=1).T.tolist():
            items[d].update(self.items[k])
        order = np.argsort(start, kind="stable")
        for d, s, n in zip(
            owner[order].tolist(), start[order].tolist(), self.lengths[which[order]].tolist()
        ):
            s -= int(first[d])
            mine = spans[d]
            if mine and s <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], s + n)
            else:
                mine.append([s, s + n])


def merged(spans: Iterator[list]) -> list[list]:
    """Union of spans, sorted; touching spans become one."""
    out: list[list] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = "key string, spans array<struct<start:bigint,end:bigint>>, items array<string>"
_FOUND = "n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def find(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    clean: bool = False,
) -> DataFrame:
    """source (the whole row), n_words, spans (word numbers, end exclusive)
    and items.  With ``clean`` the row's text comes without its spans.

    One row per document row; null texts have no words; ids may repeat or be
    null; other columns go through in ``source``.  An empty benchmark finds
    nothing.

    Phrases go through in blocks of ``BLOCK_PHRASES``.  One block is one pass
    that gives the rows.  More blocks are passes one after another: each
    writes the hits of every different text that has some and is then
    dropped from the tasks, and one last pass joins the hits of all blocks to
    the rows, so a task holds one block at most.
    """
    found = stored(phrases(items, item_id_col, item_text_col), "decontam-phrases")
    blocks = max(1, -(-found.count() // BLOCK_PHRASES))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("source"))
    at = docs.columns.index(text_col)
    if blocks == 1:
        schema = StructType([*source.schema.fields, *StructType.fromDDL(_FOUND).fields])
        search = _searcher(_block(found, 0, 1), at, clean)
        return arrow_pass(source, search, schema, slice_bytes=SHARD_BYTES)

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(_text_key(text).alias("key"), text.alias("text"))
    hits = None
    for b in range(blocks):
        shared = _block(found, b, blocks)
        some = arrow_pass(texts, _block_hits(shared), _HITS, slice_bytes=SHARD_BYTES)
        # Rows with the same text have the same hits.
        one = some.groupBy("key").agg(F.first(F.struct("spans", "items")).alias("hit"))
        some = stored(one, f"decontam-{b}")
        shared.destroy()
        hits = some if hits is None else hits.unionByName(some)
    # A row a block and text at most; stored, so that AQE can split a text
    # that very many rows have.
    hits = stored(hits.groupBy("key").agg(F.collect_list("hit").alias("hits")), "decontam-hits")
    rows = source.withColumn("key", _text_key(F.coalesce(F.col(f"source.`{text_col}`"), F.lit(""))))
    rows = rows.join(hits, "key", "left").select("source", "hits")
    schema = StructType([rows.schema["source"], *StructType.fromDDL(_FOUND).fields])
    return arrow_pass(rows, _merger(at, clean), schema, slice_bytes=SHARD_BYTES)


def _text_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _block(found: DataFrame, b: int, blocks: int) -> Broadcast:
    """Block ``b`` of the phrases, sent to the tasks."""
    mine = found.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
    block = Block([(r["words"], r["items"]) for r in mine])
    return found.sparkSession.sparkContext.broadcast(block)


def _block_hits(shared: Broadcast):
    """(key, spans, items) of the texts in which the block has hits."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, spans, items = shared.value.hits([utf8(t) for t in batch.column(1).to_pylist()])
        hit = [k for k, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(hit, pa.int64())),
                pa.array([[{"start": s, "end": e} for s, e in spans[k]] for k in hit], _SPANS),
                pa.array([sorted(items[k]) for k in hit], pa.list_(pa.string())),
            ],
            names=["key", "spans", "items"],
        )

    return rows


def _reply(
    source: pa.Array, at: int, clean: bool, counts: np.ndarray, spans: list[list], items: list[list]
) -> pa.RecordBatch:
    """The result's rows; with ``clean`` the texts lose their spans."""
    if clean:
        given = pc.struct_field(source, at).to_pylist()
        cut = [cut_spans(t, xs) if xs else t for t, xs in zip(given, spans)]
        source = with_field(source, at, pa.array(cut, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            source,
            pa.array(counts),
            pa.array([[{"start": s, "end": e} for s, e in xs] for xs in spans], _SPANS),
            pa.array(items, pa.list_(pa.string())),
        ],
        names=["source", "n_words", "spans", "items"],
    )


def _searcher(shared: Broadcast, at: int, clean: bool):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        source = batch.column(0)
        texts = [utf8(t) for t in pc.struct_field(source, at).to_pylist()]
        counts, spans, items = shared.value.hits(texts)
        return _reply(source, at, clean, counts, spans, [sorted(i) for i in items])

    return rows


def _merger(at: int, clean: bool):
    """Word counts, and the union of the blocks' spans and items."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        source = batch.column(0)
        texts = [utf8(t) for t in pc.struct_field(source, at).to_pylist()]
        counts = np.array([len(t.translate(WORD_TABLE).split()) for t in texts], np.int64)
        hits = [h or [] for h in batch.column(1).to_pylist()]
        spans = [merged([x["start"], x["end"]] for h in hs for x in h["spans"]) for hs in hits]
        items = [sorted({i for h in hs for i in h["items"]}) for hs in hits]
        return _reply(source, at, clean, counts, spans, items)

    return rows


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from each span's first to its last word.

    A space that the cut leaves doubled, or at the start, goes too.
    """
    raw = utf8(text)
    ends = [m.span() for m in _WORD.finditer(raw.translate(WORD_TABLE))]
    out, at = bytearray(), 0
    for s, e in spans:
        out += raw[at : ends[s][0]]
        at = ends[e - 1][1]
        if (not out or out[-1:].isspace()) and raw[at : at + 1] == b" ":
            at += 1
    out += raw[at:]
    return out.decode("utf-8")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select(
        F.col(f"source.{id_col}").alias(id_col),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
