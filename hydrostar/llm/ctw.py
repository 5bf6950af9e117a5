"""Operator 3, LM scoring by context-tree weighting over bytes.

Text is lower-cased (A-Z) and read as words, each closed by a space, with one
line feed at the end.  A byte is eight binary decisions; its context is the
last one, two, ... up to ``depth`` bytes of the text before it, spaces and
earlier words included (before its start a text has a space, and line feeds
before that).  Every node (context, bits of the byte so far) counts zeros and
ones over the training texts and has the Krichevsky-Trofimov estimate;
context-tree weighting mixes the estimates of all depths along a context,
each node weighing its own estimate against the other depths by their
probabilities of the training data.  A depth whose node the training texts
never reached leaves the byte to the depths before it.

Inside a word, from its byte number ``depth`` on, one depth more is mixed in:
the whole word so far, however long (``whole_prefixes``), again with a weight
for every binary node.  There the ``depth`` bytes before are the word's own,
so what this depth adds to a word is a function of the word, and that work is
on different words instead of positions.

With ``across_words=False`` contexts end at the space that starts the word.

1. ``number_words``: batches of texts list their (context, byte) pairs and
   their words, each with training counts, and keep their texts.
2. One shuffle by pair gives every pair its corpus count; ``tree_levels`` /
   ``mixed``: one aggregate a depth upward for the weights, one join a depth
   downward for the mixture.
3. ``vocabulary``: one shuffle by word gives every different word its corpus
   count; ``in_shards`` deals the words into ranges of their byte order, no
   more than a bounded sample of words gives, and cuts longer ranges.  The
   words of a prefix are neighbours there, so only prefixes of a range's first
   and last word can go on in other ranges: ``asks`` lists their counts, Spark
   adds them up (``open_prefixes``).  A prefix may have any number of words.
4. ``word_scores``: ranges add the last depth; what it adds to a word is joined
   to the batches that list the word, and so are the pairs' probabilities.
5. ``score``: batches look up every position and add up their texts.

Counts cover every training text.  Nothing but a few totals reaches the
driver; the model is tables as large as the corpus makes them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrostar.llm.common import (
    LOWER_TABLE,
    fold,
    import_on_workers,
    map_in_arrow,
    sliced,
    stored,
    utf8,
)

# A batch lists its different pairs and words once: the larger it is, the fewer
# rows travel for a byte of text.
BATCH_BYTES = 32 << 20
# So many bytes of different words make a shard.
SHARD_BYTES = 4 << 20
# To find ranges, Spark sends so many words a range to the driver, each with so
# many bytes of objects around it; all of them together may take so many bytes.
SAMPLED, AROUND, SAMPLE_BYTES = 300, 128, 32 << 20
PIECE_BYTES = 4 << 20
# So many texts are compressed together, at this level.
PACKED = 256
LEVEL = 6
SPACE, END = 32, 10
# Natural logs of the probabilities of a byte's eight bits.
BITS = [f"s{t}" for t in range(8)]
LN2, LN10 = float(np.log(2)), float(np.log(10))
# So many bytes of lone rests of words go through numpy at once.
REST_BYTES = 1 << 17


def text_grams(
    lines: list[bytes], depth: int, across_words: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """For every byte of every line but the space that starts it, in order and
    in pieces of bounded size: the key (number of context bytes, context,
    byte), where in the keys each part of a line starts, and the parts' lines."""
    before = b"\n" * (depth - 1) if across_words else b""
    start = len(before) + 1
    parts: list[bytes] = []
    owners: list[int] = []
    skips: list[int] = []
    size = 0

    def keys() -> tuple[np.ndarray, np.ndarray, list[int]]:
        # ``depth`` bytes in front let every context be a slice.
        raw = np.frombuffer(b" " * depth + b"".join(parts), np.uint8)
        n = len(raw) - depth
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        used = None
        if not across_words:
            at = np.arange(len(raw))
            space = np.maximum.accumulate(np.where(raw == SPACE, at, 0))
            used = np.minimum(at - np.concatenate([[0], space[:-1]]), depth)[depth:]
        key = raw[depth:].astype(np.int64)
        for j in range(1, depth + 1):
            byte = raw[depth - j : depth - j + n].astype(np.int64)
            byte <<= 8 * j
            key |= byte if used is None else np.where(used >= j, byte, 0)
        key |= depth << 56 if used is None else used << 56
        asked = np.ones(n, bool)
        for j in range(max(skips)):
            asked[starts[np.array(skips) > j] + j] = False
        return key[asked], starts - (np.cumsum(skips) - skips), owners

    for k, line in enumerate(lines):
        line = before + line
        for s in range(0, len(line), PIECE_BYTES):
            # Later pieces of a long line carry the bytes before them along.
            head = min(s, depth)
            part = line[s - head : s + PIECE_BYTES]
            parts.append(part)
            owners.append(k)
            skips.append(head if s else start)
            size += len(part)
            if size >= PIECE_BYTES:
                yield keys()
                parts, owners, skips, size = [], [], [], 0
    if parts:
        yield keys()


class Lookup:
    """Values of sorted different keys: one hashed slot a key; keys that share
    a slot are searched."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.key, self.value = key, value
        self.shift = np.uint64(64 - max(4, int(len(key)).bit_length() + 2))
        self.slot = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.slot[self._hash(key)] = np.arange(len(key), dtype=np.int32)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        mixed_bits = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed_bits >>= self.shift
        return mixed_bits.view(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(key)]
        other = np.flatnonzero(self.key[at] != key)
        at[other] = np.searchsorted(self.key, key[other])
        return self.value[at]


def first_seen() -> defaultdict[bytes, int]:
    """Numbers words from 0 on, as they are first looked up."""
    return defaultdict(count().__next__)


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    key, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(back, np.concatenate([p[1] for p in parts]), minlength=len(key))
    return key, n


def pair_counts(
    lines: list[bytes], held: list[bool], depth: int, across_words: bool
) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of ``text_grams``, and how often lines that are not
    held out have them."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for kind in (False, True):
        some = [line for line, h in zip(lines, held) if bool(h) == kind]
        for key, _, _ in text_grams(some, depth, across_words):
            key, n = np.unique(key, return_counts=True)
            parts.append((key, n * (0.0 if kind else 1.0)))
            # Merge where at least half as much came as was there.
            while len(parts) > 1 and 2 * len(parts[-1][0]) >= len(parts[-2][0]):
                parts[-2:] = [_sums(parts[-2:])]
    return _sums(parts)


def number_words(docs: DataFrame, depth: int, across_words: bool) -> DataFrame:
    """From (id, held_out, text): rows of texts (row: the number in the batch,
    id, held_out, n_bytes, line: the folded texts from here on, packed), rows of words (k: the
    number, word, count: occurrences in training texts) and rows of pairs
    (gram, count), all with their batch.

    A batch is a run of texts of one input partition, so it is the same
    again when a lost task is repeated.  Words are numbered as they first
    occur in the batch's rows.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    schema = (
        f"batch long, row int, id {id_type}, held_out boolean, n_bytes long, line binary, "
        "k int, word binary, gram long, count long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        codec = pa.Codec("zstd", compression_level=LEVEL)
        kind = None
        number = first_seen()
        rows: list[tuple] = []
        trained: list[np.ndarray] = [np.zeros(0, np.uint32)]
        size = 0

        def made(m: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {
                "batch": pa.int64(), "row": pa.int32(), "id": kind, "held_out": pa.bool_(),
                "n_bytes": pa.int64(), "line": pa.binary(), "k": pa.int32(), "word": pa.binary(),
                "gram": pa.int64(), "count": pa.int64(),
            }
            columns["batch"] = pa.array(np.full(m, serial))
            return pa.RecordBatch.from_arrays(
                [columns[c] if c in columns else pa.nulls(m, t) for c, t in kinds.items()],
                names=list(kinds),
            )

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(number)
            counts = np.zeros(len(words), np.int64)
            for some in trained:
                counts += np.bincount(some, minlength=len(words))
            ids, held, n_bytes, lines = zip(*rows)
            for at in range(0, len(rows), PACKED):
                cut = slice(at, at + PACKED)
                m = len(ids[cut])
                packed = codec.compress(b"".join(lines[cut]), asbytes=True)
                yield made(
                    m,
                    row=pa.array(np.arange(at, at + m, dtype=np.int32)),
                    id=pa.array(ids[cut], kind),
                    held_out=pa.array(held[cut], pa.bool_()),
                    n_bytes=pa.array(n_bytes[cut], pa.int64()),
                    line=pa.array([packed] + [None] * (m - 1), pa.binary()),
                )
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                m = len(part)
                yield made(
                    m,
                    k=pa.array(np.arange(at, at + m, dtype=np.int32)),
                    word=pa.array(part, pa.binary()),
                    count=pa.array(counts[at : at + m]),
                )
            gram, n = pair_counts(lines, held, depth, across_words)
            for at in range(0, len(gram), 1 << 16):
                part = gram[at : at + (1 << 16)]
                seen = n[at : at + (1 << 16)].astype(np.int64)
                yield made(len(part), gram=pa.array(part), count=pa.array(seen))

        for batch in batches:
            for part in sliced(batch, 4 << 20):
                kind = part.schema.field(0).type
                for i, held, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = utf8(text).translate(LOWER_TABLE).split()
                    ids = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
                    if not held:
                        trained.append(ids)
                    line = b" ".join([b"", *words, b"\n"])
                    n_bytes = len(line) - 1
                    rows.append((i, held, n_bytes, line))
                    size += n_bytes
                    if size >= BATCH_BYTES:
                        yield from flush()
                        serial, number, rows, size = serial + 1, first_seen(), [], 0
                        trained = [np.zeros(0, np.uint32)]
        if rows:
            yield from flush()

    return map_in_arrow(docs, run, schema)


def unpacked(n_bytes: np.ndarray, packed: list[bytes | None]) -> list[bytes]:
    """The folded texts of a batch, whose rows are in order."""
    lines: list[bytes] = []
    for at in range(0, len(packed), PACKED):
        ends = np.cumsum(n_bytes[at : at + PACKED] + 1).tolist()
        whole = pa.decompress(packed[at], decompressed_size=ends[-1], codec="zstd", asbytes=True)
        lines += [whole[a:b] for a, b in zip([0, *ends], ends)]
    return lines


def vocabulary(listed: DataFrame) -> DataFrame:
    """(word, c): every different word with its corpus count."""
    return listed.groupBy("word").agg(F.sum("count").alias("c"))


def in_shards(words: DataFrame, n_words: int, n_bytes: int) -> DataFrame:
    """(word, c, shard) of ``n_words`` words with ``n_bytes`` bytes: shards are
    ranges of the words in byte order, of about ``SHARD_BYTES`` each.

    Long words would make the sample that ranges are found by as large as a
    good part of the vocabulary, so it gives fewer ranges then, and every
    range is cut where it lies, in order.
    """
    shards = max(1, -(-n_bytes // SHARD_BYTES))
    of_sample = SAMPLE_BYTES * n_words // max(1, SAMPLED * (n_bytes + AROUND * n_words))
    ranges = max(1, min(shards, of_sample))
    dealt = words.repartitionByRange(ranges, "word").withColumn(
        "shard", F.spark_partition_id().cast("long")
    )
    return dealt if ranges == shards else _cut(dealt.sortWithinPartitions("word"))


def _cut(dealt: DataFrame) -> DataFrame:
    """Ranges whose words are in order, cut into shards of ``SHARD_BYTES``."""
    most = SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            ends = before + np.cumsum(pc.binary_length(batch.column("word")).to_numpy() + np.int64(1))
            shard = batch.column("shard").to_numpy() << 32 | np.append(before, ends)[:-1] // most
            before = int(ends[-1]) if len(ends) else before
            yield batch.set_column(batch.schema.get_field_index("shard"), "shard", pa.array(shard))

    return map_in_arrow(dealt, run, dealt.schema)


def grams(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes of every word and its closing space, in order, that have
    ``depth`` bytes of the word before them: the key (``depth``, context,
    byte), the place among all bytes, and the word they belong to."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.flatnonzero(np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] >= depth)
    context = np.zeros(len(place), np.int64)
    for j in range(1, depth + 1):
        context |= raw[place + 1 - j].astype(np.int64) << 8 * (j - 1)
    return gram_key(np.full(len(place), depth), context, raw[place + 1]), place, owner[place]


def gram_key(used, context, byte):
    return used << 56 | context << 8 | byte


def outer_prefixes(words: list[bytes], counts: list[int], depth: int) -> Iterator[tuple]:
    """(digest of the prefix, side, length, key of the next byte, training
    count) for every prefix of ``depth`` bytes or more of the first (side 0)
    and the last (side 1) of sorted different ``words``, each prefix once."""
    sums = [0, *accumulate(counts)]
    for side, w in enumerate((words[0], words[-1])):
        if len(w) < depth:
            continue
        head = w[:depth]
        lo = bisect_left(words, head, key=lambda x: x[:depth])
        hi = bisect_right(words, head, lo, key=lambda x: x[:depth])
        digest = blake2b(head, digest_size=16)
        for length in range(depth, len(w) + 1):
            # words[lo:hi] have this prefix; one that ends here comes first.
            def following(x: bytes) -> int:
                return x[length] if len(x) > length else -1

            if side == 1 and lo == 0:
                at = hi  # the first word has this prefix too
            else:
                at = lo
            context = int.from_bytes(w[length - depth : length], "big")
            while at < hi:
                byte = following(words[at])
                end = bisect_right(words, byte, at, hi, key=following)
                key = gram_key(depth, context, SPACE if byte < 0 else byte)
                yield digest.digest(), side, length, key, sums[end] - sums[at]
                at = end
            if length < len(w):
                digest.update(w[length : length + 1])
                lo = bisect_left(words, w[length], lo, hi, key=following)
                hi = bisect_right(words, w[length], lo, hi, key=following)


def asks(words: DataFrame, depth: int) -> DataFrame:
    """(shard, gram, prefix, side, length, n): the different pairs that the
    words of a shard ask for (no prefix), and its ``outer_prefixes``."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("word")
        here = part.column("word").to_pylist()
        key = np.unique(grams(here, depth)[0])
        outer = list(outer_prefixes(here, part.column("c").to_pylist(), depth))
        prefix, side, length, gram, n = zip(*outer) if outer else [()] * 5
        none = [None] * len(key)
        return pa.table(
            {
                "shard": pa.array(np.full(len(key) + len(outer), part.column("shard")[0].as_py())),
                "gram": pa.array(np.concatenate([key, np.array(gram, np.int64)])),
                "prefix": pa.array([*none, *prefix], pa.binary()),
                "side": pa.array([*none, *side], pa.int32()),
                "length": pa.array([*none, *length], pa.int32()),
                "n": pa.array([*none, *n], pa.int64()),
            }
        )

    import_on_workers(words.sparkSession)
    return (
        words.select("shard", "word", "c")
        .groupBy("shard")
        .applyInArrow(run, "shard long, gram long, prefix binary, side int, length int, n long")
    )


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that is never a broadcast: by the size of their
    compressed files alone, tables of this model that grow with the corpus can
    look small enough for one and be many times larger on the driver."""
    return df.hint("merge")


def open_prefixes(asked: DataFrame) -> DataFrame:
    """(shard, gram, side, length, n): for every shard and each of its outer
    prefixes that other shards have too, all next bytes with their counts in
    all shards."""
    outer = asked.where(F.col("prefix").isNotNull())
    in_all = outer.groupBy("prefix", "gram").agg(F.sum("n").alias("n"))
    holders = outer.select("shard", "prefix", "side", "length").distinct()
    shared = holders.groupBy("prefix").agg(F.count("*").alias("holders")).where("holders > 1")
    return (
        holders.join(by_shuffle(shared.select("prefix")), "prefix")
        .join(by_shuffle(in_all), "prefix")
        .select("shard", "gram", "side", "length", "n")
    )


def _ln_gamma(x: Column) -> Column:
    """log Gamma for x >= 0.5: eight steps up, then Stirling's series."""
    product = F.lit(1.0)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5))
    half_ln_2pi = 0.9189385332046727
    return (y - 0.5) * F.ln(y) - y + half_ln_2pi + series - F.ln(product)


def _ln_kt(a: Column, b: Column) -> Column:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    ln_pi = 1.1447298858494002
    return _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - ln_pi - _ln_gamma(a + b + 1.0)


def _bits(rows: DataFrame) -> DataFrame:
    """Eight rows for each (used, context, byte): node and bit."""
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(7))))
    node = F.expr("shiftright(256 + byte, 8 - t)")
    bit = F.expr("shiftright(byte, 7 - t) & 1")
    return rows.withColumn("node", node.cast("int")).withColumn("bit", bit.cast("int")).drop("t")


def split_grams(table: DataFrame) -> DataFrame:
    return table.select(
        "gram",
        "n",
        F.shiftright("gram", 56).cast("int").alias("used"),
        F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 48) - 1)).alias("context"),
        F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte"),
    )


def tree_levels(counted: DataFrame, depth: int) -> list[DataFrame]:
    """For each depth, its nodes: context, node, a, b (zeros and ones), kt,
    lw (log weighted probability) and leaf (no deeper context).

    Contexts that end at the word's start are leaves at their own depth.
    """
    leaves = stored(
        _bits(counted)
        .groupBy("used", "context", "node")
        .agg(
            F.sum(F.col("n") * (1 - F.col("bit"))).alias("a"),
            F.sum(F.col("n") * F.col("bit")).alias("b"),
        ),
        "ctw-leaves",
    )
    levels: list[DataFrame] = []
    below = None
    for d in range(depth, -1, -1):
        own = leaves.where(F.col("used") == d).select(
            "context", "node", "a", "b", F.lit(0.0).alias("child"), F.lit(True).alias("leaf")
        )
        if below is not None:
            up = below.groupBy(
                F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("context"), "node"
            ).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("child"))
            own = own.unionByName(up.withColumn("leaf", F.lit(False)))
        kt = _ln_kt(F.col("a").cast("double"), F.col("b").cast("double"))
        high, low = F.greatest("kt", "child"), F.least("kt", "child")
        both = high + F.log1p(F.exp(low - high)) - LN2
        own = own.withColumn("kt", kt).withColumn(
            "lw", F.when(F.col("leaf"), F.col("kt")).otherwise(both)
        )
        below = stored(own.drop("child"), f"ctw-{d}")
        levels.insert(0, below)
    return levels


def mixed(levels: list[DataFrame]) -> DataFrame:
    """(used, context, node, one): the mixture's probability of a 1 at every
    leaf context, from the root down.

    done and rest carry the sum of weighted estimates so far and the weight
    left for deeper nodes; ``one`` is the mixture if the node is the last.
    """
    found = None
    above = None
    for d, level in enumerate(levels):
        if above is None:
            rows = level.withColumns(
                {"done_above": F.lit(0.0), "rest_above": F.lit(1.0), "one_above": F.lit(0.5)}
            )
        else:
            parent = above.select(
                F.col("context").alias("parent"),
                "node",
                F.col("done").alias("done_above"),
                F.col("rest").alias("rest_above"),
                F.col("one").alias("one_above"),
            )
            # The first two depths have 256 * 255 nodes at most.
            parent = parent if d < 3 else by_shuffle(parent)
            shorter = F.col("context").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))
            rows = level.withColumn("parent", shorter).join(parent, ["parent", "node"])
        estimate = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
        weight = F.when(F.col("leaf"), F.lit(1.0)).otherwise(
            F.least(F.exp(F.col("kt") - LN2 - F.col("lw")), F.lit(1.0))
        )
        seen = F.col("a") + F.col("b") > 0
        rest = F.col("rest_above")
        done = F.col("done_above")
        rows = rows.select(
            "context",
            "node",
            "leaf",
            F.when(seen, done + rest * estimate).otherwise(F.col("one_above")).alias("one"),
            F.when(seen, done + rest * weight * estimate).otherwise(F.col("one_above")).alias("done"),
            F.when(seen, rest * (1.0 - weight)).otherwise(F.lit(0.0)).alias("rest"),
        )
        above = stored(rows, f"ctw-mix-{d}")
        here = above.where("leaf").select(F.lit(d).alias("used"), "context", "node", "one")
        found = here if found is None else found.unionByName(here)
    return found


def gram_scores(counted: DataFrame, depth: int) -> DataFrame:
    """(gram, lp, and the columns ``BITS``): log10 probability of each byte
    after its context, and the natural logs for its bits."""
    predicted = mixed(tree_levels(counted, depth))
    asked = _bits(counted.select("gram", "used", "context", "byte"))
    one = F.col("one")
    node = F.col("node")
    rows = asked.join(by_shuffle(predicted), ["used", "context", "node"]).select(
        "gram", "node", F.ln(F.when(F.col("bit") == 1, one).otherwise(1 - one)).alias("ln")
    )
    # The node of bit t is 1 and the t bits before it.
    of_bits = [
        F.sum(F.when(node.between(1 << t, (2 << t) - 1), F.col("ln"))).alias(c)
        for t, c in enumerate(BITS)
    ]
    # A pair's bits come from eight joins' keys, so summing before the shuffle
    # would send nine sums for each of them; the rows are sent as they are.
    return rows.repartition("gram").groupBy("gram").agg((F.sum("ln") / LN10).alias("lp"), *of_bits)


def _ln_gamma_of(x: np.ndarray) -> np.ndarray:
    """``_ln_gamma`` in numpy."""
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(product)


def _ln_kt_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ln_gamma_of(a + 0.5) + _ln_gamma_of(b + 0.5) - 1.1447298858494002 - _ln_gamma_of(a + b + 1)


def _blend(own: np.ndarray, shallow: np.ndarray, own_block, shallow_block, seen) -> np.ndarray:
    """Log of the mixture of a node's own estimate (``own``) and the depths
    before it (``shallow``), weighed by how probable each makes the node's bits
    in the training words; natural logs throughout."""
    weight = 1 / (1 + np.exp(np.clip(shallow_block - own_block, -700, 700)))
    weight = np.where(seen, weight, 0.0)
    return np.log(weight * np.exp(own) + (1 - weight) * np.exp(shallow))


def whole_prefixes(
    words: list[bytes],
    counts: np.ndarray,
    gram_of: np.ndarray,
    bits: np.ndarray,
    depth: int,
    others: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> np.ndarray:
    """What the last depth adds to the log10 probability of every word of
    sorted different ``words``, the closing space included.

    ``bits[gram_of[p]]``: for every byte p of the words and their closing spaces
    the logs that the depths before give its bits.  ``others``: for (length,
    side) of a prefix that words elsewhere have too, all next bytes, their
    counts everywhere and their rows of ``bits``.

    Every prefix of ``depth`` bytes or more, however long, takes part.
    Prefixes that several words share go through byte by byte; from where a
    word shares its prefix with no other, its rest is done at once.
    """
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(sizes + 1) - sizes - 1
    added = np.zeros(len(words))
    rows = np.flatnonzero(sizes >= depth)
    start = np.zeros(len(rows), np.int64)
    for j in range(depth):
        start = start << 8 | raw[first[rows] + j]
    group = np.cumsum(np.diff(start, prepend=-1) != 0) - 1
    at = depth
    while len(rows):
        alone = np.bincount(group)[group] == 1
        for side, end in enumerate((0, group[-1])):
            if (at, side) in others:
                alone &= group != end
        _lone_rests(rows[alone], at, sizes, first, counts, gram_of, bits, added)
        rows, group = rows[~alone], group[~alone]
        if not len(rows):
            break
        group = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
        place = first[rows] + at
        key, head, back = np.unique(
            group << 8 | raw[place], return_index=True, return_inverse=True
        )
        total = np.bincount(back, counts[rows], minlength=len(key))
        gram = gram_of[place[head]]
        for side, end in enumerate((0, group[-1])):
            if (at, side) in others:
                byte, n, row = others[at, side]
                # Counts everywhere come before the counts of these words.
                key, pick, where = np.unique(
                    np.concatenate([end << 8 | byte, key]), return_index=True, return_inverse=True
                )
                total = np.concatenate([n, total])[pick]
                gram = np.concatenate([row, gram])[pick]
                back = where[len(byte) :][back]
        of, byte = key >> 8, key & 255
        shallow = bits[gram]
        gained = np.zeros(len(key))
        for t in range(8):
            node = of << 8 | (256 + byte) >> (8 - t)
            new = np.diff(node, prepend=-1) != 0
            heads, inside = np.flatnonzero(new), np.cumsum(new) - 1
            one = (byte >> (7 - t) & 1).astype(bool)
            ones = np.add.reduceat(np.where(one, total, 0.0), heads)
            zeros = np.add.reduceat(np.where(one, 0.0, total), heads)
            hit = np.where(one, ones[inside], zeros[inside])
            own = np.log((hit + 0.5) / (ones + zeros + 1)[inside])
            own_block = _ln_kt_of(zeros, ones)[inside]
            before = np.add.reduceat(total * shallow[:, t], heads)[inside]
            seen = (ones + zeros > 0)[inside]
            gained += _blend(own, shallow[:, t], own_block, before, seen) - shallow[:, t]
        added[rows] += gained[back]
        # Words that ended leave; the others part by their byte.
        goes_on = sizes[rows] > at
        rows, group = rows[goes_on], back[goes_on]
        group = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
        at += 1
    return added / LN10


def _lone_rests(rows, at: int, sizes, first, counts, gram_of, bits, added) -> None:
    """``whole_prefixes`` for words without others of their prefix of ``at``
    bytes: each later prefix has one next byte, seen as often as the word.
    Words that training does not have gain nothing."""
    rows = rows[counts[rows] > 0]
    n = counts[rows].astype(float)
    own = np.log((n + 0.5) / (n + 1))
    own_block = _ln_kt_of(np.zeros(len(n)), n)
    ends = np.cumsum(sizes[rows] - at + 1)
    starts = ends - (sizes[rows] - at + 1)
    for s in range(0, int(ends[-1]) if len(ends) else 0, REST_BYTES):
        flat = np.arange(s, min(s + REST_BYTES, int(ends[-1])))
        r = np.searchsorted(ends, flat, side="right")
        shallow = bits[gram_of[first[rows[r]] + at + flat - starts[r]]]
        both = _blend(own[r, None], shallow, own_block[r, None], n[r, None] * shallow, True)
        gained = np.bincount(r - r[0], (both - shallow).sum(axis=1))
        added[rows[r[0] : r[-1] + 1]] += gained


def word_scores(words: DataFrame, replies: DataFrame, depth: int) -> DataFrame:
    """(word, c, lp) of every different word, lp: what the last depth adds to
    its log10 probability; ``replies`` has (shard, gram, side, length, n and
    ``BITS``): a shard's pairs (no side) and its ``open_prefixes``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("word")
        here = left.column("word").to_pylist()
        counts = left.column("c").to_numpy()
        right = right.sort_by("gram")
        gram = right.column("gram").to_numpy()
        bits = np.stack([right.column(c).to_numpy() for c in BITS], axis=1)
        key, place, _ = grams(here, depth)
        gram_of = np.zeros(sum(map(len, here)) + len(here), np.int32)
        gram_of[place] = np.searchsorted(gram, key)
        outer = right.column("side").is_valid()
        row = np.flatnonzero(outer.to_numpy())
        length, side, n = (right.filter(outer).column(c).to_numpy() for c in ("length", "side", "n"))
        order = np.lexsort((side, length))
        one_prefix = np.flatnonzero(np.diff(length[order] * 2 + side[order])) + 1
        others = {
            (int(length[some[0]]), int(side[some[0]])): (gram[row[some]] & 255, n[some], row[some])
            for some in np.split(order, one_prefix)
            if len(some)
        }
        lp = whole_prefixes(here, counts, gram_of, bits, depth, others)
        return pa.table({"word": left.column("word"), "c": left.column("c"), "lp": pa.array(lp)})

    import_on_workers(words.sparkSession)
    return (
        words.select("shard", "word", "c")
        .groupBy("shard")
        .cogroup(replies.groupBy("shard"))
        .applyInArrow(run, "word binary, c long, lp double")
    )


def score(
    df: DataFrame,
    held_out: Column,
    depth: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    across_words: bool = False,
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte of every whole text, learnt from rows not ``held_out``.

    Contexts run on across words with ``across_words``, else they end at the
    start of the word.  Null and empty texts are one end token.  Null ids,
    repeated rows and other columns do not matter (each row is a text of its
    own).  Without training texts the model is uniform over bits and the base
    over nothing but the unknown word.
    """
    docs = df.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    numbered = stored(number_words(docs, depth, across_words), "ctw-numbered")
    texts = numbered.where(F.col("row").isNotNull()).select(
        "batch", "row", "id", "held_out", "n_bytes", "line"
    )
    pairs = numbered.where(F.col("gram").isNotNull()).select("batch", "gram", "count")
    listed = numbered.where(F.col("word").isNotNull()).select("batch", "k", "word", "count")
    different = stored(vocabulary(listed), "ctw-vocabulary")
    ends = texts.where(~F.col("held_out")).count()
    row = different.agg(
        F.sum("c").alias("n"),
        F.count_if(F.col("c") > 0).alias("v"),
        F.count("*").alias("words"),
        F.sum(F.octet_length("word") + 1).alias("bytes"),
    ).first()
    total, distinct = (row["n"] or 0) + ends, row["v"] + (ends > 0)
    words = stored(in_shards(different, row["words"], row["bytes"] or 0), "ctw-words")

    counted = pairs.groupBy("gram").agg(F.sum("count").alias("n"))
    grams_scored = stored(gram_scores(stored(split_grams(counted), "ctw-grams"), depth), "ctw-scores")
    asked = stored(asks(words, depth), "ctw-asked")
    wanted = (
        asked.where(F.col("prefix").isNull())
        .select("shard", "gram")
        .unionByName(open_prefixes(asked), allowMissingColumns=True)
        .join(by_shuffle(grams_scored.drop("lp")), "gram")
    )
    # Both sides of the last cogroup come from one table: a name of its own.
    of_words = listed.select(F.col("batch").alias("batch"), "k", "word").join(
        by_shuffle(word_scores(words, wanted, depth)), "word"
    )
    replies = of_words.drop("word").unionByName(
        pairs.select("batch", "gram").join(by_shuffle(grams_scored.select("gram", "lp")), "gram"),
        allowMissingColumns=True,
    )

    scale = total + 0.5 * (distinct + 1)
    end_base = float(np.log10((ends + 0.5) / scale))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("row")
        lines = unpacked(left.column("n_bytes").to_numpy(), left.column("line").to_pylist())
        of_words = right.filter(pc.is_valid(right.column("k")))
        of_pairs = right.filter(pc.is_valid(right.column("gram"))).sort_by("gram")
        gram, pair_lp = of_pairs.column("gram").to_numpy(), of_pairs.column("lp").to_numpy()
        total_lp = np.zeros(len(lines))
        find = Lookup(gram, pair_lp)
        for key, starts, owners in text_grams(lines, depth, across_words):
            sums = np.add.reduceat(find(key), starts)
            total_lp += np.bincount(owners, sums, minlength=len(lines))
        k = of_words.column("k").to_numpy()
        c, lp = np.zeros(len(k), np.int64), np.zeros(len(k))
        c[k], lp[k] = of_words.column("c").to_numpy(), of_words.column("lp").to_numpy()
        base = np.log10((c + 0.5) / scale)
        number = first_seen()
        out: list[list] = [[], [], [], []]
        for line, own in zip(lines, total_lp.tolist()):
            words = line.split()
            i = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            out[0].append(len(i) + 1)
            out[1].append(int((c[i] > 0).sum()) + int(ends > 0))
            out[2].append(float(base[i].sum()) + end_base)
            out[3].append(own + float(lp[i].sum()))
        return pa.table(
            {
                "id": left.column("id"),
                "held_out": left.column("held_out"),
                "n_tokens": pa.array(out[0], pa.int64()),
                "n_known": pa.array(out[1], pa.int64()),
                "base_score": pa.array(out[2], pa.float64()),
                "score": pa.array(out[3], pa.float64()),
                "n_bytes": left.column("n_bytes"),
            }
        )

    id_type = texts.schema["id"].dataType.simpleString()
    done = (
        texts.groupBy("batch")
        .cogroup(replies.groupBy("batch"))
        .applyInArrow(
            finish,
            f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, "
            "score double, n_bytes long",
        )
    )
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")
    return done.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        bits.alias("bits_per_byte"),
    )


def contract_fold(id_col: str = "doc_id") -> Column:
    """Held out: remainder 1 of 5."""
    return fold(F.col(id_col), 5) == 1
