"""Operator 8, SimHash near-dedup by pigeonhole blocks.

A 64-bit fingerprint is cut into ``b`` blocks.  Two fingerprints that differ
in at most ``d`` bits agree on at least ``b - d`` whole blocks, so every such
pair meets under one of the C(b, d) choices of ``b - d`` blocks.  Rows of one
choice and equal blocks form a bucket; inside it Hamming distances are
verified, and only a spanning forest of the links found is emitted: never
more rows than the bucket has, but every link's two ends stay connected.

Everything after the fingerprints runs on distinct fingerprints, so copies of
a text cost one row.  A bucket with more than ``BUCKET_ROWS`` fingerprints is
split by a further block; if that leaves one as large, it is dealt into parts,
and each pair of parts is verified in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrostar.llm.common import LOWER_TABLE, arrow_pass, map_in_arrow, stored, utf8
from hydrostar.llm.graph import components

BITS = 64
SEED = 42
BUCKET_ROWS = 4096
MEAN_BUCKET = 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Bitwise majority of the shingles' XXH64; 0 without words."""
    words = utf8(text).translate(LOWER_TABLE).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end + 1 - size
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(start[at:to].tolist(), end[at + shingle - 1 : to + shingle - 1].tolist())
        h = np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, to - at)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def text_hash(text_col: str) -> Column:
    """Tells apart rows of one id with different texts."""
    return F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0).cast("long"))


def fingerprints(
    df: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, row (text hash) and fp (64 bits in a long) of every whole text;
    null texts are empty."""
    source = df.select(
        F.col(id_col).alias("id"), text_hash(text_col).alias("row"), F.col(text_col).alias("text")
    )
    kind = source.schema["id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
        fps = pa.array(np.array(found, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], fps], names=["id", "row", "fp"])

    return arrow_pass(source, rows, f"id {kind}, row long, fp long")


def block_masks(distance: int, count: int) -> list[int]:
    """One mask for each choice of blocks that a linked pair must share.

    More blocks mean longer keys and more choices; their number follows the
    number of fingerprints, so that a bucket of evenly spread fingerprints
    stays near ``MEAN_BUCKET``.  Every choice finds the same links.
    """
    for blocks in range(distance + 2, distance + 9):
        key_bits = BITS * (blocks - distance) // blocks
        if count <= MEAN_BUCKET << key_bits:
            break
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def inner_masks(mask: int, distance: int) -> list[int]:
    """``mask`` widened by one further block of the bits it leaves out: one
    mask for each choice that a linked pair with equal ``mask`` bits must share."""
    free = [1 << b for b in range(BITS) if not mask >> b & 1]
    edges = [len(free) * k // (distance + 1) for k in range(distance + 2)]
    return [mask | sum(free[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def _masked(fps: DataFrame, masks: Column) -> DataFrame:
    """Every fingerprint under every mask; choice is the mask."""
    return fps.select("fp", F.explode(masks).alias("choice")).select(
        "choice", F.col("fp").bitwiseAND(F.col("choice")).alias("key"), "fp"
    )


def _over(keyed: DataFrame) -> DataFrame:
    """The buckets of more than ``BUCKET_ROWS`` rows, and their parts."""
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n"))
    return sizes.where(F.col("n") > BUCKET_ROWS).select(
        "choice", "key", F.ceil(F.col("n") / (BUCKET_ROWS // 2)).cast("int").alias("parts")
    )


def buckets(fps: DataFrame, distance: int, count: int) -> DataFrame:
    """(choice, key, part, fp): fp is in bucket (choice, key), and there
    in the pair of parts ``part``.

    A bucket of more than ``BUCKET_ROWS`` fingerprints is split by a further
    block of the bits outside its mask, and only what is still larger then
    is dealt into pairs of parts.
    """
    masks = block_masks(distance, count)
    literal = lambda ms: F.array(*[F.lit(_signed(m)).cast("long") for m in ms])
    keyed = _masked(fps, literal(masks))
    large = stored(_over(keyed), "simhash-large")
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        return keyed.select("choice", "key", zero.alias("part"), "fp")
    small = keyed.join(large, ["choice", "key"], "left_anti").withColumn("part", zero)
    wider = F.create_map(
        *[x for m in masks for x in (F.lit(_signed(m)).cast("long"), literal(inner_masks(m, distance)))]
    )
    inner = keyed.join(large.select("choice", "key"), ["choice", "key"]).select(
        F.explode(wider[F.col("choice")]).alias("choice"), "fp"
    )
    # Two outer masks can widen to one and the same.
    inner = stored(
        inner.select(
            "choice", F.col("fp").bitwiseAND(F.col("choice")).alias("key"), "fp"
        ).distinct(),
        "simhash-inner",
    )
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts").isNull(), F.array(zero)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1),
            lambda j: F.least(own, j).cast("long") * F.col("parts") + F.greatest(own, j),
        )
    )
    dealt = inner.join(stored(_over(inner), "simhash-larger"), ["choice", "key"], "left").select(
        "choice", "key", F.explode(pairs).alias("part"), "fp"
    )
    return small.select("choice", "key", "part", "fp").unionByName(dealt)


def _forest(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges among rows of equal ``key`` (rows sorted by key)."""
    label = np.arange(len(fp))
    for step in range(1, len(fp)):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + step]) <= distance]
        left, right = label[near], label[near + step]
        while (left != right).any():
            # Hang the larger root on the smaller one, then shorten all paths.
            np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
            while not (label[label] == label).all():
                label = label[label]
            left, right = label[near], label[near + step]
    child = np.flatnonzero(label != np.arange(len(fp)))
    return fp[child], fp[label[child]]


def links(fps: DataFrame, distance: int, count: int) -> DataFrame:
    """Different edges (a, b) that connect what the verified links connect."""

    def emit(group, fp):
        # Equal (choice, key, part) rows are neighbours; number the groups.
        a, b = _forest(group, fp, distance)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate(x) for x in zip(kept, cols)] if kept else cols
            if not len(cols[0]):
                continue
            edge = np.zeros(len(cols[0]), bool)
            edge[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])
            group = np.cumsum(edge)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield emit(group[:last], cols[3][:last].view(np.uint64))
            kept = [c[last:] for c in cols]
        if kept:
            yield emit(np.zeros(len(kept[0]), np.int64), kept[3].view(np.uint64))

    dealt = buckets(fps, distance, count)
    dealt = dealt.repartition("choice", "key", "part").sortWithinPartitions("choice", "key", "part")
    # A link found under several choices counts once.
    return map_in_arrow(dealt, run, "a long, b long").distinct()


def classes(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, root, first) of every different fingerprint: its component, and
    the component's first row (no_id, id, row): the smallest id, then the
    smallest text hash; rows without an id come last."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    own = stored(rows.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    roots = components(links(own.select("fp"), distance, own.count()))
    member = own.join(roots, own["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = member.groupBy("root").agg(F.min("first").alias("first"))
    return member.select("fp", "root").join(smallest, "root")


def near_duplicates(
    df: DataFrame,
    shingle: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, fp and component_id (smallest id reachable) of every row.

    Rows without words have fingerprint 0 and link like any other.  Null ids
    are never the smallest; a component of null ids only has a null id.
    Repeated rows each keep their row.  An empty table gives no rows.  Other
    columns are ignored.
    """
    rows = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    named = classes(rows, distance).select("fp", F.col("first.id").alias("component_id"))
    # Stored, so that both sides of the join are plain shuffles and AQE can
    # split a fingerprint that very many rows have.
    named = stored(named, "named")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(
    df: DataFrame,
    shingle: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Whole rows: one of each component, the one with the smallest id.

    Of rows with that id but different texts the smallest text hash decides,
    of rows equal in both any one stays; a component without ids keeps one
    row.  The choice is made on (id, text hash) only, in aggregates.
    """
    rows = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    chosen = classes(rows, distance).select("first").distinct()
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("source"),
        F.col(id_col).alias("id"),
        text_hash(text_col).alias("row"),
    ).alias("d")
    c = chosen.select(F.col("first.id").alias("id"), F.col("first.row").alias("row")).alias("c")
    same = F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.row") == F.col("c.row"))
    kept = keyed.join(c, same, "left_semi").dropDuplicates(["id", "row"])
    return kept.select(*[F.col(f"source.`{c}`").alias(c) for c in df.columns])


def fingerprint_text(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
