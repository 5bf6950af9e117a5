"""Operator 13, best-fit packing: configuration linear program.

Documents become token pieces of at most ``capacity``; as few sequences as
possible hold them all.  Only how many pieces there are of each length
matters, so the plan is made from the length histogram (``capacity`` counts
at most, whatever the input):

1. The linear program: a configuration is a set of lengths that fit into one
   sequence; cover every length's count with as few configurations as
   possible.
2. Multiplicative weights solve it: every length has a price, a knapsack
   dynamic program over the capacity finds the dearest configurations (one
   that holds each length), they are used as far as counts allow, and the price
   of a length falls with the share of its count that was covered.  Prices also
   give a lower bound on the number of sequences.
3. Rounding: whole parts of the averaged solution first, then single
   configurations in falling amounts; what is left is solved again.  After each
   of these steps the rest goes best fit, longest first, which gives a plan;
   the one with the fewest sequences is taken, and a plan at the bound ends the
   search.

The plan is a list of configurations with multiplicities, hence for each length
runs of ranks with their first sequence and their offset.  ``MAX_RUNS`` bounds
it: configurations that would exceed it are not taken from the linear program,
and best fit uses at most ``capacity`` kinds a length.  The pieces themselves
never leave the executors: each task numbers its own pieces of every
length, offsets by (length, task) turn that into ranks, and the plan, sent to
the tasks, turns ranks into places.

Rows: a null text is empty; its document is the end token alone.  Null and
repeated ids and rows are packed row by row.  Texts of any length, ties, empty
tables and columns of other names are fine.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrostar.llm.bpe import Encoder, broadcast_vocabulary
from hydrostar.llm.common import arrow_pass, map_in_arrow, sliced, stored

CAPACITY = 2048
# Fixed value: the id that ends a document.
END_ID = 0

PHASES = 48
EPSILON = 0.25
SOLVES = 5
MAX_RUNS = 1_000_000
CACHED_WORDS = 1_000_000

# Lengths (falling, repeats included) of one sequence -> number of sequences.
Plan = dict[tuple[int, ...], int]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room the dearest filling, and the last length it takes (its
    index + 1; 0: the unit of room stays empty)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fits[room]:
            total = best[room - lengths[:k]] + prices[:k]
            at = total.argmax()
            if total[at] > best[room]:
                best[room], choice[room] = total[at], at + 1
    return best, choice


def _fillings(lengths: np.ndarray, choice: np.ndarray, capacity: int) -> list[Counter]:
    """For each length the dearest configuration that holds it."""
    found = [Counter([k]) for k in range(len(lengths))]
    room = capacity - lengths
    # Empty units are skipped: the next smaller room with a choice.
    taken = np.maximum.accumulate(np.where(choice > 0, np.arange(len(choice)), 0))
    room = taken[room]
    while (live := np.flatnonzero(room)).size:
        item = choice[room[live]] - 1
        for k, i in zip(live.tolist(), item.tolist()):
            found[k][i] += 1
        room[live] = taken[room[live] - lengths[item]]
    return found


def solve(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, phases: int, epsilon: float
) -> tuple[dict[tuple[int, ...], float], float]:
    """The linear program by multiplicative weights: configurations with
    fractional amounts that cover no length beyond its count, and a lower
    bound on the sequences needed."""
    amounts: dict[tuple[int, ...], float] = defaultdict(float)
    weights, bound = np.zeros(len(lengths)), 0.0
    for _ in range(phases):
        prices = lengths / capacity * np.exp(weights)
        best, choice = knapsack(lengths, prices, capacity)
        values = prices + best[capacity - lengths]
        bound = max(bound, float(counts @ prices / values.max()))
        rest = counts.astype(float)
        fillings = _fillings(lengths, choice, capacity)
        for k in np.argsort(-values, kind="stable"):
            if values[k] < (1 - epsilon) * values.max():
                break
            filling = fillings[k]
            amount = min(rest[i] / c for i, c in filling.items())
            if amount > 1e-9:
                for i, c in filling.items():
                    rest[i] -= amount * c
                key = tuple(sorted((int(lengths[i]) for i in filling.elements()), reverse=True))
                amounts[key] += amount / phases
        weights -= epsilon * (1 - rest / counts)
        weights -= weights.max()
    return amounts, bound


def best_fit(left: Counter, capacity: int) -> Plan:
    """Longest first, each into the fullest sequence with room for it; equal
    sequences are handled together."""
    open_: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []

    def put(content: tuple[int, ...], room: int, n: int) -> None:
        if not open_[room]:
            insort(rooms, room)
        open_[room][content] += n

    for length in sorted(left, reverse=True):
        k = left[length]
        while k:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if k >= each:
                    put((length,) * each, capacity - each * length, k // each)
                if k % each:
                    put((length,) * (k % each), capacity - k % each * length, 1)
                break
            room = rooms[at]
            content, n = open_[room].popitem()
            if not open_[room]:
                rooms.pop(at)
            take = min(n, k)
            if n > take:
                put(content, room, n - take)
            put(content + (length,), room - length, take)
            k -= take
    return {content: n for same in open_.values() for content, n in same.items()}


def make_plan(
    histogram: dict[int, int],
    capacity: int = CAPACITY,
    phases: int = PHASES,
    epsilon: float = EPSILON,
    solves: int = SOLVES,
) -> tuple[Plan, float]:
    """Configurations with multiplicities that hold every piece of the
    histogram, and a lower bound on their number."""
    plan: Counter = Counter()
    left = Counter({length: n for length, n in histogram.items() if n})
    full = left.pop(capacity, 0)
    if full:
        plan[(capacity,)] += full
    tokens = sum(length * n for length, n in histogram.items())
    bound, runs = float(-(-tokens // capacity)), 0
    best: Plan | None = None
    for k in range(solves):
        if not left:
            break
        lengths = np.array(sorted(left), np.int64)
        counts = np.array([left[x] for x in lengths.tolist()], np.int64)
        amounts, here = solve(lengths, counts, capacity, phases, epsilon)
        if k == 0:
            bound = max(bound, full + here)
        order = sorted(amounts, key=lambda c: (-amounts[c], c))
        before = left.total()
        for whole in (True, False):
            for config in order:
                held = Counter(config)
                n = int(amounts[config]) if whole else 1
                n = min(n, *(left[x] // c for x, c in held.items()))
                if n > 0 and runs + len(held) <= MAX_RUNS:
                    plan[config] += n
                    runs += len(held)
                    left -= Counter({x: c * n for x, c in held.items()})
            # Each step of the rounding, completed by best fit, is a plan.
            found = plan + Counter(best_fit(left, capacity))
            if best is None or found.total() < sum(best.values()):
                best = dict(found)
            if sum(best.values()) <= bound + 1e-6:
                return best, bound
        if left.total() == before:
            break
    return dict(plan) if best is None else best, bound


class Places:
    """Rank among the pieces of one length -> sequence and offset."""

    def __init__(self, plan: Plan):
        seen: Counter = Counter()
        runs, first = [], 0
        for config in sorted(plan, reverse=True):
            n, at = plan[config], 0
            for length, copies in sorted(Counter(config).items(), reverse=True):
                runs.append((length, seen[length], first, copies, at))
                seen[length] += n * copies
                at += length * copies
            first += n
        runs.sort()
        table = np.array(runs, np.int64).reshape(-1, 5)
        self.length, self.start, self.first, self.copies, self.at = table.T.copy()
        self.n_sequences = first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for x in np.unique(length):
            rows = np.flatnonzero(length == x)
            low, high = np.searchsorted(self.length, [x, x + 1])
            run = low + np.searchsorted(self.start[low:high], rank[rows], side="right") - 1
            nth, copy = np.divmod(rank[rows] - self.start[run], self.copies[run])
            sequence[rows] = self.first[run] + nth
            offset[rows] = self.at[run] + copy * x
        return sequence, offset


# The encoder of the last vocabulary file, kept in a worker from task to task
# with its bounded cache: most words of a task are new only to the first.
_kept: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _kept:
        _kept.clear()
        _kept[vocabulary] = Encoder(vocabulary, CACHED_WORDS)
    return _kept[vocabulary]


PIECE = "piece int, start long, length int, ids_crc32 long, task int, nth long"


def cut(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Every document's token pieces: doc_id, piece, start, length, ids_crc32
    [, ids as little-endian 32-bit integers], and the task that made it with
    its number among the task's pieces of that length."""
    shared = broadcast_vocabulary(docs, tokenizer_path)
    end = np.array([END_ID], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        task, made = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for part in sliced(batch, 4 << 20):
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                row, piece, size, crc, nth, kept = [], [], [], [], [], []
                for k, ids in enumerate(encoder.encode(texts)):
                    ids = memoryview(ids + end)
                    for j, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        row.append(k)
                        piece.append(j)
                        size.append(n)
                        crc.append(zlib.crc32(own))
                        nth.append(made[n])
                        made[n] += 1
                        if keep_ids:
                            kept.append(bytes(own))
                pieces = np.array(piece, np.int64)
                columns = {
                    "doc_id": part.column(0).take(pa.array(row, pa.int64())),
                    "piece": pa.array(pieces, pa.int32()),
                    "start": pa.array(pieces * capacity),
                    "length": pa.array(size, pa.int32()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "task": pa.array([task] * len(row), pa.int32()),
                    "nth": pa.array(nth, pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind.simpleString()}, {PIECE}" + (", ids binary" if keep_ids else "")
    return map_in_arrow(docs.select("doc_id", "text"), run, schema)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """``cut``'s pieces with their sequence_id and offset."""
    pieces = stored(cut(docs, tokenizer_path, capacity, keep_ids), "packing-pieces")
    # One row for each task and length; the window's partitions are as long as
    # there are tasks.
    made = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    made = stored(
        made.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-offsets"
    )
    # At most ``capacity`` rows.
    histogram = {r[0]: r[1] for r in made.groupBy("length").agg(F.sum("n")).collect()}
    places = Places(make_plan(histogram, capacity)[0])
    plan = docs.sparkSession.sparkContext.broadcast(places)
    ranked = pieces.join(made.drop("n"), ["length", "task"]).select(
        *[c for c in pieces.columns if c not in ("task", "nth")],
        (F.col("before") + F.col("nth")).alias("rank"),
    )
    names = [c for c in ranked.columns if c != "rank"]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = dict(zip(ranked_names, batch.columns))
        sequence, offset = plan.value.find(
            columns["length"].to_numpy().astype(np.int64), columns.pop("rank").to_numpy()
        )
        return pa.RecordBatch.from_pydict(columns | {"sequence_id": sequence, "offset": offset})

    ranked_names = ranked.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in names)
    return arrow_pass(ranked, rows, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids of each whole sequence, from pieces with ids
    (at most ``capacity`` pieces each)."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").cast("int").alias("length"), joined.alias("ids")
    )
