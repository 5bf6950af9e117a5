"""Best-fit packing: the plan against bounds and exact packings, the pieces
against the library's ids, and the places against a gapless layout."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from hydrostar.llm import packing
from hydrostar.llm.queries import tokenizer_path
from tests.llm import frames


def holds(plan: dict, histogram: dict, capacity: int) -> None:
    seen = Counter()
    for config, n in plan.items():
        assert n > 0 and 0 < sum(config) <= capacity
        for x in config:
            seen[x] += n
    assert seen == Counter({x: n for x, n in histogram.items() if n})


def fewest(items: tuple[int, ...], capacity: int) -> int:
    """The exact optimum of a handful of items, by search."""
    best = len(items)

    def place(k: int, rooms: tuple[int, ...]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for at in range(len(rooms)):
            if rooms[at] >= items[k] and rooms[at] not in rooms[:at]:
                place(k + 1, rooms[:at] + (rooms[at] - items[k],) + rooms[at + 1 :])
        place(k + 1, rooms + (capacity - items[k],))

    place(0, ())
    return best


@pytest.mark.parametrize("seed", range(12))
def test_plans_of_few_items_against_the_optimum(seed):
    rnd = random.Random(seed)
    items = sorted((rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 11))), reverse=True)
    plan, bound = packing.make_plan(Counter(items), 20)
    holds(plan, Counter(items), 20)
    best = fewest(tuple(items), 20)
    assert bound <= best + 1e-6 and sum(plan.values()) <= best + 1


def test_bound_and_plan_where_lengths_do_not_fit_together():
    rnd = np.random.RandomState(3)
    histogram = Counter(rnd.randint(500, 900, 6000).tolist())
    plan, bound = packing.make_plan(histogram)
    holds(plan, histogram, 2048)
    n, plain = sum(plan.values()), sum(packing.best_fit(histogram, 2048).values())
    assert bound <= n < plain


def test_multiplicities_grow_but_the_plan_does_not():
    small = {1025: 1000, 683: 5000, 342: 2000, 100: 10, 2048: 7}
    large = {x: n * 100_000 for x, n in small.items()}
    (one, _), (many, bound) = packing.make_plan(small), packing.make_plan(large)
    holds(many, large, 2048)
    assert len(many) < 10 * len(one) + 20
    assert sum(many.values()) <= bound * 1.001 + 2


def test_no_pieces_and_one_length():
    assert packing.make_plan({}) == ({}, 0.0)
    plan, _ = packing.make_plan({1: 5000})
    assert sum(plan.values()) == 3


def test_knapsack_is_optimal():
    rnd = random.Random(1)
    lengths = np.array(sorted(rnd.sample(range(2, 30), 6)), np.int64)
    prices = np.array([rnd.random() for _ in lengths])
    best, choice = packing.knapsack(lengths, prices, 40)
    plain = [0.0] * 41
    for room in range(1, 41):
        plain[room] = max([plain[room - 1]] + [plain[room - x] + p for x, p in zip(lengths, prices) if x <= room])
    assert np.allclose(best, plain)
    for filling, x in zip(packing._fillings(lengths, choice, 40), lengths):
        total = sum(lengths[k] * c for k, c in filling.items())
        assert total <= 40 and np.isclose(
            sum(prices[k] * c for k, c in filling.items()), prices[lengths == x][0] + plain[40 - x]
        )


def library_pieces(rows: list[tuple], capacity: int) -> Counter:
    library = Tokenizer.from_file(tokenizer_path())
    library.no_padding()
    library.no_truncation()
    out = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at : at + capacity], "<u4").tobytes()
            out[doc_id, k, at, len(own) // 4, zlib.crc32(own)] += 1
    return out


def check(spark, rows, capacity, parts=1):
    docs = frames.documents(spark, rows).repartition(parts)
    packed = packing.pack(docs, tokenizer_path(), capacity, keep_ids=True)
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == library_pieces(
        rows, capacity
    )
    layout = defaultdict(list)
    for r in got:
        layout[r.sequence_id].append((r.offset, r.length, r.ids))
    whole = {}
    for k, inside in layout.items():
        at = 0
        for offset, length, _ in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
        whole[k] = b"".join(ids for _, _, ids in sorted(inside))
    assert {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()} == whole
    tokens = sum(r.length for r in got)
    assert -(-tokens // capacity) <= len(layout)
    return len(layout), tokens


def test_awkward_rows(spark):
    check(spark, frames.awkward_rows(), 2048)
    check(spark, frames.awkward_rows(), 16, parts=5)


def test_rows_over_many_tasks_pack_tightly(spark):
    rnd = random.Random(7)
    rows = [(k, frames.prose(k, rnd.randrange(1, 60))) for k in range(300)]
    rows += [(1000, "same text")] * 150
    n, tokens = check(spark, rows, 128, parts=7)
    assert n <= -(-tokens // 128) + 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, tokenizer_path()).collect() == []
