from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from hydrostar.llm import graph, simhash
from tests.llm.frames import awkward_rows, documents, prose


def slow_fingerprint(text, shingle=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not ws:
        return 0
    parts = [" ".join(ws[k : k + shingle]) for k in range(max(len(ws) - shingle + 1, 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def smallest(ids, fps, distance=4):
    """Smallest reachable id of every row, all pairs compared."""
    fps = np.array(fps, np.uint64)
    label = list(range(len(ids)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= distance):
            a, b = find(k), find(int(j))
            label[max(a, b)] = min(a, b)
    best: dict = {}
    for k, i in enumerate(ids):
        known = [x for x in (best.get(find(k)), i) if x is not None]
        best[find(k)] = min(known) if known else None
    return [best[find(k)] for k in range(len(ids))]


def test_documents(spark):
    rnd = random.Random(2)
    rows = awkward_rows()
    for k in range(40):
        ws = prose(k, rnd.randrange(5, 300), 5000).split()
        rows.append((100 + k, " ".join(ws)))
        for j in range(rnd.randrange(3)):
            ws[rnd.randrange(len(ws))] = f"edit{j}"
            rows.append((rnd.randrange(100, 300), " ".join(ws).upper()))
    out = simhash.near_duplicates(documents(spark, rows).repartition(3)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, smallest([i for i, _ in rows], fps)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in out), key=str)
    assert got == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def clusters(seed):
    """Dense clusters, chains of small steps, and lone fingerprints."""
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            out.add(centre ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))))
        for _ in range(15):
            centre ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(3, 6), replace=False))
            out.add(centre)
    out |= {int(x) for x in rng.integers(0, 1 << 63, 100)}
    return sorted(out)


@pytest.mark.parametrize("bucket", [4096, 8])
@pytest.mark.parametrize("count", [0, 10**9])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, bucket, count):
    """For small and large buckets, and for few and many blocks."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    fps = clusters(bucket)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = simhash.links(df, 4, count)
    roots = {r["node"]: r["root"] for r in graph.components(links).collect()}
    got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    want = smallest([simhash._signed(f) for f in fps], fps)
    assert got == want
    assert links.count() < 60 * len(fps)


def test_choices_of_blocks_cover_every_pair():
    for count in (0, 10**6, 10**9, 10**12):
        masks = simhash.block_masks(4, count)
        assert len(set(masks)) == len(masks)
        rnd = random.Random(count)
        for _ in range(200):
            changed = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not changed & m for m in masks)


def test_large_buckets_split_before_they_are_paired(spark, monkeypatch):
    """Equal outer blocks, spread inner bits: rows grow with the bucket, not
    with its square."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 64)
    rng = np.random.default_rng(3)
    outer = sum(simhash.block_masks(4, 0)[:1])
    fps = sorted({int(x) & ~outer & (1 << 63) - 1 for x in rng.integers(0, 1 << 63, 3000)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    assert simhash.buckets(df, 4, 0).count() <= 32 * len(fps)
    for mask in simhash.block_masks(4, 0):
        inner = simhash.inner_masks(mask, 4)
        assert len(inner) == 5 and all(m & mask == mask for m in inner)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(50):
            changed = sum(1 << int(b) for b in rng.choice(free, 4, replace=False))
            assert any(not changed & m for m in inner)


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert got == {**{k: 0 for k in range(1, 300)}, 1001: 1000}
    assert graph.components(df.where("false")).count() == 0


def test_keep_first(spark):
    text = prose(1, 200, 5000)
    rows = [(5, text), (3, text.upper()), (3, text.upper()), (None, text), (9, "other words here now"),
            (None, ""), (None, None), (3, prose(2, 200, 5000))]
    kept = simhash.keep_first(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    blank = [r for r in got if r[0] is None]
    assert len(blank) == 1 and blank[0][1] in ("", None)
    assert [r for r in got if r[0] is not None] == sorted(
        [(3, text.upper()), (9, "other words here now"), (3, rows[-1][1])], key=str
    )
