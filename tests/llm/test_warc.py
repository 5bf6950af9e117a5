from __future__ import annotations

import base64
import hashlib
import os

import pytest

from hydrostar.llm import warc

KIND = "page_id long, url string, html string, digest string, payload string, value string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def run(spark, tmp_dir, rows, min_bytes=0):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KIND)
    path = os.path.join(tmp_dir, "archives")
    warc.write_archives(df, path, min_bytes=min_bytes)
    parsed = warc.read_archives(spark, path).cache()
    out = [tuple(r) for r in warc.resolved(parsed).collect()]
    return sorted(out, key=str), parsed


def brute(rows, min_bytes=0):
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[b32(h)] = max(i, largest.get(b32(h), i))
    out = []
    for i, _, h in rows:
        n, d = len((h or "").encode()), b32(h)
        own = n < min_bytes or i == largest.get(d)
        out.append((i, n, d, "response" if own else "revisit", None if own else largest[d]))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "<html>é WARC/1.1\r\nContent-Length: 5\r\n\r\n</html>"),
    (2, "http://b/\r\nX: y", "same\r\n\r\n"),
    (3, None, "same\r\n\r\n"),
    (4, "http://c/", None),
    (5, "http://d/", ""),
    (6, "http://e/", "long " * 400_000),
    (7, "http://f/", "same\r\n\r\n"),
    (7, "http://f/", "same\r\n\r\n"),
    (None, "http://g/", "same\r\n\r\n"),
    (None, "http://h/", "without id"),
]


def test_round_trip(spark, tmp_dir):
    got, parsed = run(spark, tmp_dir, ROWS)
    assert got == brute(ROWS)
    urls = {r["page_id"]: r["url"] for r in parsed.collect()}
    assert urls[1] == "http://a/" and urls[2] == "http://b/%0D%0AX: y" and urls[3] == ""


def test_small_payloads_stay_responses(spark, tmp_dir):
    got, _ = run(spark, tmp_dir, ROWS, min_bytes=9)
    assert got == brute(ROWS, 9)


def test_empty_table(spark, tmp_dir):
    assert run(spark, tmp_dir, [])[0] == []


def test_many_copies(spark, tmp_dir):
    rows = [(k, f"http://{k}/", "copy" if k % 3 else f"own {k}") for k in range(600)]
    assert run(spark, tmp_dir, rows)[0] == brute(rows)


def test_archives_hold_a_bounded_number_of_records(spark, tmp_dir):
    rows = [(k, f"http://{k}/", f"page {k}", "x", "y", "z") for k in range(50)]
    df = spark.createDataFrame(rows, KIND).coalesce(1)
    path = os.path.join(tmp_dir, "bounded")
    warc.write_archives(df, path, file_records=7)
    sizes = []
    for name in os.listdir(path):
        if name.endswith(".gz"):
            with open(os.path.join(path, name), "rb") as f:
                sizes.append(sum(1 for _ in warc.records(f.read())))
    assert sum(sizes) == 50 and max(sizes) <= 7
    assert warc.read_archives(spark, path).count() == 50


def test_damaged_archives_fail():
    with pytest.raises(ValueError, match="not a record"):
        list(warc.records(b"HTTP/1.1 200\r\n\r\n"))
    head = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(head))


def test_gzip_members_one_after_another():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    found = list(warc.records(gzip.compress(record) + gzip.compress(record * 2)))
    assert [b for _, b in found] == [b"abc"] * 3
