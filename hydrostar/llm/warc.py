"""Operator 10, WARC: archives with payload revisits, written and read back.

Writing shuffles headers (id, digest, length) by payload digest, elects the
response of each digest, and joins the decision to the pages by id; only
responses carry their payload, revisits get a fresh header that points to
their response.  Reading parses the files by Content-Length, checks every
payload against its digest, and joins revisits to their responses by record id.

The archives are text files of whole records written by Spark (gzip), so any
folder that Spark can write will do, and a lost executor's files are redone.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostar.llm.common import map_in_arrow, stored

CRLF = "\r\n"
# Digits of conv() in base 32, and of RFC 4648 base 32.
CONV32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 8 groups of 20 bits, 4 digits each."""
    digest = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(F.concat(*groups), CONV32, RFC32)


def headers(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """id, payload_bytes and payload_digest of every row."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Distinct (page_id, digest) with record_type and refers_to.

    The largest page_id of a digest is the response (every row of that id, if
    it repeats); payloads under ``min_bytes`` are all responses.  A null
    page_id counts as the smallest.  The election is an aggregate with one row
    per digest and task, so copies of one payload cannot crowd a task.
    """
    distinct = heads.groupBy("page_id", "payload_digest").agg(
        F.max("payload_bytes").alias("payload_bytes")
    )
    # Only digests that several rows have; stored, so that both sides of the
    # join are plain shuffles and AQE can split a very common payload.
    shared = (
        heads.groupBy("payload_digest")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", "response_id", F.lit(True).alias("shared"))
    )
    joined = distinct.join(stored(shared, "warc-shared"), "payload_digest", "left")
    own = (
        F.col("shared").isNull()
        | F.col("page_id").eqNullSafe(F.col("response_id"))
        | (F.col("payload_bytes") < min_bytes)
    )
    return joined.select(
        "page_id",
        "payload_digest",
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        F.when(~own, F.col("response_id")).alias("refers_to"),
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    file_records: int = 10_000,
) -> None:
    """Write one record per row of ``pages`` under ``path``, at most
    ``file_records`` in one archive (a reader takes an archive as one value).

    A null payload is empty, a null URL gives an empty target.  Control
    characters in a URL are percent-encoded so that a header stays one line.
    """
    plain = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    )
    decided = resolve(headers(plain, "page_id", "payload"), min_bytes)
    digest = base32_sha1(F.col("payload").cast("binary"))
    p = plain.withColumn("digest", digest).alias("p")
    d = decided.alias("d")
    rows = p.join(
        d,
        F.col("p.page_id").eqNullSafe(F.col("d.page_id"))
        & (F.col("p.digest") == F.col("d.payload_digest")),
    )
    is_response = F.col("d.record_type") == "response"
    head = F.concat(
        F.lit(HTTP_HEAD), F.octet_length(F.col("p.payload")).cast("string"), F.lit(CRLF + CRLF)
    )
    block = F.when(is_response, F.concat(head, F.col("p.payload"))).otherwise(head)
    url = F.coalesce(F.col("p.url"), F.lit(""))
    for code in range(32):
        if code in (9, 10, 13):
            url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("d.record_type")),
        line("WARC-Record-ID", _record_id(F.col("p.page_id"), F.col("p.digest"))),
        line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("p.digest"))),
        line("X-Page-Id", F.coalesce(F.col("p.page_id").cast("string"), F.lit(""))),
        F.when(is_response, F.lit("")).otherwise(
            F.concat(
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                line("WARC-Refers-To", _record_id(F.col("d.refers_to"), F.col("p.digest"))),
            )
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        # The writer's line separator gives the record's last line feed.
        F.lit(CRLF + "\r"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", file_records).text(path)


def _bytes_of(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed content, member after member, in bounded pieces."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view = memoryview(content)
    at, total = 0, len(view)
    gz = zlib.decompressobj(31)
    while at < total or gz.unconsumed_tail:
        piece = gz.unconsumed_tail or view[at : at + step]
        if not gz.unconsumed_tail:
            at += len(piece)
        yield gz.decompress(piece, 4 * step)
        if gz.eof:
            rest = gz.unused_data
            at -= len(rest)
            gz = zlib.decompressobj(31)
    yield gz.flush()


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, by Content-Length."""
    buffer, pieces = bytearray(), _bytes_of(content)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            more = next(pieces, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        end, need = -1, 1 << 12
        while end < 0:
            whole = fill(need)
            end = buffer.find(b"\r\n\r\n")
            if end < 0 and not whole:
                if bytes(buffer).strip():
                    raise ValueError("archive ends inside a record header")
                return
            need *= 2
        lines = bytes(buffer[:end]).decode("utf-8").split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        length = int(fields["content-length"])
        if not fill(end + 4 + length + 4):
            raise ValueError("archive ends inside a record")
        yield fields, bytes(buffer[end + 4 : end + 4 + length])
        del buffer[: end + 4 + length + 4]


def _parsed(content: bytes) -> Iterator[tuple]:
    for fields, block in records(content):
        head, _, payload = block.partition(b"\r\n\r\n")
        kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != said:
                raise ValueError(f"payload differs from its digest in {fields['warc-record-id']}")
        size = len(payload) if kind == "response" else None
        page = fields.get("x-page-id") or None
        yield (
            fields["warc-record-id"],
            None if page is None else int(page),
            fields.get("warc-target-uri", ""),
            kind,
            said,
            size,
            fields.get("warc-refers-to"),
        )


_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, "
    "payload_digest string, payload_bytes long, refers_record string"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: headers, and the length of a response's payload."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in _SCHEMA.split(", "))]
        )
        for batch in batches:
            for value in batch.column(0):
                rows: list[tuple] = []
                for row in _parsed(value.as_buffer().to_pybytes()):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                        )
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                    )

    return map_in_arrow(files, run, _SCHEMA)


def resolved(rows: DataFrame) -> DataFrame:
    """Revisits joined to the response they refer to, for its id and length.

    A revisit whose response is missing or has another digest raises.  The
    response side has one row for each record that is referred to (a repeated
    page repeats its record, hence the aggregate), stored; a response that a
    third of all rows refer to skews only the other side, which AQE splits.
    """
    target = (
        rows.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_record"))
        .agg(
            F.max("page_id").alias("response_id"),
            F.max("payload_bytes").alias("response_bytes"),
            F.max("payload_digest").alias("response_digest"),
        )
    )
    revisits = rows.where("record_type = 'revisit'")
    asked = revisits.select("refers_record").distinct()
    target = stored(target.join(asked, "refers_record", "left_semi"), "warc-targets")
    revisits = revisits.join(target, "refers_record", "left")
    good = F.coalesce(F.col("response_digest") == F.col("payload_digest"), F.lit(False))
    revisits = revisits.select(
        "page_id",
        F.when(good, F.col("response_bytes"))
        .otherwise(F.raise_error(F.concat(F.lit("unresolved revisit "), "record_id")).cast("long"))
        .alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("response_id").alias("refers_to"),
    )
    responses = rows.where("record_type = 'response'").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    return responses.unionByName(revisits)
