"""Helpers shared by the operators: words, shared tables, Arrow passes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydrostar.session import checkpoint_dir

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WORKER_MEMORY = {
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(8 << 20),
    "MALLOC_ARENA_MAX": "2",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}
ARROW_BYTES, ARROW_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

# The characters that separate words, and ASCII lower-casing.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# bytes.split() without arguments splits at exactly SPACES.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(col, UPPER, LOWER)


def fold(col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id is read as '')."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/hydrostar-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, keeps columns prunable."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(value: str | None) -> bytes:
    """UTF-8 bytes of a text; null reads as the empty text."""
    return b"" if value is None else value.encode("utf-8")


def arrow_pass(
    df: DataFrame,
    rows: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str | StructType,
    setup: Callable[[], object] | None = None,
    slice_bytes: int = 16 << 20,
) -> DataFrame:
    """``mapInArrow`` over slices of bounded size.

    ``rows`` gets one record batch (and, with ``setup``, what ``setup`` made
    once per task) and returns one.  Batches over ``slice_bytes`` are cut so
    that a worker's memory does not depend on the batch setting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in sliced(batch, slice_bytes):
                out = rows(part, state) if setup else rows(part)
                if out is not None and out.num_rows:
                    yield out

    return map_in_arrow(df, run, schema)


def import_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (a
    cluster without that path ships it with ``--py-files``), and bound the
    bytes of the batches they get."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, known)])
    # Workers give large arrays back to the system when they are freed, so that
    # one operator's peak does not stay with the next one's.
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)
    # Texts are long: the default of 10,000 rows a batch alone would let a
    # batch, its copy in the worker and its reply grow to hundreds of MB.
    # A value that the session has set itself stays.
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(ARROW_BATCH_BYTES))


def map_in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with workers that can import this package."""
    import_on_workers(df.sparkSession)
    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of about ``slice_bytes`` on average."""
    if not batch.num_rows:
        return
    n = max(1, -(-batch.nbytes // slice_bytes))
    step = max(1, -(-batch.num_rows // n))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def with_field(rows: pa.Array, at: int, new: pa.Array) -> pa.StructArray:
    """A struct column with its field number ``at`` replaced."""
    fields = [rows.type.field(k) for k in range(rows.type.num_fields)]
    arrays = [new if k == at else pc.struct_field(rows, k) for k in range(len(fields))]
    return pa.StructArray.from_arrays(arrays, fields=fields)
