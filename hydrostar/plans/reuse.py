"""Result reuse across pages and sessions (the dashboard caches each query's
result).

A :class:`ResultStore` materialises a base result once and hands the same
DataFrame to every consumer.  Materialisation is a reliable checkpoint into
the shared folder named by ``spark.checkpoint.dir`` (never a local
checkpoint): the stored result survives the loss of an executor and cuts the
lineage, so derived results never re-run the star joins.  Base results are
aggregates (tens to thousands of rows), so storing them is cheap.

:class:`SharedResults` keeps results in a folder across sessions.  A result's
key holds the query, its parameters and a fingerprint of the input's file
listing, so a changed, added or removed file leads to another key.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydrostar.operators.rollup import GRAIN, fact_rollup
from hydrostar.session import checkpoint_dir
from hydrostar.sources.tables import Tables

# Part of every kept result's key; raised when a query's meaning changes.
RESULTS_VERSION = 1
GRAIN_KEY = "grain:" + ",".join(GRAIN)


class ResultStore:
    """Per-session store of materialised results.

    A key names the query and its parameters; ``owner`` is the table bundle
    that the result was computed from.  The store holds the bundle itself, so
    its identity cannot pass to another bundle while a result is stored.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = checkpoint_dir(spark)
        self._results: dict[tuple[int, str], tuple[object, DataFrame]] = {}
        self._lock = threading.Lock()

    def get(self, key: str, build: Callable[[], DataFrame], owner: object = None) -> DataFrame:
        """The stored result for ``key`` of ``owner``, built and checkpointed
        on first use."""
        full = (id(owner), key)
        with self._lock:
            hit = self._results.get(full)
        if hit is not None:
            return hit[1]
        stored = self._materialised(key, build)
        with self._lock:
            return self._results.setdefault(full, (owner, stored))[1]

    def _materialised(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        return build().checkpoint(eager=True)

    def with_grain(self, tables: Tables, build: bool) -> Tables:
        """The bundle on one stored fine grain of the fact, from which every
        coarser grain is derived; without ``build`` only if it is stored."""
        if tables.grain is not None:
            return tables
        with self._lock:
            known = (id(tables), GRAIN_KEY) in self._results
        if not (build or known):
            return tables
        grain = self.get(GRAIN_KEY, lambda: fact_rollup(tables.measurement, GRAIN), owner=tables)
        return tables.having(grain=grain)

    def clear(self) -> None:
        """Forget every stored result (the next ``get`` rebuilds it)."""
        with self._lock:
            self._results.clear()

    def __contains__(self, key: str) -> bool:
        return any(k == key for _, k in self._results)


def listing(spark: SparkSession, paths: Sequence[str]) -> str:
    """A fingerprint of the files below ``paths``: names, sizes and times of
    change.  The listing is aggregated in tasks; no file is opened."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(list(paths))
        .select(F.xxhash64("path", "modificationTime", "length").alias("h"), "length")
    )
    figures = files.agg(
        F.count("*"), F.sum("length"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(20,0)"))
    ).first()
    return hashlib.sha256(str(tuple(figures)).encode()).hexdigest()


class SharedResults(ResultStore):
    """Results kept below ``folder`` for later sessions.

    ``sources`` are the input paths whose files the results depend on; they
    are listed when the store is opened.  A result is written to a folder of
    its own, and a line in its ``done`` file names that folder only when it is
    complete, so a writer that died leaves nothing that is read, and two
    writers at once leave two equal results.  Rows keep their order.
    """

    def __init__(self, spark: SparkSession, folder: str, sources: Sequence[str]):
        super().__init__(spark)
        self.kept = folder
        self.version = f"{RESULTS_VERSION}:{listing(spark, sources)}"

    def _materialised(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        name = hashlib.sha256(f"{self.version}:{key}".encode()).hexdigest()
        path = f"{self.kept}/{name}"
        found = self._finished(path)
        if found is None:
            own = uuid.uuid4().hex
            result = build()
            schema = result.schema
            numbered = result.withColumn("_at", F.monotonically_increasing_id())
            numbered.write.parquet(f"{path}/{own}")
            line = json.dumps({"folder": own, "key": key, "schema": schema.jsonValue()})
            done = self.spark.createDataFrame([(line,)], "value string").coalesce(1)
            done.write.mode("append").text(f"{path}/done")
            found = {"folder": own, "schema": schema.jsonValue()}
        schema = StructType.fromJson(found["schema"])
        rows = self.spark.read.schema(StructType([*schema.fields]).add("_at", "long"))
        return rows.parquet(f"{path}/{found['folder']}").orderBy("_at").drop("_at")

    def _finished(self, path: str) -> dict | None:
        try:
            # One line a finished writer of this result.
            line = self.spark.read.text(f"{path}/done").agg(F.min("value")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return json.loads(line) if line else None
