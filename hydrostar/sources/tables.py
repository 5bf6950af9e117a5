"""The table bundle every query takes, and the native Parquet loader."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrostar.operators.rollup import GRAIN, fact_rollup, regroup
from hydrostar.sources.keys import NOTHING, Keys
from hydrostar.sources.schema import SCHEMAS


Frame = DataFrame | Callable[[], DataFrame]


class Tables:
    """The ten base tables as lazy DataFrames (engine column names).

    A table given as a function is defined when it is first used, so a query
    pays for the tables it reads.  ``keys`` says what has been proven about
    the keys; ``grain`` is a stored fine grain of the fact that the plant
    queries read instead of it, ``enriched`` if it carries the attributes of
    ``sources.gold.enrich_measurements``.
    """

    def __init__(
        self,
        frames: Mapping[str, Frame],
        keys: Keys = NOTHING,
        grain: DataFrame | None = None,
        enriched: bool = False,
    ):
        self._frames = {name: frames[name] for name in SCHEMAS}
        self.keys, self.grain, self.enriched = keys, grain, enriched

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        frame = self._frames[name]
        if not isinstance(frame, DataFrame):
            frame = frame()
        setattr(self, name, frame)
        return frame

    def having(self, **parts) -> Tables:
        """The same tables with other ``keys``, ``grain`` or ``enriched``."""
        kept = {"keys": self.keys, "grain": self.grain, "enriched": self.enriched}
        return Tables({name: partial(getattr, self, name) for name in SCHEMAS}, **(kept | parts))

    def rollup(self, keys: Sequence[str], where: Column | None = None) -> DataFrame:
        """The fact at the grain of ``keys``, from the stored grain if there
        is one that has them."""
        if self.grain is not None and set(keys) <= set(GRAIN):
            return regroup(self.grain, keys, where)
        return fact_rollup(self.measurement, keys, where)

    def register(self, prefix: str = "") -> None:
        """Expose every table as a temp view, e.g. for ``spark.sql``."""
        for name in SCHEMAS:
            getattr(self, name).createOrReplaceTempView(prefix + name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project ``df`` onto the declared schema of table ``name``.

    Columns are cast with ``try_cast`` so that text in a numeric column
    becomes NULL instead of failing the job under ANSI mode (the source
    store of the reference is dynamically typed).
    """
    schema = SCHEMAS[name]
    return df.select(
        *[
            F.col(f.name).try_cast(f.dataType).alias(f.name)
            if df.schema[f.name].dataType != f.dataType
            else F.col(f.name)
            for f in schema.fields
        ]
    )


def load_tables(
    spark: SparkSession, base_dir: str, fmt: str = "parquet", mixed_types: bool = False
) -> Tables:
    """Read ``<base_dir>/<table>.<fmt>`` for each of the ten tables.

    Parquet is read with the declared schema, so narrower integers widen in
    the scan and filters reach it.  Only a column that the files hold as text
    (or as another type that does not widen) is read as such and cast with
    ``try_cast``.  All files of a table must agree on its type, unless
    ``mixed_types`` is set: then files are grouped by type, each group is read
    by its own types and the groups are united (this reads every footer).  CSV
    is read as text and cast the same way.  ``measurement`` is best stored
    partitioned by ``year``: the year filter of the monthly query then prunes
    whole directories.
    """

    def frame(name: str) -> DataFrame:
        path = f"{base_dir}/{name}.{fmt}"
        if fmt == "csv":
            df = spark.read.option("header", True).schema(_as_text(name)).csv(path)
        elif fmt == "parquet" and mixed_types:
            return _mixed(spark, name, path)
        elif fmt == "parquet":
            found = spark.read.parquet(path).schema
            df = spark.read.schema(_widened(name, found)).parquet(path)
        else:
            df = spark.read.format(fmt).load(path)
        return conform(df, name)

    return Tables({name: partial(frame, name) for name in SCHEMAS})


def same_types(spark: SparkSession, path: str) -> list[tuple[list[str], T.StructType]]:
    """The files below ``path`` in groups that agree on every column's type.

    Spark merges the footers of a set of files in tasks and refuses a set that
    disagrees (with a failed job in the log); a refused set is halved, and
    groups of equal schema are put together again.  That takes O(log files)
    rounds for each border between types in the order of names."""
    files = sorted(spark.read.parquet(path).inputFiles())
    base = {"basePath": path, "mergeSchema": True}
    groups: dict[str, tuple[list[str], T.StructType]] = {}
    waiting = [files]
    while waiting:
        some = waiting.pop()
        try:
            found = spark.read.options(**base).parquet(*some).schema
        except (PySparkException, Py4JJavaError) as error:
            if len(some) == 1 or "CANNOT_MERGE_SCHEMAS" not in str(error):
                raise
            half = len(some) // 2
            waiting += [some[half:], some[:half]]
            continue
        kinds = str(sorted((f.name, f.dataType.simpleString()) for f in found.fields))
        groups.setdefault(kinds, ([], found))[0].extend(some)
    return list(groups.values())


def _mixed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table whose files may differ in types: one read a type, united."""
    parts = [
        conform(
            spark.read.option("basePath", path).schema(_widened(name, found)).parquet(*files), name
        )
        for files, found in same_types(spark, path)
    ]
    return reduce(DataFrame.unionByName, parts)


def _widened(name: str, found: T.StructType) -> T.StructType:
    """The declared type of each column, or the file's where it cannot widen
    to the declared one while it is read."""
    files = {f.name: f.dataType for f in found.fields}

    def of(f: T.StructField) -> T.StructField:
        here = files.get(f.name, f.dataType)
        small = isinstance(here, (T.ByteType, T.ShortType, T.IntegerType))
        widens = (isinstance(f.dataType, T.LongType) and small) or (
            isinstance(f.dataType, T.DoubleType) and isinstance(here, T.FloatType)
        )
        return f if widens else T.StructField(f.name, here, True)

    return T.StructType([of(f) for f in SCHEMAS[name].fields])


def tables_from_frames(frames: dict[str, DataFrame]) -> Tables:
    """Bundle already-built DataFrames (tests, other sources)."""
    return Tables({name: conform(frames[name], name) for name in SCHEMAS})


def _as_text(name: str):
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in SCHEMAS[name].fields])
