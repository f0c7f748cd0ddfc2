"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder of our own only where that is unset, as in tests."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        here = at.get() if at.isDefined() else None
    if not here:
        here = "/tmp/checkpoints/vertexloom"
        spark.sparkContext.setCheckpointDir(here)
    return here


def file_system(spark: SparkSession, path: str) -> tuple:
    """Spark's own file system of a path or URI, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Spark setting under which a query's shuffle files go when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files behind: what they wrote is read from its table, never from their shuffles."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


_OPEN: ContextVar[list[list[Staged]]] = ContextVar("open scopes", default=[])


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """All tables staged inside go when the block ends, also by an error: write or collect results inside.

    Without such a block, tables that a result may still be read from stay until the shared folder is cleared.
    """
    mine: list[Staged] = []
    token = _OPEN.set([*_OPEN.get(), mine])
    try:
        yield
    finally:
        _OPEN.reset(token)
        for table in mine:
            table.drop()


class Staged:
    """A frame written to the shared folder and read again: a retried or lost task finds it there."""

    def __init__(self, df: DataFrame, name: str, by: str | None = None, **measures: Column):
        """by: a column with few values, each of which can be read alone. measures: aggregates over the rows, taken while they are written and kept in `seen`."""
        self.spark = df.sparkSession
        self.path = self.folder(self.spark, name)
        self._own()
        watch = Observation() if measures else None
        rows = df.observe(watch, *[c.alias(k) for k, c in measures.items()]) if watch else df
        with freed_shuffles(self.spark):
            self._write(rows, by)
        self.seen: dict = watch.get if watch else {}
        self.df = self._read(df)

    def _own(self) -> None:
        for scope in _OPEN.get()[-1:]:
            scope.append(self)

    def _write(self, rows: DataFrame, by: str | None) -> None:
        rows.write.option("compression", "zstd").parquet(self.path, partitionBy=by)

    def _read(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.path)

    @staticmethod
    def folder(spark: SparkSession, name: str) -> str:
        """A new place in the shared folder, as a URI or path."""
        return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    @classmethod
    def found(cls, spark: SparkSession, path: str, schema: StructType) -> Staged:
        """A table that an earlier run has left."""
        self = Staged.__new__(Staged)
        self.spark, self.path, self.seen = spark, path, {}
        self._own()
        self.df = spark.read.schema(schema).parquet(path)
        return self

    @property
    def bytes(self) -> int:
        """Bytes of the files."""
        system, at = file_system(self.spark, self.path)
        return system.getContentSummary(at).getLength()

    def drop(self) -> None:
        """Deletes the files, if they are still there; nothing lazy may still read them."""
        system, at = file_system(self.spark, self.path)
        system.delete(at, True)


#: Bytes that a row group of a table of wide rows has, about.
WIDE_GROUP = 8 << 20


class Wide(Staged):
    """A frame whose rows may have some MB each. A row group is what a reader unpacks at once and what a writer holds, and
    Parquet looks at its size after 100 rows only; here it does so after each row, so that a task holds a few rows, however many its file has."""

    def _write(self, rows: DataFrame, by: str | None) -> None:
        out = rows.write.option("compression", "zstd").option("parquet.page.size.row.check.min", 1).option("parquet.block.size", WIDE_GROUP)
        out.parquet(self.path, partitionBy=by)


class Bucketed(Staged):
    """A frame stored in hash buckets of some columns: joins and aggregations by them read it as it lies, without an exchange."""

    def __init__(self, df: DataFrame, name: str, keys: list[str], buckets: int, file_rows: int = 0, by: str | None = None, dealt: bool = False, **measures: Column):
        """dealt: the rows lie in these buckets already, so they are not moved."""
        self.keys, self.buckets, self.file_rows, self.dealt = keys, buckets, file_rows, dealt
        super().__init__(df, name, by, **measures)

    @property
    def table(self) -> str:
        return "staged_" + self.path.rsplit("-", 1)[-1]

    def _write(self, rows: DataFrame, by: str | None) -> None:
        placed = rows if self.dealt else rows.repartition(self.buckets, *self.keys).sortWithinPartitions(*[by] * bool(by), *self.keys)
        out = (placed.write.partitionBy(by) if by else placed.write).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("compression", "zstd").option("maxRecordsPerFile", self.file_rows)
        out.option("path", self.path).saveAsTable(self.table)

    def _read(self, df: DataFrame) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
        super().drop()
