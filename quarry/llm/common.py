"""What the operators share: reading tables, the folder all executors share, staged tables."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one, but only in local mode: on a cluster other
    machines would not see it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet and reads it again. Its shuffle files go as soon as it is written, not when the driver happens to collect
    its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """df, written in the shared folder: lineage ends there, and lost executors lose nothing."""
    path = new_path(df.sparkSession, tag)
    if (folders := _SCRATCH.get()) is not None:
        folders.append(path)
    return written(df, path, compression)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What stage() writes inside goes at the end, so nothing that is read later may depend on it."""
    folders: list[str] = []
    token = _SCRATCH.set(folders)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in folders:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_blobs(df: DataFrame, path: str, end: str, folder: str | None = None) -> None:
    """Each row of the binary column `blob` becomes one file, followed by the bytes of `end`, below a folder for each value of the
    column `folder`.

    The text writer copies a string's bytes unchanged, so this works on any file system that Spark can write."""
    own = [folder] if folder else []
    df.selectExpr(*own, "cast(blob as string) as value").write.partitionBy(*own).option("lineSep", end).option("maxRecordsPerFile", 1).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def short_batches(spark: SparkSession) -> None:
    """Batches of whole texts between the JVM and Python are of 1000 rows from here on: of Spark's 10,000 rows each worker holds a batch
    several times over, and so does the JVM, outside its heap. Results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def only(docs: DataFrame, test: Callable[[list[str | None]], np.ndarray], column: str = "text") -> DataFrame:
    """The rows whose text passes the test, which gets the texts of a batch; all columns go through as they are."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                yield part.filter(pa.array(test(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def partition_id() -> int:
    c = TaskContext.get()
    return c.partitionId() if c else 0
