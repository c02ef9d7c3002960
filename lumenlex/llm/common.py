"""What the operators of this subpackage share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch that goes to Python; long texts make a batch of thousands too large.
ARROW_ROWS = 1000


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go when the query that wrote them ends, not when the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each call of ``alone`` that runs, the paths that were written inside it.
_passing: list[list[str]] = []


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """``value`` holds for what runs inside; the session's own value returns."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Batches of ``rows`` rows for what runs inside; the session's own value returns."""
    return setting(spark, BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a local session gets a folder
    of its own; on a cluster there is no folder to guess, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lumenlex-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; everything of one application lies below one folder."""
    return f"{shared_dir(spark)}/lumenlex-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    if _passing:
        _passing[-1].append(path)
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()``, written; all tables that were written to make it are removed."""
    _passing.append([])
    paths = _passing[-1]
    try:
        try:
            made = make()
        finally:
            _passing.pop()
        return written(made, name)
    finally:
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written under the shared folder. Frames that read it end with it."""
    remove(spark, f"{shared_dir(spark)}/lumenlex-{spark.sparkContext.applicationId}")


def trim() -> None:
    """Give memory that this process has freed back to the system. The C library keeps it otherwise; others than glibc
    have no such call, then nothing happens."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """mapInArrow over batches of at most ``rows`` rows; ``function`` takes one batch and returns one.

    The session's rows per batch are set to as many, which keeps long texts from filling a worker; another value that is
    in force when the plan runs changes nothing but memory, as batches are cut here as well. What a worker's memory pool holds unused is given back at the end of each task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = function(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
            del batch
        pa.default_memory_pool().release_unused()

    df.sparkSession.conf.set(BATCH, str(rows))
    return df.mapInArrow(each, schema)
