"""What the operators of this subpackage share: the cluster's shared folder, and tables written to it."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the context was given by setCheckpointDir; one of our own only on
    a local master, where all executors are this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'geoframe-shared')}"
    return path.rstrip("/")


#: Tables of this process that later plans may still read: they go when it ends.
_kept: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_at"] = path
    return out


def delete_written(*frames: DataFrame) -> None:
    """Remove tables made by written() that no later plan reads."""
    for df in frames:
        _delete(df.sparkSession, df.__dict__["written_at"])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _kept.pop(path, None)


@atexit.register
def delete_all_written() -> None:
    """Remove what written() made and nobody has removed: when the process ends, or before, once all results are taken."""
    for path, spark in list(_kept.items()):
        if spark.sparkContext._jsc is None:  # the context is stopped: its tables are the cluster's to clean
            _kept.pop(path)
            continue
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of a batch of whole texts on its way to Python. Spark's default of 10,000 is made for short rows.
TEXT_BATCH = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """df under a session of its own whose Arrow batches hold at most TEXT_BATCH rows; the caller's session keeps its settings."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if 0 < int(spark.conf.get(name)) <= TEXT_BATCH:
        return df
    session = spark._jsparkSession.cloneSession()
    session.conf().set(name, str(TEXT_BATCH))
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, df._jdf.queryExecution().analyzed())
    return DataFrame(rows, SparkSession(spark.sparkContext, session))


def sliced(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows; when all are through, memory that is free goes back to the system, as workers live on."""
    pa.set_memory_pool(pa.system_memory_pool())  # what it frees, release() can give back
    try:
        for b in batches:
            for s in range(0, b.num_rows, rows):
                yield b.slice(s, rows)
    finally:
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it keeps
