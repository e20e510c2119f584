"""What the operators share when they run: batches, the shared folder, salted joins and tables that cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; long texts would otherwise fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds. Texts differ in length by five orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode without one a temporary folder.

    Raises ValueError on a cluster that names none: a machine's own folder would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), "glyphflow-shared")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def prepare(spark: SparkSession) -> None:
    """small_batches(), and the shuffle files of a finished query are deleted at once instead of when the driver collects
    its garbage: an operator of several steps would otherwise hold the files of all of them."""
    small_batches(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: later stages and lost executors don't compute them again."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing needs any more; others, and those out of reach, are left alone."""
    for path in filter(None, (getattr(t, "written_at", None) for t in tables)):
        with contextlib.suppress(OSError, pa.ArrowInvalid):  # what stays takes space, no more
            system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            system.delete_dir(where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column) -> F.Column:
    """A string column for Python: null is empty."""
    return F.coalesce(column.cast("string"), F.lit(""))
