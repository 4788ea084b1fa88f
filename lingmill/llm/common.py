"""What the operators of this subpackage share: the shared folder, checkpoints, size checks, table reading."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A value is broadcast only below this many bytes; every caller has another way above it.
BROADCAST_LIMIT = 64 << 20
#: Rows that a worker keeps go back to the JVM in pieces of about so many bytes, as it holds each outside its heap.
PIECE_BYTES = 1 << 20


@cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lingmill-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a folder of its own; on a cluster that is an error,
    as a machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def trim() -> None:
    """Gives freed memory back: a worker is used again, and would go on holding the most it ever needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sifted(batches: Iterator[pa.RecordBatch], keep: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows that keep() marks, in pieces of about PIECE_BYTES; memory is given back after each batch and at the end."""
    for batch in batches:
        marked = keep(batch)
        rows = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).filter(pa.array(marked[at : at + rows]))
        del batch, marked
        trim()
    trim()  # whoever made the last batch has let go of it only now


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The DataFrame as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    path: where it is to lie, so that it can be removed once nothing reads it.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """A column name like `name` that none of the columns has (Spark's names don't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def clean_string(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """df, marked for broadcast if its counted rows fit BROADCAST_LIMIT; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_LIMIT else df
