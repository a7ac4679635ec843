"""What the corpus operators share: reading tables, cutting lineage, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Bounds what one Arrow batch holds, since single texts may be very long.

    The bound is the session's and stays for its later queries, whose results
    don't depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """Returns a Python worker's freed memory to the system, as workers live on into later stages beside the executor's heap."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other C libraries do without
    if trim:
        trim(0)


def scratch(spark: SparkSession, name: str) -> str:
    """New folder name under the shared folder the cluster names in spark.checkpoint.dir.

    Only where that is unset and everything runs on this machine a temporary
    folder is taken; on a cluster it must be set.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.barwright.scratch", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.barwright.scratch", base)
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _NAMED.append(path)
    return path


#: Folders that scratch named so far, in order.
_NAMED: list[str] = []


def mark() -> int:
    """A point in the row of tables written; see drop_since."""
    return len(_NAMED)


def drop_since(spark: SparkSession, point: int, keep: str) -> None:
    """Deletes the tables written since ``point`` but for the folder ``keep``, when nothing will be read from them any more."""
    for path in _NAMED[point:]:
        if path != keep:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _NAMED[point:] = [keep]


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators wrote; for the end of a run, as results may still be read from them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x")).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    The files outlive executors, so later stages restart from them, and
    columns that a later step doesn't use aren't read.
    """
    return cut_to(df, scratch(df.sparkSession, name))


def cut_to(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a small table as arrays.  They come as Arrow batches whatever the session's settings, not as Python objects."""
    t = df.toArrow()
    return [t.column(k).to_numpy() for k in range(t.num_columns)]


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """Marks a table for broadcast if counting shows that it is small; otherwise its join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def row_key(doc_id: Column, text: Column) -> Column:
    """Two 64-bit hashes of id and text, never null: rows that share a doc_id are told apart by their texts."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(text, F.lit(1), doc_id).alias("b"))


def without(docs: DataFrame, gone: DataFrame, limit: int = 200_000) -> DataFrame:
    """docs less the rows whose row_key is in ``gone`` (24 bytes each; broadcast up to ``limit`` of them)."""
    gone = cut(gone.select(F.col("row_key").alias("_barwright_key")), "gone")
    keep = docs.join(bounded(gone, limit), row_key(docs["doc_id"], docs["text"]) == F.col("_barwright_key"), "left_anti")
    return keep.select(*docs.columns)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and no other letter.

    The built-in lower() is far quicker than translate(); over pure ASCII
    both give the same.
    """
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
