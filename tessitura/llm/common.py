"""What the operators of this package share: tables, shared storage, words."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of ``documents``; filtering stages return these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Bytes of text that a Python operator holds decoded at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table through Spark, whatever file system ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that were handed out and not released yet, by Spark application and thread.
_made: dict[tuple[str, int], list[str]] = {}


def _own(spark: SparkSession) -> list[str]:
    return _made.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for ``purpose`` that the driver and all executors see.

    It lies in the folder of ``spark.checkpoint.dir``. Only in local mode,
    where driver and executors are one process, may that be unset: then a local
    folder is set instead. On a cluster it would not be shared, so there an
    unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/tessitura"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tessitura-{purpose}-{uuid.uuid4().hex}"
    _own(spark).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The folders handed out to this thread so far that weren't released."""
    return list(_own(spark))


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders of ``shared_dir`` that nothing reads any more."""
    known = _own(spark)
    for path in list(paths):
        if path in known:
            known.remove(path)
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def materialise(df: DataFrame, purpose: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    This cuts the lineage: what is read later survives the loss of executors
    and isn't computed twice.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.option("compression", codec).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for ``df``, which nothing may read any more."""
    release(df.sparkSession, [df._scratch])


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as ``row``, with ``id`` (its doc_id) and ``text_key`` (a hash of its text, null for null).

    As the row's own columns are inside ``row``, whatever they are called, no
    name can clash with those that an operator adds or joins.
    """
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_key"))


#: A key with over 1 / HOT of the rows is hot; so there are fewer than HOT of them.
HOT = 2000


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Joins ``left`` with ``right``, which has one row for each key, with hot keys dealt to many tasks.

    ``counts`` has ``n``, the rows of ``left`` with each key. A hot key's rows
    are numbered into parts of 1 / HOT of all, and its row of ``right`` goes
    to each part. The list of hot keys has fewer than HOT rows, so it may be
    broadcast.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int")
    hot = F.broadcast(counts.where(F.col("n") * HOT > total).select(key, parts.alias("_parts")))
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes in each.

    One text is never cut: a slice has one row at least.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()  # what Arrow keeps for later would add up over a worker's tasks


def numbers(batch: pa.RecordBatch, column: str) -> list:
    """A column's values as Python objects (None for null)."""
    return batch.column(column).to_pylist()


def key_text(column: str) -> F.Column:
    """A key as text, for the folds that are defined by crc32 of that text."""
    return F.col(column).cast("string").cast("binary")


def fold(column: str, modulus: int) -> F.Column:
    """crc32(key as text) mod ``modulus``; null for a null key."""
    return F.crc32(key_text(column)) % modulus
