"""Vector bin packing of documents into shards.

Bytes, tokens (of a byte-level BPE) and rows are balanced jointly. Documents
with equal texts are one group, placed whole unless it is so large that it
would unbalance the shards; such a group's rows are dealt to chunks, whatever
their keys. Texts are read once, for the sizes, which are written down. Groups are dealt to buckets. Each
bucket packs its groups, largest first, into as many bins as there are shards:
a group goes where the dot product of its size vector with the residual
capacity is highest. The bins of all buckets, which are few, are then packed
into the shards by the same rule.

So no task holds more than a bucket, and the driver sees the hot groups (fewer
than ``6 * shards * SHARE``, for each has over that share of the rows, bytes or tokens) and
the sums of ``MAX_BUCKETS * shards`` bins at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbers, slices
from .packing import coder

#: A group with more than 1 / (shards * SHARE) of the rows, bytes or tokens is cut into chunks.
SHARE = 4
ROWS_IN_BUCKET = 20_000
MAX_BUCKETS = 1 << 14


def place(items: np.ndarray, bins: int, capacity: np.ndarray) -> np.ndarray:
    """Bins of items (n x dimensions): in falling size, each where its dot product with the residual capacity is highest. Ties go to the first bin."""
    scaled = items / np.where(capacity > 0, capacity, 1)
    residual = np.ones((bins, items.shape[1]))
    out = np.zeros(len(items), dtype=np.int32)
    for k in np.argsort(-scaled.max(axis=1), kind="stable").tolist() if len(items) else ():
        at = int((residual @ scaled[k]).argmax())
        residual[at] -= scaled[k]
        out[k] = at
    return out


def measures(docs: DataFrame) -> DataFrame:
    """The sizes of each row: UTF-8 bytes plus 1, tokens, crc32, the hash that groups equal texts, and ``place``, a number of its own."""
    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(
        "doc_id",
        text.alias("text"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = coder(), TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            tokens = own.count(numbers(batch, "text"))
            kept = [batch.column(c) for c in ("doc_id", "size", "text_crc32", "text_hash")]
            places = np.arange(place, place + batch.num_rows)
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tokens, pa.int64()), pa.array(places)], names=["doc_id", "size", "text_crc32", "text_hash", "tokens", "place"])

    return read.mapInArrow(run, f"doc_id {kind}, size long, text_crc32 long, text_hash long, tokens long, place long")


def _pack_bucket(shards: int):
    def run(data: pa.Table) -> pa.Table:
        hashes, salts = data["text_hash"].to_numpy(), data["salt"].to_numpy()
        vectors = np.stack([data["size"].to_numpy(), data["tokens"].to_numpy(), np.ones(len(hashes), np.int64)], axis=1).astype(np.float64)
        order = np.lexsort((data["text_crc32"].to_numpy(), salts, hashes))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (salts[order][1:] != salts[order][:-1])
        starts = np.flatnonzero(fresh)
        units = np.add.reduceat(vectors[order], starts, axis=0)
        chosen = np.empty(len(order), np.int32)
        chosen[order] = place(units, shards, units.sum(axis=0) / shards)[np.cumsum(fresh) - 1]
        slot, by_bin = np.empty(len(order), np.int64), np.argsort(chosen, kind="stable")
        counts = np.bincount(chosen, minlength=shards)
        slot[by_bin] = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = data.select(["doc_id", "size", "tokens", "text_crc32", "bucket"])
        return keep.append_column("bin", pa.array(chosen)).append_column("local", pa.array(slot))

    return run


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Puts every document into a shard, by the law ``bytes``: sizes are near equal.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each
    shard), grown_shard (null: this law promises nothing about more shards)
    and tokens. A null text counts as empty, with size 1 and no tokens. Null and repeated
    keys are kept, each row with a slot of its own. Extra columns are ignored.
    An empty table gives no rows.
    """
    spark, rows = docs.sparkSession, materialise(measures(docs), "measures")
    totals = rows.groupBy().agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum("tokens").alias("t")).first()
    n, limit = totals["n"], 1 / (shards * SHARE)
    groups = rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum("tokens").alias("t"))
    share = F.greatest(*(F.col(x) / max(totals[x] or 0, 1) for x in "nbt"))
    hot = groups.select("text_hash", share.alias("share"), "n").where((F.col("share") > limit) & (F.col("n") > 1)).collect()
    buckets = min(MAX_BUCKETS, max(1, n // ROWS_IN_BUCKET))
    salt = F.lit(0)
    if hot:
        chunks = F.create_map(*(F.lit(v) for r in hot for v in (r["text_hash"], int(np.ceil(r["share"] * buckets * shards * SHARE)))))
        salt = F.coalesce(F.pmod(F.xxhash64("place"), F.element_at(chunks, F.col("text_hash"))), F.lit(0)).cast("int")
    salted = rows.withColumn("salt", salt)
    salted = salted.withColumn("bucket", F.pmod(F.xxhash64("text_hash", "salt"), F.lit(buckets)).cast("int"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = materialise(
        salted.groupBy("bucket").applyInArrow(_pack_bucket(shards), f"doc_id {kind}, size long, tokens long, text_crc32 long, bucket int, bin int, local long"),
        "shards",
    )
    sums = packed.groupBy("bucket", "bin").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("bucket", "bin").collect()
    where = spark.createDataFrame(_bin_table(sums, shards), "bucket int, bin int, shard int, before long")
    return packed.join(F.broadcast(where), ["bucket", "bin"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("local")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def _bin_table(sums: Iterable, shards: int) -> list[tuple]:
    """(bucket, bin, shard, rows of that shard before it)"""
    sums = list(sums)
    items = np.array([[r["b"], r["t"], r["n"]] for r in sums], dtype=np.float64).reshape(len(sums), 3)
    placed = place(items, shards, items.sum(axis=0) / shards)
    filled, out = [0] * shards, []
    for r, at in zip(sums, placed.tolist(), strict=True):
        out.append((r["bucket"], r["bin"], at, filled[at]))
        filled[at] += r["n"]
    return out


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Writes documents as one Parquet folder per shard. Keys must be unique."""
    chosen = assign_shards(docs, shards).select("doc_id", "shard", "slot")
    docs.join(chosen, "doc_id").write.partitionBy("shard").parquet(path)
