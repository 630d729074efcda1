"""Incremental preparation with Structured Streaming. An extension: batches do the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessitura.functions import text as T
from tessitura.sources.manifests import parse_lines


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest lines as files arrive."""
    return parse_lines(spark.readStream.text(folder))


def prepare(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Cleans and tokenises accepted rows and appends them, each file once; runs until all that is there is done."""
    good = rows.where("reject IS NULL").select("path", "duration", "mos", T.tokens_v6(T.clean_text(F.col("text"))).alias("tokens"))
    return good.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; events later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
