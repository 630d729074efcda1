"""Nearest centres, for any number of rows and centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions import numeric as N

#: Centres that are compared with a row at once; more are dealt to blocks.
BLOCK = 1000


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label and centre: the mean of each label's vectors."""
    flat = rows.select(F.col(label).alias("label"), F.posexplode(vector).alias("_pos", "_v"))
    mean = flat.groupBy("label", "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda x: x["_m"]).alias("centre"))


def nearest(rows: DataFrame, vector: str, centres: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``nearest``, the label whose centre has the highest cosine (of equal ones the larger label), and ``similarity``; null without centres.

    Centres are counted first. A block of them is one array; every row meets
    every block, and its best of each are compared. Few centres make a single
    block, whose size is bounded.
    """
    blocks = max(1, -(-centres.count() // block))
    dealt = centres.groupBy(F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("_centres"))
    numbered = rows.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in rows.columns))).select("_row", F.col(vector).alias("_vector"))
    if blocks == 1:
        met = numbered.withColumn("_block", F.lit(0)).join(F.broadcast(dealt), "_block", "left")
        return met.select("_row.*", F.array_max(F.transform("_centres", lambda c: F.struct(N.cosine(F.col("_vector"), c["centre"]).alias("s"), c["label"].alias("l")))).alias("_best")).select(
            *rows.columns, F.col("_best.l").alias("nearest"), F.col("_best.s").alias("similarity")
        )
    met = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).join(dealt, "_block")
    best = met.select("_row", F.array_max(F.transform("_centres", lambda c: F.struct(N.cosine(F.col("_vector"), c["centre"]).alias("s"), c["label"].alias("l")))).alias("_best"))
    # equal rows are one here: each comes once for every block that has centres
    used = dealt.select("_block").distinct().count()
    found = best.groupBy("_row").agg(F.max("_best").alias("_best"), (F.count("*") / used).cast("int").alias("_times"))
    found = found.select("_row", "_best", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))
    return found.select("_row.*", F.col("_best.l").alias("nearest"), F.col("_best.s").alias("similarity"))
