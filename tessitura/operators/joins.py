"""Joins on ranges: by buckets, so that no side is compared with all of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import sum_before


def range_join(left: DataFrame, right: DataFrame, keys: list[str], low: Column, high: Column, point: Column, width: int) -> DataFrame:
    """Pairs with equal ``keys`` where the right ``point`` lies in the left [low, high].

    The left row goes to every bucket of ``width`` that its range touches, the
    right row to its own, so this is an equi-join with a filter behind it.
    """
    a = left.withColumn("_low", low).withColumn("_high", high)
    a = a.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    b = right.withColumn("_point", point).withColumn("_bucket", F.floor(F.col("_point") / width))
    return a.join(b, [*keys, "_bucket"]).where("_point BETWEEN _low AND _high").drop("_low", "_high", "_bucket", "_point")


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of intervals (start, stop) and (v_start, v_stop) of a key that overlap.

    Both sides go to all buckets they touch; a pair is kept in the bucket
    where its overlap starts, so it is found once.
    """
    bucket = lambda x: F.floor(x / width)
    a = left.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop")))))
    b = right.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("v_start")), bucket(F.col("v_stop")))))
    joined = a.join(b, [key, "_bucket"]).where((F.col("stop") > F.col("v_start")) & (F.col("v_stop") > F.col("start")))
    return joined.where(F.col("_bucket") == bucket(F.greatest("start", "v_start"))).drop("_bucket")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows, or an error when read if a key occurs twice."""
    counted = rows.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in rows.columns if c != key])).alias("_row"))
    checked = F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(F.concat(F.lit(f"{key} occurs twice: "), F.col(key).cast("string"))).cast("long"))
    return counted.withColumn("_n", checked).where("_n = 1").select(key, "_row.*")


def pick_in_range(rows: DataFrame, pool: DataFrame, group: str, key: str, value: str, low: Column, high: Column, number: Column) -> DataFrame:
    """For each row one of the pool's rows of its group whose ``value`` lies in [low, high], and how many there are.

    Adds ``chosen`` (its ``key``; null if there is none) and ``n_candidates``.
    Of the candidates, in order of value and key, that at ``number`` modulo
    their count is taken. Bounds and pool are put in one order and counted, so
    that no candidate but the chosen one is ever paired with a row.
    """
    bounds = rows.select("*", low.cast("double").alias("_low"), high.cast("double").alias("_high"), number.cast("long").alias("_number"))
    ends = F.inline(F.array(F.struct(F.col("_low").alias("_at"), F.lit(0).alias("_kind")), F.struct(F.col("_high").alias("_at"), F.lit(2).alias("_kind"))))
    probes = bounds.select(F.col(group).alias("_g"), F.col(key).alias("_key"), ends)
    points = pool.select(F.col(group).alias("_g"), F.col(key).alias("_key"), F.col(value).cast("double").alias("_at"), F.lit(1).alias("_kind"))
    every = probes.unionByName(points).withColumn("_order", F.struct("_at", "_kind", "_key")).withColumn("_one", (F.col("_kind") == 1).cast("long"))
    # parts rise with the order: whole powers of two, then eighths of them
    part = F.floor(F.log2(F.greatest(F.col("_at"), F.lit(1.0))) * 8)
    placed = sum_before(every, "_g", "_order", "_one", "_rank", part=part).select("_g", "_key", "_kind", "_rank")
    counted = placed.where("_kind <> 1").groupBy("_g", "_key").agg(F.max(F.when(F.col("_kind") == 0, F.col("_rank"))).alias("_first"), F.max(F.when(F.col("_kind") == 2, F.col("_rank"))).alias("_stop"))
    joined = bounds.join(counted, F.col(group).eqNullSafe(F.col("_g")) & (F.col(key) == F.col("_key"))).withColumn("n_candidates", F.greatest(F.col("_stop") - F.col("_first"), F.lit(0)))
    wanted = joined.withColumn("_want", F.when(F.col("n_candidates") > 0, F.col("_first") + F.pmod("_number", "n_candidates"))).select(*rows.columns, "n_candidates", "_want")
    ranked = placed.where("_kind = 1").select(F.col("_g").alias("_pool"), F.col("_rank").alias("_own"), F.col("_key").alias("chosen"))
    found = wanted.join(ranked, F.col(group).eqNullSafe(F.col("_pool")) & (F.col("_want") == F.col("_own")), "left")
    return found.select(*rows.columns, "chosen", "n_candidates")


def positional(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Two array columns paired by place, with ``pos`` from 1; different lengths are an error."""
    same = F.when(F.size(left) == F.size(right), F.arrays_zip(F.col(left).alias("_a"), F.col(right).alias("_b")))
    checked = F.coalesce(same, F.raise_error(F.concat_ws(" ", F.lit("lists of"), F.size(left).cast("string"), F.lit("and"), F.size(right).cast("string"))).cast("array<struct<_a:string,_b:string>>"))
    kept = [c for c in rows.columns if c not in (left, right)]
    return rows.select(*kept, F.posexplode(checked).alias("pos", "_pair")).select(*kept, (F.col("pos") + 1).alias("pos"), F.col("_pair._a").alias(left), F.col("_pair._b").alias(right))


def looked_up(rows: DataFrame, key: str, tokens: str, known: DataFrame, exempt: str = "…", unknown: int = 0) -> DataFrame:
    """key and ``ids``: each token's id (from token and id) in order; of a token that isn't known those of its characters."""
    flat = rows.select(key, F.posexplode(tokens).alias("_pos", "token"))
    first = flat.join(known, "token", "left")
    parts = F.when(F.col("id").isNull() & (F.col("token") != exempt), F.filter(F.split("token", ""), lambda c: c != "")).otherwise(F.array("token"))
    pieces = first.select(key, "_pos", F.posexplode(parts).alias("_part", "token"))
    found = pieces.join(known, "token", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_part", F.coalesce("id", F.lit(unknown)).alias("id")))).alias("_ids"))
    return found.select(key, F.transform("_ids", lambda x: x["id"]).alias("ids"))


def require_share(rows: DataFrame, failed: Column, most: float = 0.1) -> DataFrame:
    """The rows that didn't fail, or an error when read if more than ``most`` of all did."""
    marked = rows.withColumn("_failed", failed)
    share = marked.agg(F.avg(F.col("_failed").cast("int")).alias("_share"))
    checked = share.select(F.when(F.coalesce("_share", F.lit(0.0)) <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most:.0%} of the rows failed")).cast("boolean")).alias("_good"))
    return marked.where("NOT _failed").crossJoin(F.broadcast(checked)).where("_good").drop("_failed", "_good")


def require_present(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """The rows, or an error when read if the key of one isn't among those that are ``there``."""
    known = there.select(key).distinct().withColumn("_there", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("missing: "), F.col(key).cast("string"))).cast("boolean")
    return rows.join(known, key, "left").where(F.coalesce("_there", missing)).drop("_there")
