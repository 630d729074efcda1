"""Two-sided nearest look-ups in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def between_anchors(rows: DataFrame, anchors: DataFrame, key: str, time: str = "t", value: str = "v") -> DataFrame:
    """Each row with the value at its time between its nearest anchors, at or before and at or after it.

    Between two anchors the value is interpolated; beyond the last or before
    the first one it moves along with the time; without anchors it is null.
    Rows and anchors are merged in time and looked up by running last and
    first values, so nothing is joined.
    """
    both = rows.select(*rows.columns, F.lit(None).cast("double").alias("_at"), F.lit(None).cast("double").alias("_v")).unionByName(
        anchors.select(key, F.col(time), F.col(time).cast("double").alias("_at"), F.col(value).cast("double").alias("_v")), allowMissingColumns=True
    )
    point = F.when(F.col("_at").isNotNull(), F.struct("_at", "_v"))
    w = Window.partitionBy(key).orderBy(time)
    low = F.last(point, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    high = F.first(point, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_low", low).withColumn("_high", high).where("_at IS NULL")
    gap = F.col("_high._at") - F.col("_low._at")
    part = F.when(gap > 0, (F.col(time) - F.col("_low._at")) / gap).otherwise(F.lit(0.0))
    inside = F.col("_low._v") + (F.col("_high._v") - F.col("_low._v")) * part
    beyond = F.coalesce(F.col("_low._v") + F.col(time) - F.col("_low._at"), F.col("_high._v") + F.col(time) - F.col("_high._at"))
    return found.withColumn("found", F.coalesce(inside, beyond)).drop("_at", "_v", "_low", "_high")
