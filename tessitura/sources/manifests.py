"""Readers of line-based files: manifests, key maps, transcripts, annotations.

Readers take lines as a column ``value``, as ``spark.read.text`` gives them,
so that they serve files, tables and streams alike. Lines that don't parse
aren't dropped in silence: they have a ``reject`` that says why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame) -> DataFrame:
    """``path|seconds|text`` or ``path|seconds|mos|text``: the text is the last field. Other numbers of fields are rejected."""
    fields = F.split("value", r"\|")
    n = F.size(fields)
    seconds = F.get(fields, F.lit(1)).try_cast("double")
    good = n.isin(3, 4)
    reject = F.when(~good, F.concat(n.cast("string"), F.lit(" fields"))).when(seconds.isNull(), F.lit("duration is no number"))
    return lines.select(
        F.get(fields, F.lit(0)).alias("path"),
        seconds.alias("duration"),
        F.when(n == 4, F.get(fields, F.lit(2)).try_cast("double")).alias("mos"),
        F.when(good, F.get(fields, n - 1)).alias("text"),
        reject.alias("reject"),
        *(F.col(c) for c in lines.columns if c != "value"),
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests named ``metadata_<lang>_<corpus>.csv``, without their header lines."""
    name = F.col("_metadata.file_name")
    lines = spark.read.text(path).select("value", name.alias("file"), F.split_part(name, F.lit("_"), F.lit(2)).alias("lang"), F.col("_metadata.file_block_start").alias("_at"))
    return parse_lines(lines.where(~F.col("value").rlike(r"^(audio_file|path|audio_path)\|"))).drop("_at")


def last_of_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs with one key the last, in the order in which they were read."""
    placed = pairs.withColumn("_at", F.monotonically_increasing_id())
    return placed.groupBy("key").agg(F.max_by("val", "_at").alias("val"))


def read_pairs(lines: DataFrame, suffix: str = "", tab: bool = False) -> DataFrame:
    """``key value`` lines; the value keeps its blanks. With ``tab`` a tab divides where there is one."""
    pattern = r"^(\S+)\s+(.*)$"
    key, value = F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)
    if tab:
        tabbed = F.contains("value", F.lit("\t"))
        key = F.when(tabbed, F.split_part("value", F.lit("\t"), F.lit(1))).otherwise(key)
        value = F.when(tabbed, F.regexp_extract("value", r"^[^\t]*\t(.*)$", 1)).otherwise(value)
    end = F.lit(f"_{suffix}" if suffix else "")
    return lines.where(F.trim("value") != "").select(F.concat(key, end).alias("key"), F.concat(value, end if suffix else F.lit("")).alias("val"))


def read_transcript(lines: DataFrame) -> DataFrame:
    """``speaker start stop text...``: the text's parts are joined without blanks; two fields or fewer are an error."""
    parts = F.split(F.trim("value"), r"\s+")
    n = F.size(parts)
    speaker = F.when(n >= 3, F.get(parts, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("fewer than three fields: "), F.col("value"))))
    return lines.select(speaker.alias("speaker"), F.get(parts, F.lit(1)).cast("double").alias("start"), F.get(parts, F.lit(2)).cast("double").alias("stop"), F.array_join(F.slice(parts, 4, F.greatest(n - 3, F.lit(1))), "").alias("text"))


def read_rttm(lines: DataFrame) -> DataFrame:
    """Speaker turns; comments and other kinds of line are skipped, ``<na>`` counts as 0."""
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.when(F.lower(F.get(parts, F.lit(k))) == "<na>", F.lit(0.0)).otherwise(F.get(parts, F.lit(k)).try_cast("double"))
    kept = lines.where(~F.col("value").startswith(";") & (F.size(parts) >= 9) & (F.get(parts, F.lit(0)) == "SPEAKER"))
    return kept.select(F.get(parts, F.lit(1)).alias("file"), F.get(parts, F.lit(2)).alias("channel"), number(3).alias("start"), (number(3) + number(4)).alias("stop"), F.get(parts, F.lit(7)).alias("speaker"))


def rttm_lines(turns: DataFrame, file: str = "file") -> DataFrame:
    """Speaker turns (start, stop, label) as lines."""
    return turns.select(F.format_string("SPEAKER %s 0 %.2f %.2f <NA> <NA> %s <NA> <NA>", F.col(file).cast("string"), "start", F.col("stop") - F.col("start"), F.col("label").cast("string")).alias("value"))


def read_uem(lines: DataFrame) -> DataFrame:
    """Regions to score; each must be of positive length."""
    parts = F.split(F.trim("value"), r"\s+")
    start, stop = F.get(parts, F.lit(2)).cast("double"), F.get(parts, F.lit(3)).cast("double")
    return lines.where(F.size(parts) >= 4).select(F.get(parts, F.lit(0)).alias("file"), F.get(parts, F.lit(1)).alias("channel"), start.alias("start"), F.when(stop > start, stop).otherwise(F.raise_error(F.lit("a region has no length")).cast("double")).alias("stop"))


def read_word_map(lines: DataFrame) -> DataFrame:
    """``word => replacement`` in lower case, without comments."""
    pattern = r"^\s*([^;]*?)\s*=>\s*(.*?)\s*$"
    kept = lines.where(~F.col("value").startswith(";") & F.col("value").rlike(pattern))
    return kept.select(F.lower(F.regexp_extract("value", pattern, 1)).alias("word"), F.lower(F.regexp_extract("value", pattern, 2)).alias("replacement"))


def read_metric_lines(lines: DataFrame, name: str) -> DataFrame:
    """JSON rows with ``name`` and a line ``NAME: value``: the last such value, or the rows' mean where there is none.

    Lines are in order by ``line`` where they have that column.
    """
    row = F.get_json_object("value", f"$.{name}").try_cast("double")
    found = F.regexp_extract("value", rf"(?i)^{name}\s*:\s*([-0-9.eE]+)", 1).try_cast("double")
    order = F.col("line") if "line" in lines.columns else F.monotonically_increasing_id()
    numbered = lines.select(row.alias("_row"), found.alias("_last"), order.alias("_order"))
    return numbered.agg(F.coalesce(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_order"))), F.avg("_row")).alias(name))
