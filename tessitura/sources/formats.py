"""Readers of further formats: side-cars, tier files, pair lists, logs, statistics; and jobs on files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import listing, stem


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file beside each sample: its stem below ``path`` as ``key``, gen_len and text_ipa. Files that aren't JSON have a ``reject``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    row = F.from_json("value", "gen_len int, text_ipa string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = files.select(stem(F.col("_metadata.file_path")).alias("key"), row.alias("row"))
    bad = F.col("row._corrupt").isNotNull() | F.col("row.gen_len").isNull() | F.col("row.text_ipa").isNull()
    return parsed.select("key", "row.gen_len", "row.text_ipa", F.when(bad, F.lit("no side-car")).alias("reject"))


def read_pair_list(lines: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """wav, ref_wav and text of lines with 2 (wav, text), 3 (wav, reference wav, text) or 4 fields (wav, any, text, reference wav).

    Another number of fields is an error. With ``there`` (column wav) rows
    whose file isn't among them are left out.
    """
    parts = F.split(F.trim("value"), r"\|")
    n, field = F.size(parts), lambda k: F.get(parts, F.lit(k))
    wrong = F.raise_error(F.concat(F.lit("2, 3 or 4 fields are expected: "), F.col("value"))).cast("string")
    text = F.when(n == 2, field(1)).when(n.isin(3, 4), field(2)).otherwise(wrong)
    rows = lines.select(field(0).alias("wav"), F.when(n == 3, field(1)).when(n == 4, field(3)).alias("ref_wav"), text.alias("text"))
    return rows if there is None else rows.join(there.select("wav"), "wav", "left_semi")


def read_textgrid(files: DataFrame) -> DataFrame:
    """speaker, start, stop and text of the marked intervals of TextGrid files (columns utt and value, a whole file each), by start.

    A tier's name is the speaker. Quotes inside marks are doubled, as the
    format has it; marks of blanks alone count as none.
    """
    tiers = F.regexp_extract_all("value", F.lit(r'(?s)name\s*=\s*"((?:[^"]|"")*)"(.*?)(?=class\s*=|\z)'), F.lit(0))
    tier = files.select("utt", F.explode(tiers).alias("tier"))
    interval = r'(?s)xmin\s*=\s*([-0-9.eE]+)\s*xmax\s*=\s*([-0-9.eE]+)\s*text\s*=\s*"((?:[^"]|"")*)"'
    rows = tier.select("utt", F.regexp_extract("tier", r'^name\s*=\s*"((?:[^"]|"")*)"', 1).alias("speaker"), F.explode(F.regexp_extract_all("tier", F.lit(interval), F.lit(0))).alias("at"))
    part = lambda k: F.regexp_extract("at", interval, k)
    text = F.regexp_replace(F.replace(part(3), F.lit('""'), F.lit('"')), r"^\s+|\s+$", "")
    return rows.select("utt", "speaker", part(1).cast("double").alias("start"), part(2).cast("double").alias("stop"), text.alias("text")).where("text <> ''").orderBy("utt", "start", "speaker")


def read_speakers(lines: DataFrame) -> DataFrame:
    """``speaker utterance utterance ...`` lines as speaker and utt."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("speaker"), F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("utt"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """step, mean_absolute_error and mean_relative_error of validation logs ``val_<step>.jsonl``; logs without the first are left out."""
    lines = spark.read.option("pathGlobFilter", "val_*.jsonl").text(path).select("value", F.regexp_extract("_metadata.file_name", r"^val_(\d+)\.jsonl$", 1).alias("step"))
    found = lambda name: F.get_json_object("value", f"$.summary.{name}").try_cast("double")
    rows = lines.where("step <> ''").select(F.col("step").cast("long").alias("step"), found("mean_absolute_error").alias("mae"), found("mean_relative_error").alias("mre"))
    return rows.where("mae IS NOT NULL").groupBy("step").agg(F.max("mae").alias("mean_absolute_error"), F.max("mre").alias("mean_relative_error"))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """``shift`` and ``scale``: the numbers of the lines after <AddShift> and <Rescale> in a file of feature statistics. It is one small file, read as one row."""
    text = spark.read.text(path, wholetext=True)

    def numbers(mark: str) -> Column:
        body = F.regexp_extract("value", rf"(?s)<{mark}>[^\n]*\n\s*<LearnRateCoef>\s+\S+\s+\[\s*(.*?)\s*\]", 1)
        return F.transform(F.filter(F.split(body, r"\s+"), lambda x: x != ""), lambda x: x.cast("float"))

    return text.select(numbers("AddShift").alias("shift"), numbers("Rescale").alias("scale"))


def conversion_jobs(spark: SparkSession, path: str, pattern: str, command: str, ending: str = ".wav") -> DataFrame:
    """source, target and command of every file below ``path`` that is to be converted; nothing is run. ``command`` names {source} and {target}."""
    files = listing(spark, path, pattern)
    target = F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(ending))
    filled = F.replace(F.replace(F.lit(command), F.lit("{source}"), F.col("path")), F.lit("{target}"), target)
    return files.select(F.col("path").alias("source"), target.alias("target"), filled.alias("command"))


def disjoint_regions(regions: DataFrame) -> DataFrame:
    """Regions (file, channel, start, stop) as they are; an error when read if two of a file and channel overlap."""
    before = F.max("stop").over(Window.partitionBy("file", "channel").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    wrong = F.raise_error(F.concat(F.lit("regions overlap in "), F.col("file"))).cast("double")
    return regions.withColumn("_before", before).withColumn("start", F.when(F.col("_before").isNull() | (F.col("start") >= F.col("_before")), F.col("start")).otherwise(wrong)).drop("_before")
