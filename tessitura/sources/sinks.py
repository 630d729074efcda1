"""Writers. All go through Spark's writers, so a failed task leaves nothing behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .manifests import rttm_lines


def write_samples(rows: DataFrame, path: str, partition: str = "lang") -> None:
    """A table partitioned by language; fails if there is one already."""
    rows.write.partitionBy(partition).mode("errorifexists").parquet(path)


def write_durations(rows: DataFrame, path: str, value: str = "duration") -> None:
    """Totals as one JSON line: rows, seconds, hours."""
    totals = rows.agg(F.count("*").alias("rows"), F.sum(value).alias("seconds"), (F.sum(value) / 3600).alias("hours"))
    totals.write.json(path)


def write_vocabulary(tokens: DataFrame, path: str) -> None:
    """``token`` and ``id`` as lines in the order of the ids. A vocabulary is small, so it is one file."""
    tokens.repartition(1).sortWithinPartitions("id").select(F.col("token").alias("value")).write.text(path)


def write_token_stats(stats: DataFrame, path: str) -> None:
    """Tab-separated with a header, most frequent tokens first."""
    named = stats.select(F.col("token").alias("Token"), F.col("total_count").alias("TotalCount"), F.col("num_langs").alias("NumLangs"), F.col("languages").alias("Languages"))
    named.repartition(1).sortWithinPartitions(F.desc("TotalCount"), "Token").write.option("sep", "\t").option("header", "true").csv(path)


def write_rttm(turns: DataFrame, path: str, file: str = "file") -> None:
    rttm_lines(turns, file).write.text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """``key value`` lines."""
    pairs.select(F.concat_ws(" ", "key", "val").alias("value")).write.text(path)


def write_transcript(rows: DataFrame, path: str) -> None:
    """``speaker start stop text`` lines; line breaks in texts go."""
    rows.select(F.concat_ws(" ", "speaker", F.col("start").cast("string"), F.col("stop").cast("string"), F.translate("text", "\r\n", "")).alias("value")).write.text(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """``enrol test score`` lines with five places."""
    scores.select(F.format_string("%s %s %.5f", F.col("enrol").cast("string"), F.col("test").cast("string"), "score").alias("value")).write.text(path)


def write_rows_and_metric(rows: DataFrame, path: str, metric: str) -> None:
    """JSON lines in ``path/rows`` and the metric's mean in ``path/metric``."""
    rows.write.json(f"{path}/rows")
    rows.agg(F.round(F.avg(metric), 5).alias(metric)).write.json(f"{path}/metric")


def write_summary(summary: DataFrame, path: str) -> None:
    summary.repartition(1).write.option("header", "true").csv(path)


def write_embeddings(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").parquet(path)


def append_missing(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table at ``path`` doesn't have yet, so finished work is skipped."""
    spark = rows.sparkSession
    done = spark.read.schema(rows.schema).parquet(path).select(key)
    rows.join(done, key, "left_anti").write.mode("append").parquet(path)


def write_counts(rows: DataFrame, path: str, value: str) -> None:
    """How often each value occurs, as one JSON object in the order of the values. Distinct values are few, as they are classes."""
    counted = rows.groupBy(value).agg(F.count("*").alias("_n")).agg(F.array_sort(F.collect_list(F.struct(value, "_n"))).alias("_all"))
    counted.select(F.to_json(F.map_from_entries(F.transform("_all", lambda x: F.struct(x[value].cast("string"), x["_n"])))).alias("value")).write.text(path)


def write_generated(rows: DataFrame, path: str) -> None:
    """Generated samples (rel_path, values, and what describes them) as table rows: one file each would be too many small ones."""
    rows.write.mode("errorifexists").parquet(path)


def write_json_array(rows: DataFrame, path: str, *order: str) -> None:
    """Rows as one JSON array, for small tables: the array is one row."""
    sort = F.struct(*(F.col(c) for c in order), F.struct("*").alias("_row")) if order else F.struct(F.struct("*").alias("_row"))
    every = rows.agg(F.array_sort(F.collect_list(sort)).alias("_all"))
    every.select(F.to_json(F.transform("_all", lambda x: x["_row"])).alias("value")).write.text(path)


def write_class_report(report: DataFrame, path: str) -> None:
    """A class report as CSV with three places, and a row of totals."""
    total = report.agg(F.lit("Total").alias("class"), *(F.sum(c).alias(c) for c in ("total", "guessed", "hits")), *(F.lit(None).cast("double").alias(c) for c in ("recall", "precision", "f1")))
    named = report.withColumn("class", F.col("class").cast("string")).unionByName(total)
    places = [F.when(F.col(c).isNotNull(), F.format_string("%.3f", c)).alias(c) if c in ("recall", "precision", "f1") else F.col(c) for c in report.columns]
    named.select(*places).repartition(1).sortWithinPartitions(F.col("class") == "Total", "class").write.option("header", "true").csv(path)


def write_segments(segments: DataFrame, path: str, options: dict) -> bool:
    """Segments as CSV and the options they were made with; nothing is done where the same options wrote them before. Returns whether it wrote."""
    spark = segments.sparkSession
    wanted = sorted((k, str(v)) for k, v in options.items())
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/options")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        if sorted(tuple(r) for r in spark.read.schema("key string, val string").parquet(f"{path}/options").collect()) == wanted:
            return False
        raise ValueError(f"{path} was written with other options")
    segments.write.mode("errorifexists").option("header", "true").csv(f"{path}/segments")
    spark.createDataFrame(wanted, "key string, val string").write.parquet(f"{path}/options")
    return True


def wav_bytes(samples: F.Column, rate: int) -> F.Column:
    """Samples in [-1, 1] as the bytes of a 16-bit mono WAV file, without Python."""
    little = lambda x, size: F.concat(*(F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)))
    scaled = F.transform(samples, lambda v: F.round(F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int"))
    body = F.array_join(F.transform(scaled, lambda v: little(v, 2)), "")
    size = F.size(samples) * 2
    text = lambda t: F.lit(t.encode().hex())
    number = lambda n, width: little(F.lit(n), width)
    head = F.concat(text("RIFF"), little(size + 36, 4), text("WAVEfmt "), number(16, 4), number(1, 2), number(1, 2), number(rate, 4), number(rate * 2, 4), number(2, 2), number(16, 2), text("data"), little(size, 4))
    return F.unhex(F.concat(head, body))


def write_wavs(rows: DataFrame, path: str, rate: int, samples: str = "samples") -> None:
    """Samples as WAV files in a binary column ``content``."""
    rows.withColumn("content", wav_bytes(F.col(samples), rate)).drop(samples).write.parquet(path)


def concatenate_rttm(spark, paths: list[str], path: str) -> None:
    """The lines of several RTTM files as one."""
    spark.read.text(paths).write.text(path)
