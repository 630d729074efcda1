"""Readers of whole files and listings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.joins import require_unique


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times of all files below a folder; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


def path_part(path: Column, from_end: int) -> Column:
    """A part of a path, counted from its end: 1 is the file's name."""
    return F.element_at(F.split(path, "/"), -from_end)


def stem(path: Column) -> Column:
    return F.regexp_replace(path_part(path, 1), r"\.[^.]*$", "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number from 0. One file is one partition here, as vocabularies and id lists are small."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "value"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token and id of a vocabulary file: a token's id is the number of its line."""
    return numbered_lines(spark, path).select(F.col("value").alias("token"), F.col("line").cast("long").alias("id"))


def keyed_csv(spark: SparkSession, path: str, schema: str, key: str = "ID") -> DataFrame:
    """A CSV file whose key must be unique."""
    return require_unique(spark.read.schema(schema).option("header", "true").csv(path), key)


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON (lines or documents) or Parquet, by the file's extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    if kind in ("json", "jsonl"):
        return spark.read.option("multiLine", str(kind == "json").lower()).json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for files of kind {kind}")


def prompt_list(lines: DataFrame, folder: str) -> DataFrame:
    """``utt|prompt text|prompt wav|text[|wav]``; a missing wav is ``folder/wavs/utt.wav``, relative paths are below ``folder``."""
    parts = F.split("value", r"\|")
    full = lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(f"{folder}/"), p))
    utt = F.get(parts, F.lit(0))
    wav = F.coalesce(F.get(parts, F.lit(4)), F.concat(F.lit("wavs/"), utt, F.lit(".wav")))
    return lines.where(F.size(parts).isin(4, 5)).select(utt.alias("utt"), F.get(parts, F.lit(1)).alias("prompt_text"), full(F.get(parts, F.lit(2))).alias("prompt_wav"), F.get(parts, F.lit(3)).alias("text"), full(wav).alias("wav"))


def cross_list(lines: DataFrame, folder: str) -> DataFrame:
    """Six tab-separated fields; a recording lies in the folders that its id names before its dashes."""
    parts = F.split("value", "\t")
    wav = lambda u: F.concat(F.lit(f"{folder}/"), F.split_part(u, F.lit("-"), F.lit(1)), F.lit("/"), F.split_part(u, F.lit("-"), F.lit(2)), F.lit("/"), u, F.lit(".flac"))
    named = [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("ref_utt", "ref_dur", "ref_text", "utt", "dur", "text"))]
    rows = lines.where(F.size(parts) == 6).select(*named)
    return rows.select("ref_utt", F.col("ref_dur").cast("double").alias("ref_dur"), "ref_text", wav(F.col("ref_utt")).alias("ref_wav"), "utt", F.col("dur").cast("double").alias("dur"), "text", wav(F.col("utt")).alias("wav"))


def intervals_json(documents: DataFrame) -> DataFrame:
    """A JSON map of id to {file, start, stop, sample_rate} (column value) as rows."""
    kind = "map<string,struct<file:string,start:double,stop:double,sample_rate:int>>"
    return documents.select(F.explode(F.from_json("value", kind)).alias("id", "at")).select("id", "at.*")


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in [-1, 1] of a PCM WAV file of 8, 16, 24 or 32 bits."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            layout = struct.unpack_from("<HHIIHH", data, at + 8)
        if name == b"data" and layout:
            kind, channels, rate, _, _, bits = layout
            raw = data[at + 8 : at + 8 + size]
            if kind == 3:
                x = np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype(np.float64)
            elif bits == 8:
                x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
            elif bits == 24:
                b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
            else:
                x = np.frombuffer(raw, f"<i{bits // 8}").astype(np.float64) / float(1 << (bits - 1))
            return rate, x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode_wavs(files: DataFrame) -> DataFrame:
    """path, sample_rate, seconds and samples of WAV files (columns path and content); unreadable ones with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("content").to_pylist():
                try:
                    rate, x = parse_wav(data or b"")
                    rows.append((rate, len(x) / rate, x.astype(np.float32), None))
                except (ValueError, struct.error) as e:
                    rows.append((None, None, None, str(e)))
            got = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = [pa.int32(), pa.float64(), pa.list_(pa.float32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array(v, t) for v, t in zip(got, types, strict=True))], names=["path", "sample_rate", "seconds", "samples", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, sample_rate int, seconds double, samples array<float>, error string")
