"""The corpus pipeline: stages that turn ``documents`` into packed sequences.

Each stage works on all that its predecessor kept, as written to Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import decontamination, langid, packing, simhash, substring
from tessitura.llm.common import DOCUMENT_COLUMNS, made, release, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown or ambiguous go; so do null, empty and letterless texts."""
    return langid.keep_identified(docs.select(*DOCUMENT_COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays. Null and empty texts are copies of each other."""
    return simhash.keep_one(docs.select(*DOCUMENT_COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out; a document of nothing else goes. Others keep their text as it is, null or empty ones too."""
    rows = docs.select(F.struct(*DOCUMENT_COLUMNS).alias("row"), "doc_id", "text")
    trimmed = substring.remove_repeats(rows, carry=("row",))
    cut = F.col("n_removed") > 0
    n_chars = docs.schema["n_chars"].dataType
    changed = {"text": F.when(cut, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(cut, F.length("kept").cast(n_chars)).otherwise(F.col("row.n_chars"))}
    left = trimmed.where(~cut | (F.col("n_removed") < F.col("n_words")))
    return left.select(*(changed.get(c, F.col(f"row.{c}")).alias(c) for c in DOCUMENT_COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, edited or not, go. Null and empty texts stay."""
    return decontamination.decontaminate(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences, with their ids. A null or empty text is its end id alone."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", drop_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Models, fingerprints and packing can't be expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written to the shared folder and read again.

    Repeated rows, null keys and empty tables are treated as the stages say;
    columns that ``documents`` has beside its own are left behind. What a
    stage needed, its input included, is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        before = made(spark)
        kept = before[-1:] if number else []
        docs = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"pipeline-{number}")
        docs.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        release(spark, kept + [x for x in made(spark) if x not in before and x != path])
    return docs
