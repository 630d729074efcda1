"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary n-gram classifier
(multinomial naive Bayes over hashed byte n-grams) tells the languages with a
1 from those with a 0. A text's margins are decoded by the sum of each bit's
logistic loss, weighted by how well the bit separates its two sides; the
nearest codeword wins, and a text is ambiguous if the runner-up is about as
near.

Counts are taken over all labelled training rows, whole texts, and summed by
bin and bit in Spark. The model has ``BINS`` weights for each bit, so it is
bounded by the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, slices, whole_rows

BINS = 1 << 14
ORDERS = (2, 3, 4)
#: Bytes that are scored at once.
CHUNK = 1 << 19
#: Margins count as the mean evidence of an n-gram times this, or times the n-grams if fewer.
EVIDENCE = 60
#: A text is ambiguous if the best score leads the next by less.
AMBIGUOUS = 0.2
#: More languages than that are taken for an error in the column.
MOST_LANGUAGES = 2000
UNKNOWN = "und"
HELD_OUT, FOLDS = 2, 4


def codewords(count: int) -> np.ndarray:
    """A code of ``count`` words of -1 and 1: exhaustive up to 6 languages, else the best of some random codes."""
    if count < 2:
        return np.zeros((count, 0), np.int64)
    if count <= 6:
        columns = np.arange(1, 1 << (count - 1))
        bits = (columns[None, :] >> np.arange(count - 1)[:, None]) & 1
        return np.concatenate([np.zeros((1, len(columns)), np.int64), bits]) * 2 - 1
    length, rng, best, found = int(np.ceil(10 * np.log2(count))), np.random.default_rng(7), -1, None
    for _ in range(20):
        code = rng.integers(0, 2, (count, length)) * 2 - 1
        code = code[:, np.abs(code.sum(axis=0)) < count]
        distance = (code.shape[1] - code @ code.T) / 2 + np.eye(count) * length
        if distance.min() > best:
            best, found = distance.min(), code
    return found


def features(data: np.ndarray, order: int) -> np.ndarray:
    """Bins of the n-grams that start at each byte (the last ones left out)."""
    n = len(data) - order + 1
    value = np.full(max(n, 0), order, np.uint32)
    for k in range(order if n > 0 else 0):
        value = value * np.uint32(0x01000193) + data[k : k + n]
    value *= np.uint32(0x9E3779B1)
    return (value >> np.uint32(18)).astype(np.int64)


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Joined lower-case texts in chunks: bytes, first byte of each text's part, number of its text. A part of a long text overlaps the next by what n-grams need."""
    parts, owners, size = [], [], 0
    for k, text in enumerate(texts):
        text = b" " + text.lower() + b" "
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK + max(ORDERS) - 1]
            if size + len(part) > CHUNK and parts:
                yield _joined(parts, owners)
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(k)
            size += len(part)
    if parts:
        yield _joined(parts, owners)


def _joined(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, np.array(owners)


def _inside(n: int, starts: np.ndarray, order: int) -> np.ndarray:
    """Which n-grams lie within one part."""
    good = np.ones(max(0, n - order + 1), bool)
    for k in range(1, order):
        at = starts[1:] - k
        good[at[(at >= 0) & (at < len(good))]] = False
    return good


def counts(docs: DataFrame) -> DataFrame:
    """lang, bin, n: how often each bin's n-grams occur in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            langs = batch.column("lang").to_pylist()
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                total = sums.setdefault(lang, np.zeros(BINS, np.int64))
                for data, starts, _ in chunks(texts):
                    for order in ORDERS:
                        total += np.bincount(features(data, order)[_inside(len(data), starts, order)], minlength=BINS)
        for lang, total in sums.items():
            bins = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins.astype(np.int32)), pa.array(total[bins])], names=["lang", "bin", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their code, and the bits' weights, from each bin's count and the part of it on each bit's upper side."""

    def __init__(self, languages: list[str], code: np.ndarray, upper: np.ndarray, total: np.ndarray):
        self.languages, self.code = languages, code
        bits = code.shape[1]
        self.weights, self.trust = np.zeros((BINS, bits), np.float32), np.zeros(bits)
        for b in range(bits):
            low, high = (x / x.sum() for x in (total - upper[:, b] + 0.5, upper[:, b] + 0.5))
            ratio = np.log(high / low)
            self.weights[:, b] = ratio
            self.trust[b] = (high - low) @ ratio
        if bits:
            self.trust /= self.trust.sum() or 1

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """For each text the languages' scores, which sum to 1."""
        bits = self.code.shape[1]
        sums, seen = np.zeros((len(texts), bits)), np.zeros(len(texts))
        for data, starts, owners in chunks(texts):
            for order in ORDERS:
                good = _inside(len(data), starts, order)
                if not len(good):
                    continue
                at = np.minimum(starts, len(good) - 1)
                took = np.add.reduceat(self.weights[features(data, order)] * good[:, None], at, axis=0)
                number = np.add.reduceat(good, at, dtype=np.int64)
                took[starts >= len(good)] = 0
                number[starts >= len(good)] = 0
                np.add.at(sums, owners, took)
                np.add.at(seen, owners, number)
        margins = sums / np.maximum(seen, 1)[:, None] * np.minimum(seen, EVIDENCE)[:, None]
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return near / near.sum(axis=1, keepdims=True)


def by_side(found: DataFrame, languages: list[str], code: np.ndarray) -> DataFrame:
    """bin, total and upper: a bin's count over all languages, and for each bit over those with a 1."""
    places = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = (code > 0).astype(np.float64)
        total, upper = np.zeros(BINS), np.zeros((BINS, code.shape[1]))
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            lang = np.array([places[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
            bins, n = batch.column("bin").to_numpy(), batch.column("n").to_numpy()
            np.add.at(total, bins, n)
            np.add.at(upper, bins, above[lang] * n[:, None])
        seen = np.flatnonzero(total)
        ends = pa.array(np.arange(len(seen) + 1, dtype=np.int32) * code.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen]), pa.ListArray.from_arrays(ends, pa.array(upper[seen].ravel()))], names=["bin", "total", "upper"])

    return found.repartition("bin").mapInArrow(run, "bin int, total double, upper array<double>")


def train(docs: DataFrame) -> Model:
    """Learns from the rows that have a text and a language.

    Counts of a language stay in Spark: the driver gets a row for each bin,
    with a number for each bit of the code (some 110 for 2000 languages).
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    code = codewords(len(languages))
    total, upper = np.zeros(BINS), np.zeros((BINS, code.shape[1]))
    if code.shape[1]:
        got = by_side(counts(rows), languages, code).toArrow()
        bins = got["bin"].to_numpy()
        total[bins] = got["total"].to_numpy()
        upper[bins] = got["upper"].combine_chunks().flatten().to_numpy().reshape(len(bins), -1) if len(bins) else 0
    return Model(languages, code, upper, total)


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred, score, runner_up and ambiguous to the columns ``carry``; looks at the text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing was learned. Repeated rows and null keys are like any
    other; ties go to the language that sorts first.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    results = StructType.fromDDL("lang_pred string, score double, runner_up string, ambiguous boolean")
    schema = StructType([*(docs.schema[c] for c in carry), *results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            lettered = np.array([x is not None and any(map(str.isalpha, x)) for x in texts], bool)
            usable = np.flatnonzero(lettered) if own.languages else np.zeros(0, np.int64)
            names, score, second, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts), [False] * len(texts)
            got = own.scores([texts[k].encode() for k in usable]) if len(usable) else []
            for k, row in zip(usable.tolist(), got, strict=True):
                order = np.argsort(-row, kind="stable")
                names[k], score[k] = own.languages[order[0]], min(1.0, float(row[order[0]]))
                if len(order) > 1:
                    second[k], close[k] = own.languages[order[1]], bool(row[order[0]] - row[order[1]] < AMBIGUOUS)
            arrays = [batch.column(c) for c in carry] + [pa.array(names, pa.string()), pa.array(score), pa.array(second, pa.string()), pa.array(close, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, "lang_pred", "score", "runner_up", "ambiguous"])

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from all but the held-out fold of the keys and predicts every row.

    Returns doc_id, held_out, lang_pred, score, ambiguous and runner_up. Rows
    without a key aren't held out and aren't learned from.
    """
    part = fold("doc_id", FOLDS)
    model = train(docs.where(part != HELD_OUT))
    return predict(docs, model).select(
        "doc_id", F.coalesce(part == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous", "runner_up"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents without those whose language is unknown or ambiguous.

    Null, empty and letterless texts are unknown, so they go. Rows without a
    key are judged like others; repeated rows are judged alike. Columns may
    have any names and return as they were; an empty table gives no rows.
    """
    model = train(docs.where(fold("doc_id", FOLDS) != HELD_OUT))
    rows = whole_rows(docs).select("row", F.col("row.text").alias("text"))
    return predict(rows, model, ("row",)).where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("row.*")
