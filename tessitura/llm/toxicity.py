"""Toxicity by class-conditional Kneser-Ney models of words.

A toxic and an ordinary model give each word of a text a log-likelihood after
the word before it. The conditional order counts pairs of words, discounts
them and gives what is left, after each word before, to the order of words. As
in Kneser and Ney's models a word counts there as often as there are different
words before it in its class, so that what one text repeats is not taken for
evidence. Both classes discount their own counts and give what is left to the
same lowest order: the counts of all labelled text, and a little for words not
seen at all. So expressions that are rare in either class tell little.

Length-normalised differences of log-likelihood describe a text: the mean of
the conditional order over all its words, and that of the order of words over
the ``PASSAGE`` words where they are largest, so a long text isn't acquitted
for its length. A logistic function of the two, fitted on a training fold that
the counts leave out, is the score.

Counts are exact and cover all labelled training rows; they and all that is
derived from them stay tables. The scoring tasks read the differences of all
words, and of what is left after them, from the shared folder: ``SLOTS`` of
them are held at once, and a larger table is read block by block for each slice
of texts. Pairs are too many for that: those of all texts are joined with the
table of pairs, one of ``ROUNDS`` parts of them at a time, so that only a part
lies on disk.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, discard, fold, materialise, numbers, shared_dir, slices
from .decontamination import plain
from .substring import BASE, mix, word_hashes

PASSAGE = 2
#: Words in a block of their table, about.
SLOTS = 1 << 22
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Labelled rows that the weights are fitted on, at most.
FITTED = 5000
#: Parts of all word pairs, by their hash, that are counted and looked up one after the other.
ROUNDS = 7
#: Parts of one in which what pairs add is summed, so that sums don't depend on their order.
UNIT = 1 << 24
CLASSES = ("toxic", "ordinary")
#: Weights of (passage, conditional, 1) where the calibration fold can't tell.
DEFAULT = (3.0, 0.0, -8.0)
#: What a word that wasn't seen counts in the lowest order; a word before the first one of a text.
UNSEEN, START = 0.01, 7
_SCATTER = np.uint64(0x9E3779B97F4A7C15)
#: Signs that are words of their own, for they are written without blanks.
_ALONE = re.compile("([\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])")


def prepared(text: str | None) -> bytes:
    """A text's words between blanks; case and punctuation don't count."""
    return plain(text if text is None or text.isascii() else _ALONE.sub(r" \1 ", text))


def hashed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all parts as hashes, and where each part's begin, with their end at last."""
    at, words = word_hashes(b"\n".join(parts))
    return words, np.searchsorted(at, np.cumsum([0, *(len(x) + 1 for x in parts)]))


def deflated(docs: DataFrame) -> DataFrame:
    """doc_id and the text's words as deflated bytes: they take two thirds of the room that a shuffle's own compression leaves."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([zlib.compress(prepared(x), 1) for x in numbers(batch, "text")], pa.binary())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text binary")


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries in here go as each query ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def preceding(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The word before each word."""
    before = np.concatenate([[np.uint64(START)], words[:-1]]) if len(words) else words
    before[begins[:-1][np.diff(begins) > 0]] = START
    return before


def paired(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Pairs of words as hashes."""
    return mix(words * np.uint64(BASE) + before)


def pairs(labelled: DataFrame, part: int) -> DataFrame:
    """word, before, toxic, ordinary: how often a word comes after another in the texts (deflated) of each class, for the pairs of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES // 4):
            words, begins = hashed([zlib.decompress(x) for x in numbers(batch, "text")])
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool), np.diff(begins))
            before = preceding(words, begins)
            key = paired(words, before)
            own = np.flatnonzero(key % np.uint64(ROUNDS) == part)
            _, first, n = np.unique(key[own] ^ (toxic[own] * _SCATTER), return_index=True, return_counts=True)
            first = own[first]
            arrays = [pa.array(x[first].view(np.int64)) for x in (words, before)] + [pa.array(np.where(toxic[first] == k, n, 0).astype(np.int32)) for k in (True, False)]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "before", *CLASSES])

    found = labelled.select("text", "toxic").mapInArrow(run, "word long, before long, toxic int, ordinary int")
    return found.groupBy("word", "before").agg(*(F.sum(c).alias(c) for c in CLASSES))


def counts(pairs: DataFrame) -> DataFrame:
    """What the models need of every word.

    word; toxic, ordinary, every: how many different words come before it in
    each class, and in both; for each class c, c_after: how many different
    words come after it; c_times: how often one does; c_once, c_twice: how many
    do once, and twice. The place before a text is a word that none comes before.
    """
    seen = {c: (F.col(c) > 0).cast("int") for c in CLASSES}
    none = F.lit(0)
    as_word = {**seen, "every": F.lit(1)}
    as_context = {}
    for c in CLASSES:
        as_context |= {f"{c}_after": seen[c], f"{c}_times": F.col(c), f"{c}_once": (F.col(c) == 1).cast("int"), f"{c}_twice": (F.col(c) == 2).cast("int")}
    names = [*as_word, *as_context]
    row = lambda key, given: F.struct(F.col(key).alias("word"), *(given.get(c, none).cast("long").alias(c) for c in names))
    rows = pairs.select(F.explode(F.array(row("word", as_word), row("before", as_context))).alias("row")).select("row.*")
    return rows.groupBy("word").agg(*(F.sum(c).alias(c) for c in names))


class Lookup:
    """Keys to differences by a hash table of numpy arrays; where a key is unknown, the fallback holds."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        table_keys = np.full(1 << self.bits, -1, np.int64)
        table_values = np.zeros(1 << self.bits, np.float32)
        keys, values = keys[keys != -1], values[keys != -1]  # -1 marks an empty place
        at = self._at(keys)
        table_keys[at], table_values[at] = keys, values
        lost = table_keys[at] != keys  # a few more share a place here: they are searched for
        self.keys, self.values = table_keys, table_values
        self.more, self.more_values = keys[lost], values[lost]

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SCATTER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where there are any."""
        at = self._at(keys)
        known = (self.keys[at] == keys) & (keys != -1)
        out = np.where(known, self.values[at], np.float32(0))
        if len(self.more):
            rest = np.flatnonzero(~known & (self.keys[at] != -1))
            where = np.minimum(np.searchsorted(self.more, keys[rest]), len(self.more) - 1)
            hit = self.more[where] == keys[rest]
            out[rest[hit]], known[rest[hit]] = self.more_values[where[hit]], True
        return out, known


class Blocks:
    """A table of key and difference in the shared folder, in blocks that hold ``slots`` keys each, about."""

    PRIME = 1_000_003

    def __init__(self, table: DataFrame, slots: int):
        self.blocks = max(1, -(-table.count() // slots))
        self.path = shared_dir(table.sparkSession, "differences")
        rows = table.select("key", F.col("difference").cast("float").alias("difference"), F.pmod(F.pmod("key", F.lit(self.PRIME)), F.lit(self.blocks)).alias("block"))
        rows.repartition("block").sortWithinPartitions("block", "key").write.partitionBy("block").parquet(self.path)
        self.whole: Lookup | None = None

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, and their differences."""
        store, root = pafs.FileSystem.from_uri(f"{self.path}/block={block}")
        if store.get_file_info(root).type == pafs.FileType.NotFound:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        got = pq.read_table(root, filesystem=store, columns=["key", "difference"])
        keys, values = got["key"].to_numpy(), got["difference"].to_numpy()
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where there are any."""
        if self.blocks == 1:
            if self.whole is None:
                self.whole = Lookup(*self.read(0))
            return self.whole.find(keys)
        wanted, inverse = np.unique(keys, return_inverse=True)
        out, known = np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
        block = wanted % self.PRIME % self.blocks
        for k in np.unique(block).tolist():
            at = np.flatnonzero(block == k)
            own, values = self.read(k)
            if len(own):
                where = np.minimum(np.searchsorted(own, wanted[at]), len(own) - 1)
                hit = own[where] == wanted[at]
                out[at[hit]], known[at[hit]] = values[where[hit]], True
        return out[inverse], known[inverse]


class Model:
    """Differences of log-likelihood, toxic less ordinary: of known words, of all others, and of what is left after a word."""

    def __init__(self, words: Blocks, contexts: Blocks, unseen: float, classes: bool):
        self.words, self.contexts, self.unseen = words, contexts, unseen
        self.classes = classes  # whether both were seen

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean difference over its PASSAGE most toxic words, and over all of them; 0 without a word."""
        return self.described(texts)[:2]

    def described(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features, the sum of the conditional differences of a text if none of its pairs were known, and its number of words."""
        words, begins = hashed([prepared(x) for x in texts])
        n = np.diff(begins)
        passage, whole, unpaired = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        some = np.flatnonzero(n)
        if not len(some):
            return passage, whole, unpaired, n
        value, known = self.words.find(words.view(np.int64))
        value = np.where(known, value, self.unseen).astype(np.float64)
        whole[some] = np.add.reduceat(value, begins[some]) / n[some]
        falling = value[np.lexsort((-value, np.repeat(np.arange(len(texts)), n)))]
        sums = np.concatenate([[0], np.cumsum(falling)])
        most = np.minimum(n, PASSAGE)[some]
        passage[some] = (sums[begins[some] + most] - sums[begins[some]]) / most
        left, _ = self.contexts.find(preceding(words, begins).view(np.int64))
        unpaired[some] = np.add.reduceat(value + left, begins[some])
        return passage, whole, unpaired, n


def train(labelled: DataFrame) -> Model:
    """A model of rows with ``text`` (deflated) and ``toxic`` (0 or 1)."""
    return trained(labelled)[0]


def trained(labelled: DataFrame) -> tuple[Model, list[DataFrame]]:
    """The model, and what its pairs add to conditional differences by part: key, added (in UNITs)."""
    with tidied(labelled.sparkSession):
        found = [materialise(pairs(labelled, k), "pairs") for k in range(ROUNDS)]
        types = materialise(counts(reduce(DataFrame.union, found)), "words")
        sums = types.agg(
            F.sum("every").alias("every"),
            F.count_if(F.col("every") > 0).alias("words"),
            *(F.sum(c).alias(c) for c in CLASSES),
            *(F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in CLASSES for k in (1, 2)),
            *(F.count_if(F.col(c) > 0).alias(f"{c}_words") for c in CLASSES),
            *(F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in CLASSES for k in ("once", "twice")),
        ).first()
        lowest = (F.col("every") + UNSEEN) / ((sums["every"] or 0) + UNSEEN * (sums["words"] + 1))
        left, p, discount, after = {}, {}, {}, {}
        for c in CLASSES:
            total, d = max(sums[c] or 0, 1), discounted(sums[f"{c}_1"], sums[f"{c}_2"])
            left[c] = d * sums[f"{c}_words"] / total if sums[f"{c}_words"] else 1.0
            p[c] = F.greatest(F.col(c) - d, F.lit(0.0)) / total + left[c] * lowest
            discount[c] = discounted(sums[f"{c}_once"], sums[f"{c}_twice"])
            after[c] = F.when(F.col(f"{c}_after") > 0, discount[c] * F.col(f"{c}_after") / F.col(f"{c}_times")).otherwise(1.0)
        differences = types.where("every > 0").select(F.col("word").alias("key"), F.log(p["toxic"] / p["ordinary"]).alias("difference"))
        contexts = types.where("toxic_after + ordinary_after > 0").select(F.col("word").alias("key"), F.log(after["toxic"] / after["ordinary"]).alias("difference"))
        model = Model(Blocks(differences, SLOTS), Blocks(contexts, SLOTS), float(np.log(left["toxic"] / left["ordinary"])), bool(sums["toxic"] and sums["ordinary"]))
        words = types.where("every > 0").select("word", *(p[c].alias(f"{c}_p") for c in CLASSES))
        lefts = types.where("toxic_after + ordinary_after > 0").select(F.col("word").alias("before"), *(f"{c}_after" for c in CLASSES))
        added = []
        for part in found:
            # shuffled at every size, as words grow with the input; pairs and occurrences aren't sorted for it
            joined = part.join(words.hint("shuffle_hash"), "word").join(lefts.hint("shuffle_hash"), "before")
            gain = {c: F.when(F.col(c) > 0, F.log1p((F.col(c) - discount[c]) / (discount[c] * F.col(f"{c}_after") * F.col(f"{c}_p")))).otherwise(0.0) for c in CLASSES}
            added.append(materialise(keyed(joined.select("word", "before", F.round((gain["toxic"] - gain["ordinary"]) * UNIT).cast("long").alias("added"))), "added"))
            discard(part)
    discard(types)
    return model, added


def discounted(once: int | None, twice: int | None) -> float:
    """What Kneser and Ney take off each count."""
    return once / (once + 2 * twice) if once and twice else 0.5


def keyed(found: DataFrame) -> DataFrame:
    """key and added, of word, before and added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, before = (batch.column(c).to_numpy().view(np.uint64) for c in ("word", "before"))
            yield pa.RecordBatch.from_arrays([pa.array(paired(words, before).view(np.int64)), batch.column("added")], names=["key", "added"])

    return found.mapInArrow(run, "key long, added long")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a hash of both: rows that share it have the same features."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def describe(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row, words, and of every whole text: passage, whole and unpaired (``Model.described``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            passage, whole, unpaired, n = sent.value.described(numbers(batch, "text"))
            arrays = [batch.column("doc_id"), batch.column("row"), pa.array(n.astype(np.int64)), pa.array(passage), pa.array(whole), pa.array(unpaired)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "words", "passage", "whole", "unpaired"])

    return identified(docs).mapInArrow(run, f"doc_id {kind}, row long, words long, passage double, whole double, unpaired double")


def occurring(docs: DataFrame, part: int) -> DataFrame:
    """row, key, n: how often each text has each word pair of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, begins = hashed([prepared(x) for x in numbers(batch, "text")])
            key = paired(words, preceding(words, begins))
            own = np.flatnonzero(key % np.uint64(ROUNDS) == part)
            row = np.repeat(batch.column("row").to_numpy(), np.diff(begins))[own]
            at = np.repeat(np.arange(len(begins) - 1, dtype=np.uint64), np.diff(begins))[own]
            _, first, n = np.unique(key[own] ^ mix((at + np.uint64(1)) * _SCATTER), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(key[own[first]].view(np.int64)), pa.array(n.astype(np.int32))], names=["row", "key", "n"])

    return identified(docs).mapInArrow(run, "row long, key long, n int")


def conditional(docs: DataFrame, found: DataFrame, added: list[DataFrame]) -> DataFrame:
    """doc_id, passage, whole, and conditional: the mean conditional difference over all words of every whole text, 0 without a word."""
    sums = []
    with tidied(docs.sparkSession):
        for part, known in enumerate(added):
            joined = occurring(docs, part).join(known.hint("shuffle_hash"), "key")
            sums.append(materialise(joined.groupBy("row").agg(F.sum(F.col("n") * F.col("added")).alias("added")), "sums"))
            discard(known)
        rows = found.withColumn("copies", F.lit(1)).unionByName(reduce(DataFrame.union, sums), allowMissingColumns=True)
        # rows of one hash are the same: each has added the same
        whole = rows.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "words", "passage", "whole", "unpaired")), F.sum("copies").alias("copies"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"))
        mean = F.when(F.col("words") > 0, (F.col("unpaired") + F.col("added") / F.col("copies") / UNIT) / F.col("words")).otherwise(0.0)
        whole = whole.select("doc_id", "passage", "whole", mean.alias("conditional"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
        out = materialise(whole, "toxicity")
    for x in (found, *sums):
        discard(x)
    return out


def calibrate(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Weights of a logistic function of (passage, conditional, 1), by Newton's method with a small ridge on both in units of their spread."""
    y = np.array([r[2] for r in rows], dtype=np.float64)
    if len(y) < 4 or not 0 < y.sum() < len(y):
        return DEFAULT
    x = np.array([[r[0], r[1], 1.0] for r in rows])
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    middle[2], spread[2] = 0, 1
    z, w, ridge = (x - middle) / spread, np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + ridge + np.eye(3) * 1e-9, z.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    w = w / spread
    return float(w[0]), float(w[1]), float(w[2] - w @ middle)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every document; learns from labels outside the held-out fold.

    Returns doc_id, held_out, score, predicted, passage, whole and conditional. A null text
    counts as empty. If rows of labels repeat a doc_id, one with 1 wins; null
    labels and keys teach nothing; a document without a key isn't held out.
    Where either class has no labelled training row, or none that meets a
    document with a word, scores are 0. Extra columns are ignored; an empty
    table gives no rows.
    """
    part = fold("doc_id", FOLDS)
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("part", part).where(F.col("part") != HELD_OUT)
    texts = docs.select("doc_id", "text").where((part != HELD_OUT) & (part != CALIBRATION) & F.col("text").isNotNull())
    # merged at every size: the labels grow with the input, so a broadcast would only do for small ones
    with tidied(docs.sparkSession):
        labelled = materialise(deflated(texts).join(marks.where(F.col("part") != CALIBRATION).hint("merge"), "doc_id").select("text", "toxic"), "labelled")
    model, added = trained(labelled)
    discard(labelled)
    if not model.classes:
        none = F.lit(0.0)
        found = docs.select("doc_id", *(none.alias(c) for c in ("passage", "whole", "conditional", "score")))
    else:
        found = conditional(docs, materialise(describe(docs, model), "words"), added)
        rows = found.join(marks.where(F.col("part") == CALIBRATION), "doc_id")
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "passage").limit(FITTED).select("passage", "conditional", "toxic").collect()
        a, b, c = calibrate([tuple(r) for r in rows])
        found = found.withColumn("score", 1 / (1 + F.exp(-(F.col("passage") * a + F.col("conditional") * b + c))))
    return found.select(
        "doc_id",
        F.coalesce(part == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "passage",
        "whole",
        "conditional",
    )
