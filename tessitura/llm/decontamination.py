"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Runs of ``SEED_WORDS`` words of the test items are seeds (of a shorter item,
the whole of it). One pass over the documents finds where they occur, counts
in how many documents each does, and keeps the words around a place if those
have enough words of the item to reach the threshold in any order. Item and
words around are then aligned, so edited copies score too.

Rarity thus saves work but loses nothing: a seed that is in most documents
leaves a row only where the rest of the item may be near, so boilerplate that
items share with many documents makes no pairs; and a copy whose only seeds
are common is found like any other. ``rarest`` tells in how many documents
the rarest seed of a place is.

The benchmark's words travel to the tasks with the code. That is bounded by
``BLOCK_WORDS``: a larger benchmark is scanned in blocks of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbers, slices, whole_rows
from .substring import rolled, word_hashes

SEED_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Of the score of an exact copy of the item.
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000

#: Letters in lower case, digits, and bytes of letters outside ASCII; blanks for all else.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: Punctuation outside ASCII that is taken for white space.
_MARKS = "‘’“”„«»‹›–—…¿¡"

def plain(text: str | None) -> bytes:
    """A text in lower case, with blanks for punctuation."""
    text = (text or "").lower()
    if not text.isascii():
        for mark in _MARKS:
            if mark in text:
                text = text.replace(mark, " ")
    return text.encode().translate(_PLAIN)


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, without punctuation."""
    return plain(text).split()


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of two word sequences: score, and first and last but one word in ``words``."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        row, slope = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1) * -GAP
        top, end = 0, 0
        for word in a:
            up = np.maximum(row + GAP, 0)
            up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == word, MATCH, MISMATCH))
            row = np.maximum.accumulate(up + slope) - slope
            k = int(row.argmax())
            if row[k] > top:
                top, end = int(row[k]), k
        return top, end

    score, end = best(item, words)
    if not score:
        return 0, 0, 0
    _, back = best(item[::-1], words[:end][::-1])
    return score, end - back, end


class Items:
    """The items of a block and their seeds; items without a word have none."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.words = [word_hashes(plain(r[1]))[1] for r in rows]
        self.counted = [np.unique(words, return_counts=True) for words in self.words]
        self.seeds = {}  # by words of a seed: distinct values, where their uses start and stop, items, offsets
        for size in range(1, SEED_WORDS + 1):
            chosen = [k for k, words in enumerate(self.words) if min(len(words), SEED_WORDS) == size]
            grams = [rolled(self.words[k], size)[0] for k in chosen]
            if not grams:
                continue
            values = np.concatenate(grams)
            owners = np.repeat(chosen, [len(x) for x in grams])
            offsets = np.concatenate([np.arange(len(x)) for x in grams])
            order = np.argsort(values, kind="stable")
            every, first = np.unique(values[order], return_index=True)
            bits = np.zeros(1 << 20, bool)
            bits[every >> np.uint64(44)] = True
            self.seeds[size] = (every, first, np.append(first[1:], len(order)), owners[order], offsets[order], bits)

    def bound(self, item: int, words: np.ndarray) -> int:
        """No alignment of the item with these words scores more: each of its words that they have is a match."""
        own, need = self.counted[item]
        found, has = np.unique(words, return_counts=True)
        at = np.minimum(np.searchsorted(found, own), len(found) - 1)
        return MATCH * int(np.minimum(need, np.where(found[at] == own, has[at], 0)).sum())


def places(hits: np.ndarray, low: int, high: int, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of a document from ``low`` to ``high`` that hold an item where its seeds (rows of place and offset, sorted by place) say, with slack; and the offsets in each."""
    slack = size // 2 + SEED_WORDS
    begins, stops = np.maximum(low, hits[:, 0] - hits[:, 1] - slack), np.minimum(high, hits[:, 0] - hits[:, 1] + size + slack)
    order = np.argsort(begins, kind="stable")
    reach = np.maximum.accumulate(stops[order])
    fresh = np.flatnonzero(np.concatenate([[True], begins[order][1:] > reach[:-1]]))
    for a, b in zip(fresh.tolist(), [*fresh[1:].tolist(), len(order)], strict=True):
        yield int(begins[order[a]]), int(reach[b - 1]), np.unique(hits[order[a:b], 1])


def scan(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    """Where items' seeds occur, and how often.

    A row with a ``doc_id`` and ``text_key`` is a place: the number of its
    ``item``, the hashes of the words around, from word ``start`` on, and the
    offsets in the item of the ``seeds`` that are there. Places that can't
    reach the threshold are left out. Rows with ``n`` say instead in how many
    documents of a task a seed of an item is: as ``item`` and ``start``.
    """
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "text_key", "item", "start", "words", "seeds", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = {size: np.zeros(len(seeds[0]), np.int64) for size, seeds in items.seeds.items()}
        id_type = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in slices(batches, "text"):
            id_type = batch.schema.field("id").type
            texts = [plain(x) for x in numbers(batch, "text")]
            at, words = word_hashes(b"\n".join(texts))
            begins = np.searchsorted(at, np.cumsum([0, *(len(x) + 1 for x in texts)]))
            del texts, at
            owner = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            keys, texts_of, rows = numbers(batch, "id"), numbers(batch, "text_key"), []
            for size, (every, first, last, owners, offsets, bits) in items.seeds.items():
                grams = rolled(words, size)[0]
                at = np.flatnonzero(bits[grams >> np.uint64(44)])
                at = at[owner[at] == owner[at + size - 1]]
                which = np.minimum(np.searchsorted(every, grams[at]), len(every) - 1)
                right = every[which] == grams[at]
                at, which = at[right], which[right]
                pairs = np.unique(owner[at] * len(every) + which)
                np.add.at(often[size], pairs % len(every), 1)
                uses = last[which] - first[which]
                place = np.repeat(at, uses)
                use = np.repeat(first[which], uses) + np.arange(len(place)) - np.repeat(np.cumsum(uses) - uses, uses)
                found = np.stack([owner[place], owners[use], place, offsets[use]], axis=1)
                found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
                edges = np.flatnonzero((found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])) + 1
                for hits in np.split(found, edges) if len(found) else ():
                    doc, item = int(hits[0, 0]), int(hits[0, 1])
                    length = len(items.words[item])
                    for start, stop, seeds in places(hits[:, 2:], int(begins[doc]), int(begins[doc + 1]), length):
                        around = words[start:stop]
                        if items.bound(item, around) >= threshold * MATCH * length:
                            rows.append((keys[doc], texts_of[doc], item, start - int(begins[doc]), around.tobytes(), seeds, None))
            if rows:
                yield out(rows)
        counted = []
        for size, (_, first, _, owners, offsets, _) in items.seeds.items():
            for g in np.flatnonzero(often[size]).tolist():
                counted.append((None, None, int(owners[first[g]]), int(offsets[first[g]]), None, None, int(often[size][g])))
        if counted:
            yield out(counted)

    return docs.select("id", "text_key", F.col("row.text").alias("text")).mapInArrow(run, f"id {kind}, text_key long, item int, start long, words binary, seeds array<int>, n long")


def aligned(found: DataFrame, items: Items, id_type: str, threshold: float) -> DataFrame:
    """Aligns items with the places that have a seed of theirs; keeps scores of ``threshold`` or more."""
    kind = found.schema["id"].dataType.simpleString()
    names = ["id", "text_key", "item_id", "score", "start", "stop", "n_seeds", "rarest"]
    often = counted_seeds(found, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_key, item, start, words, seeds in zip(*(numbers(batch, x) for x in ("id", "text_key", "item", "start", "words", "seeds")), strict=True):
                own = items.words[item]
                score, a, b = align(own, np.frombuffer(words, np.uint64))
                share = score / (MATCH * len(own))
                if share >= threshold:
                    rows.append((doc, text_key, items.ids[item], round(share, 6), start + a, start + b, len(seeds), int(often[item][seeds].min())))
            if rows:
                types = [batch.schema.field("id").type, pa.int64(), None, pa.float64(), *[pa.int64()] * 4]
                arrays = [pa.array(x, type=t) if t is not None else pa.array(x) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # alignments cost more than their bytes show
    spread = found.where("n IS NULL").repartition(tasks, "id", "text_key", "item", "start")
    return spread.mapInArrow(run, f"id {kind}, text_key long, item_id {id_type}, score double, start long, stop long, n_seeds long, rarest long")


def counted_seeds(found: DataFrame, items: Items) -> list[np.ndarray]:
    """In how many documents each seed of each item is. The driver gets a number for each distinct seed of the block."""
    got = found.where("n IS NOT NULL").groupBy("item", "start").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(zip(got["item"].to_pylist(), got["start"].to_pylist(), strict=True), got["n"].to_pylist(), strict=True))
    often = [np.zeros(max(1, len(words) - SEED_WORDS + 1), np.int64) for words in items.words]
    for _, first, last, owners, offsets, _ in items.seeds.values():
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            n = sums.get((int(owners[a]), int(offsets[a])), 0)
            for k in range(a, b):
                often[owners[k]][offsets[k]] = n
    return often


def alignments(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, text_key, item_id, score, start, stop, n_seeds and rarest of every place of ``docs`` (as ``whole_rows``) that holds an item."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    sized = benchmark.where("item_id IS NOT NULL").select("item_id", "text")
    total = sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / (4 * BLOCK_WORDS)))
    parts = []
    for block in range(blocks):
        own = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else sized
        items = Items(sorted((tuple(r) for r in own.collect()), key=lambda r: (r[0], r[1] or "")))
        parts.append(aligned(materialise(scan(docs, items, threshold), "decontamination"), items, kind, threshold))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold a test item or an edited copy: one row per document and item.

    Returns doc_id, item_id, score (of the best alignment, as a share of an
    exact copy's), start and stop (words of the document), n_seeds and rarest
    (in how many documents the rarest of the place's seeds is).

    Null texts have no words; items without a word or an id match nothing. Of
    an item of fewer than SEED_WORDS words the whole must be found. Equal
    items are items of their own. Rows that repeat a doc_id count as one
    document, and those without one too. Ties go to the earlier place. Extra
    columns are ignored; an empty table on either side gives no rows.
    """
    best = F.max_by(F.struct("score", "start", "stop", "n_seeds", "rarest"), F.struct("score", -F.col("start"))).alias("best")
    found = alignments(whole_rows(docs), benchmark, threshold)
    return found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = SEED_WORDS) -> DataFrame:
    """Documents without those that hold a test item.

    Each row is judged by its own text, whether it has a doc_id, or shares
    one, or not; rows that are equal in both are judged alike. Items of fewer
    than ``least_words`` words remove nothing, as their words come up by
    chance. Null texts stay. Columns may have any names and return as they
    were; an empty table on either side changes nothing.
    """
    rows = whole_rows(docs)
    words = F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"))
    bad = materialise(alignments(rows, benchmark.where(words >= least_words), threshold).select(F.col("id").alias("bad_id"), F.col("text_key").alias("bad_text")).distinct(), "contaminated")
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("text_key") == F.col("bad_text")), "left_anti").select("row.*")
