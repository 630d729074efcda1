"""Exact repeats of word sequences, by seed and extend.

A window is ``least`` consecutive words of one document. Its seed is the run
of ``SEED_WORDS`` words in it whose hash is smallest (winnowing), so equal
windows have equal seeds in the same place. Each occurrence of a seed carries
the hashes of the windows that it is the seed of: they extend it both ways.
Occurrences are joined on their seed, and a window repeats where another
occurrence of its seed has it too. Neighbouring windows that repeat make up a
maximal repeat.

Only hashes are shuffled for the join, about one row for each
``(least - SEED_WORDS + 2) / 2`` words. Of windows that occur several times in
a slice of texts only the first is sent, for that they repeat is known at
once; so a passage in a third of all documents costs a row a slice. Seeds that
are frequent although their windows differ are counted beforehand over all
texts, in summaries of bounded size that miss none above a fixed share: their
windows are dealt out one by one by their own hash, so no task gets them all.
Neither changes a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise, slices

LEAST = 35
SEED_WORDS = 12
#: Bytes whose words are hashed together.
BLOCK = 1 << 20
#: Bytes of a window's hash that travel with its seed, of which it is given 64 bits more.
KEPT = 5
#: Seeds with over 1 / SHARE of all occurrences are hot. A task's summary of its seeds has COUNTERS of them at most, so it
#: knows each to within 1 / COUNTERS of its occurrences, and no hot seed is missed.
SHARE, COUNTERS = 10_000, 40_000
#: Rows of whole seeds that are compared at once, about.
COMPARED = 150_000
BASE = 0xD1342543DE82EF95
_INVERSE = pow(BASE, -1, 1 << 64)

_powers = {BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        factors = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.cumprod(factors)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its 64-bit hash; words are what ASCII white space divides."""
    places, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        part = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)
        space = _SPACE[part]
        if at + len(part) < len(data):  # a word goes on: it belongs to the next part, or to this one if it is all there is
            ends = np.flatnonzero(space)
            size = int(ends[-1]) + 1 if len(ends) else re.compile(rb"[\x20\x09-\x0D]|\Z").search(data, at).end() - at
            part = np.frombuffer(data, np.uint8, size, at)
            space = _SPACE[part]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(part)), out=sums[1:])
        hashes.append(mix((sums[stops] - sums[starts]) * _power(_INVERSE, len(part))[starts]))
        places.append(starts + at)
        at += len(part)
    return np.concatenate(places), np.concatenate(hashes)


def rolled(words: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of all runs of so many words, for each size."""
    n = len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _power(BASE, n), out=sums[1:])
    back = _power(_INVERSE, n)
    return [mix((sums[k:] - sums[:-k]) * back[: n - k + 1]) if n >= k else np.zeros(0, np.uint64) for k in sizes]


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest value of each ``width`` in a row."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        span += step
    return at


class Windows:
    """The windows of some texts: ``owner`` (number of the text), ``origin`` (first word), ``hashes``, and the seed's hash and place in each."""

    def __init__(self, texts: list[bytes], least: int, seed_words: int):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(lengths)
        places, words = word_hashes(b"\n".join(texts))
        before = np.searchsorted(places, np.concatenate([[0], ends]))
        sizes = np.diff(before)
        long = np.flatnonzero(sizes >= least)
        if not len(long):
            self.owner = self.origin = self.place = np.zeros(0, np.int64)
            self.hashes = self.seed = np.zeros(0, np.uint64)
            return
        grams, windows = rolled(words, seed_words, least)
        place = smallest(grams, least - seed_words + 1)
        count = sizes[long] - least + 1
        self.owner = np.repeat(long, count)
        self.origin = np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count)
        starts = self.origin + before[self.owner]
        self.hashes, self.place = windows[starts], place[starts] - starts
        self.seed = grams[place[starts]]

    @cached_property
    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Which windows occur several times here, and which are all but one of their kind."""
        order = np.argsort(self.hashes)
        sorted_ = self.hashes[order]
        same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
        several, others = np.zeros(len(order), bool), np.zeros(len(order), bool)
        others[order[same + 1]] = True
        several[order[same + 1]] = several[order[same]] = True
        return several, others

    def starts(self, chosen: np.ndarray, *changes: np.ndarray) -> np.ndarray:
        """Where runs of chosen windows in a row begin, which end also where one of ``changes`` does."""
        apart = (self.origin[chosen][1:] != self.origin[chosen][:-1] + 1) | (self.owner[chosen][1:] != self.owner[chosen][:-1])
        for x in changes:
            apart |= x[1:] != x[:-1]
        return np.flatnonzero(np.concatenate([[True], apart])) if len(chosen) else np.zeros(0, np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows that repeat here: number of the text, first window, windows."""
        chosen = np.flatnonzero(self.repeated[0])
        first = self.starts(chosen)
        return self.owner[chosen][first], self.origin[chosen][first], np.diff(np.append(first, len(chosen)))

    def occurrences(self, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Occurrences of seeds, later ones of a window left out: number of the text, seed, first window * 64 + the seed's place in it, windows, their hashes.

        A hot seed gives an occurrence for each window, with the window's hash as its seed.
        """
        chosen = np.flatnonzero(~self.repeated[1])
        alone = np.isin(self.seed[chosen], hot) if len(hot) else np.zeros(len(chosen), bool)
        seed = np.where(alone, self.hashes[chosen], self.seed[chosen])
        at = self.origin + self.place
        # windows of a hot seed are apart from their neighbours, whatever their seeds
        number = np.where(alone, np.arange(len(chosen)), -1)
        first = self.starts(chosen, at[chosen], seed, number)
        return self.owner[chosen][first], seed[first], self.origin[chosen][first] * 64 + self.place[chosen][first], np.diff(np.append(first, len(chosen))), self.hashes[chosen]


def occurrences(docs: DataFrame, least: int = LEAST, seed_words: int = SEED_WORDS, hot: np.ndarray | None = None) -> DataFrame:
    """seed, _key (of the row), place and the windows' hashes of every occurrence of a seed.

    Where ``windows`` is null the row says instead that ``n`` windows from
    ``place`` on repeat; its ``seed`` only spreads such rows.
    """
    known = np.zeros(0, np.uint64) if hot is None else hot
    names = ["seed", "_key", "place", "n", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = Windows([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], least, seed_words)
            if not len(found.seed):
                continue
            keys = batch.column("_key").to_numpy()
            owner, seed, place, count, hashes = found.occurrences(known)
            data = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT])
            ends = np.concatenate([[0], np.cumsum(count * KEPT)]).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(keys[owner]), pa.array(place), pa.array(count), blobs], names=names)
            owner, first, count = found.runs()
            if len(owner):
                spread = mix((keys[owner] + first).view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(keys[owner]), pa.array(first), pa.array(count), pa.nulls(len(owner), pa.binary())], names=names)

    return docs.select("_key", "text").mapInArrow(run, "seed long, _key long, place long, n long, windows binary")


class Summary:
    """Counts of the most frequent values, each too low by at most 1 / ``size`` of all that was added (Misra and Gries)."""

    def __init__(self, size: int):
        self.size, self.values, self.counts, self.total = size, np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.total += int(counts.sum())
        self.values, index = np.unique(np.concatenate([self.values, values]), return_inverse=True)
        summed = np.zeros(len(self.values), np.int64)
        np.add.at(summed, index, np.concatenate([self.counts, counts]))
        if len(summed) > self.size:
            summed -= np.partition(summed, -self.size - 1)[-self.size - 1]
            self.values, summed = self.values[summed > 0], summed[summed > 0]
        self.counts = summed


def hot_seeds(docs: DataFrame, least: int = LEAST, seed_words: int = SEED_WORDS, share: int = SHARE, counters: int = COUNTERS) -> np.ndarray:
    """All seeds with over 1 / ``share`` of the occurrences and one more a task, and maybe some with little less.

    Counted over all texts. Each task returns a summary of ``counters`` rows
    at most, without those that are once in its texts or at most as often as
    its counts may be wrong. Fewer than ``share * counters / (counters - 2 *
    share)`` seeds can have as much as is asked for, so the list is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(counters)
        for batch in slices(batches, "text"):
            found = Windows([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], least, seed_words)
            if len(found.seed):
                summary.add(*np.unique(found.occurrences(np.zeros(0, np.uint64))[1].view(np.int64), return_counts=True))
        if summary.total:
            often = summary.counts > max(1, summary.total // counters)
            values, counts = pa.array([None, *summary.values[often].tolist()], pa.int64()), pa.array([summary.total, *summary.counts[often].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([values, counts], names=["seed", "n"])

    counted = materialise(docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")), "seeds")
    total = counted.where("seed IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least_count = total / share - 2 * total / counters
    got = counted.where(F.col("seed").isNotNull() & (F.col("n") > least_count)).select("seed").toArrow()["seed"].to_numpy()
    return np.sort(got.view(np.uint64))


def compare(seed: np.ndarray, place: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of repeating windows among occurrences of whole seeds, which come sorted: (occurrence, first window, windows)."""
    count = sizes // KEPT
    wide = np.zeros((int(count.sum()), 8), np.uint8)
    wide[:, :KEPT] = data.reshape(-1, KEPT)
    row = np.repeat(np.arange(len(seed)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    before = (place[row] & 63) - k  # words of the window before its seed
    value = mix(wide.view("<u8")[:, 0].astype(np.uint64) | (before.astype(np.uint64) << np.uint64(8 * KEPT)))
    value = mix(value + seed.view(np.uint64)[row] * np.uint64(BASE))
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    repeats = np.zeros(len(value), bool)
    repeats[order[1:][same]] = True
    repeats[order[:-1][same]] = True
    starts = repeats.copy()
    starts[1:] &= ~repeats[:-1] | (row[1:] != row[:-1])
    at = np.flatnonzero(starts)
    length = np.add.reduceat(repeats, at, dtype=np.int64) if len(at) else at
    return row[at], (place[row[at]] >> 6) + k[at], length


def repeats(docs: DataFrame, least: int = LEAST, seed_words: int = SEED_WORDS) -> DataFrame:
    """The repeating windows of each row: _key, runs (a set of start and n; runs may overlap)."""
    found = occurrences(docs, least, seed_words, hot_seeds(docs, least, seed_words))
    names = ["_key", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []  # rows of seeds that are complete
        last: list[pa.RecordBatch] = []  # rows of the seed that came last

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(done)
            done.clear()
            known = table.filter(pc.is_null(table["windows"]))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known["_key"].combine_chunks(), known["place"].combine_chunks().cast(pa.int32()), known["n"].combine_chunks().cast(pa.int32())], names=names)
            table = table.filter(pc.is_valid(table["windows"]))
            seed = table["seed"].to_numpy()
            same = seed[1:] == seed[:-1]
            several = np.zeros(len(seed), bool)
            several[1:] |= same
            several[:-1] |= same
            part = table.filter(pa.array(several))
            if not part.num_rows:
                return
            blobs = pa.concat_arrays(part["windows"].chunks)
            ends = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4)
            data = np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            row, start, n = compare(part["seed"].to_numpy(), part["place"].to_numpy(), np.diff(ends), data)
            yield pa.RecordBatch.from_arrays([pa.array(part["_key"].to_numpy()[row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            seed = batch.column("seed").to_numpy()
            if last and last[-1].column("seed")[0].as_py() == seed[0] == seed[-1]:
                last.append(batch)
                continue
            cut = int(np.searchsorted(seed, seed[-1]))
            done += [*last, batch.slice(0, cut)]
            last = [batch.slice(cut)]
            if sum(x.num_rows for x in done) >= COMPARED:
                yield from out()
        done += last
        if done:
            yield from out()

    runs = found.repartition("seed").sortWithinPartitions("seed").mapInArrow(run, "_key long, start int, n int")
    # a set: rows that are equal in id and text have one key, and tell the same runs
    return runs.groupBy("_key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def remove_repeats(docs: DataFrame, least: int = LEAST, seed_words: int = SEED_WORDS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Removes every word that a repeating window covers.

    Returns the columns ``carry``, n_words, n_removed, kept (the words that
    are left, joined by one space) and spans (the maximal repeats, as first
    word and the word after the last).

    Windows are judged on the input: all occurrences of a repeat go. Words are
    what ASCII white space divides, unchanged. Null texts have no words;
    repeated rows are copies of each other; null keys are allowed; other
    columns, whatever their names, are only carried where asked for, and what
    is carried can't be called like a result (put it into a struct). An empty
    table gives no rows.
    """
    if set(carry) & {"n_words", "n_removed", "kept", "spans", "runs", "_key"}:
        raise ValueError("a carried column is called like one of the results")
    if not seed_words < least <= seed_words + 63:
        raise ValueError("a seed is shorter than a window, by 63 words at most")
    keyed = docs.select(*dict.fromkeys([*carry, "text"]), F.xxhash64("doc_id", "text").alias("_key"))
    joined = keyed.join(repeats(keyed, least, seed_words), "_key", "left").drop("_key")
    results = StructType.fromDDL("n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>")
    schema = StructType([*(docs.schema[c] for c in carry), *results])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def one(text: bytes | None, runs: list | None) -> tuple:
        words = (text or b"").split()
        if not runs:
            return len(words), 0, b" ".join(words), []
        edge = np.zeros(len(words) + 1, np.int32)
        for r in runs:
            if r["start"] < len(words):
                edge[r["start"]] += 1
                edge[min(r["start"] + r["n"] - 1 + least, len(words))] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        steps = np.diff(covered.astype(np.int8), prepend=0, append=0)
        spans = [{"start": a, "stop": b} for a, b in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True)]
        return len(words), int(covered.sum()), b" ".join(compress(words, (~covered).tolist())), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            got = list(zip(*map(one, texts, batch.column("runs").to_pylist()), strict=True))
            arrays = [batch.column(c) for c in carry]
            arrays += [pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.binary()).cast(pa.string()), pa.array(got[3], spans_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, "n_words", "n_removed", "kept", "spans"])

    return joined.mapInArrow(run, schema)
