"""Operators on intervals: merging, sweeping, scoring who spoke when."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(intervals: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching intervals of a key as one (running maximum of the stops)."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    numbered = intervals.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def atoms(bounds: DataFrame, key: str) -> DataFrame:
    """Neighbouring distinct bounds (column t) as elementary intervals."""
    w = Window.partitionBy(key).orderBy("t")
    return bounds.select(key, "t").distinct().select(key, F.col("t").alias("start"), F.lead("t").over(w).alias("stop")).where("stop IS NOT NULL")


def active(intervals: DataFrame, key: str, label: str) -> DataFrame:
    """Elementary intervals with the sorted labels active in each: a sweep.

    Elementary intervals are numbered, every interval finds the numbers of its
    own two bounds by equal times, and covers those between.
    """
    bounds = intervals.select(key, F.explode(F.array("start", "stop")).alias("t"))
    w = Window.partitionBy(key).orderBy("start")
    cells = atoms(bounds, key).withColumn("cell", F.row_number().over(w))
    first = cells.select(F.col(key).alias("_k"), F.col("start").alias("_at"), F.col("cell").alias("_from"))
    last = cells.select(F.col(key).alias("_l"), F.col("stop").alias("_end"), F.col("cell").alias("_to"))
    spans = intervals.where("stop > start").join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.col("start") == F.col("_at")))
    spans = spans.join(last, F.col(key).eqNullSafe(F.col("_l")) & (F.col("stop") == F.col("_end")))
    within = spans.select(F.col(key).alias("_k"), F.col(label), F.explode(F.sequence("_from", "_to")).alias("_cell"))
    names = within.groupBy("_k", "_cell").agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return cells.join(names, F.col(key).eqNullSafe(F.col("_k")) & (F.col("cell") == F.col("_cell"))).select(key, "start", "stop", "labels")


def turns_to_rttm(segments: DataFrame, key: str) -> DataFrame:
    """Labelled segments in order of start as speaker turns.

    Equal labels without a gap are one turn, up to the later of their stops;
    turns of different labels that overlap are both cut in the middle of the
    overlap. Of a turn inside another of a different label the overlap is its
    own length, so the outer one ends there; one that lies wholly before the
    start of the turn that is open by then goes. No turn is empty or shrinks
    below 0.
    """
    fields = {f.name: f.dataType.simpleString() for f in segments.schema.fields}

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([("start", "ascending"), ("stop", "ascending"), ("label", "ascending")])
        out: list[list] = []
        for start, stop, label in zip(data["start"].to_pylist(), data["stop"].to_pylist(), data["label"].to_pylist(), strict=True):
            last = out[-1] if out else None
            if last and label == last[2] and start <= last[1]:
                last[1] = max(last[1], stop)
                continue
            if last and max(start, last[0]) >= stop:
                continue
            if last and label != last[2] and start < last[1]:
                last[1] = start = (max(start, last[0]) + min(last[1], stop)) / 2
            out.append([start, stop, label])
        names = pa.array([data[key][0].as_py()] * len(out), data.schema.field(key).type)
        return pa.table({key: names, "turn": pa.array(range(len(out)), pa.int32()), "start": pa.array([x[0] for x in out], pa.float64()), "stop": pa.array([x[1] for x in out], pa.float64()), "label": pa.array([x[2] for x in out], data.schema.field("label").type)})

    return segments.select(key, "start", "stop", "label").groupBy(key).applyInArrow(run, f"`{key}` {fields[key]}, turn int, start double, stop double, label {fields['label']}")


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the heaviest one-to-one mapping, by shortest augmenting paths; pairs of weight 0 are left out."""
    n, m = weights.shape
    size = max(n, m)
    cost = np.zeros((size, size))
    cost[:n, :m] = -weights
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    match = np.full(size + 1, -1)
    for row in range(size):
        match[size] = row
        free, reach, back = size, np.full(size, np.inf), np.full(size, -1)
        seen = np.zeros(size + 1, bool)
        while match[free] >= 0:
            seen[free] = True
            i = match[free]
            open_ = ~seen[:size]
            slack = cost[i] - u[i] - v[:size]
            better = open_ & (slack < reach)
            reach[better], back[better] = slack[better], free
            nearest = int(np.where(open_, reach, np.inf).argmin())
            delta = reach[nearest]
            u[match[np.flatnonzero(seen)]] += delta
            v[seen] -= delta
            reach[open_] -= delta
            free = nearest
        while free != size:
            match[free] = match[back[free]]
            free = back[free]
    return sorted((int(match[j]), j) for j in range(m) if 0 <= match[j] < n and weights[match[j], j] > 0)


def speaker_mapping(overlaps: DataFrame, key: str) -> DataFrame:
    """The heaviest one-to-one mapping of ref to hyp speakers, from (key, ref, hyp, seconds)."""
    fields = {f.name: f.dataType.simpleString() for f in overlaps.schema.fields}

    def run(data: pa.Table) -> pa.Table:
        refs, hyps = sorted(set(data["ref"].to_pylist())), sorted(set(data["hyp"].to_pylist()))
        weights = np.zeros((len(refs), len(hyps)))
        for r, h, s in zip(data["ref"].to_pylist(), data["hyp"].to_pylist(), data["seconds"].to_pylist(), strict=True):
            weights[refs.index(r), hyps.index(h)] += s
        pairs = assignment(weights)
        names = pa.array([data[key][0].as_py()] * len(pairs), data.schema.field(key).type)
        return pa.table({key: names, "ref": pa.array([refs[i] for i, _ in pairs], data.schema.field("ref").type), "hyp": pa.array([hyps[j] for _, j in pairs], data.schema.field("hyp").type)})

    return overlaps.select(key, "ref", "hyp", "seconds").groupBy(key).applyInArrow(run, f"`{key}` {fields[key]}, ref {fields['ref']}, hyp {fields['hyp']}")


def scored_cells(ref: DataFrame, hyp: DataFrame, key: str, collar: float = 0.0) -> DataFrame:
    """Elementary intervals of labelled segments of both sides: key, seconds, refs, hyps (sorted labels) and near.

    ``near`` says that the interval lies within ``collar`` of where a
    reference segment starts or stops.
    """
    side = lambda rows, mark: rows.select(key, F.concat(F.lit(mark), F.col("label").cast("string")).alias("_who"), "start", "stop")
    ends = ref.select(key, F.explode(F.array("start", "stop")).alias("_t")).distinct()
    collars = ends.select(key, F.lit("x").alias("_who"), (F.col("_t") - collar).alias("start"), (F.col("_t") + collar).alias("stop"))
    named = side(ref, "r").unionByName(side(hyp, "h"))
    cells = active(named.unionByName(collars) if collar > 0 else named, key, "_who")
    of = lambda mark: F.transform(F.filter("labels", lambda x: x.startswith(mark)), lambda x: F.substr(x, F.lit(2)))
    return cells.select(key, (F.col("stop") - F.col("start")).alias("seconds"), of("r").alias("refs"), of("h").alias("hyps"), F.array_contains("labels", "x").alias("near"))


def shared_seconds(cells: DataFrame, key: str) -> DataFrame:
    """key, ref, hyp and the seconds that both speak in."""
    pairs = cells.select(key, "seconds", "hyps", F.explode("refs").alias("ref")).select(key, "seconds", "ref", F.explode("hyps").alias("hyp"))
    return pairs.groupBy(key, "ref", "hyp").agg(F.sum("seconds").alias("seconds"))


def diarization_report(ref: DataFrame, hyp: DataFrame, key: str, collar: float = 0.0, skip_overlap: bool = False) -> DataFrame:
    """Seconds scored, missed, false_alarm and confused, and the error rate (der, in percent), by recording and over ALL.

    Speakers are mapped one to one so that they share most time, over all of a
    recording; then collars and, with ``skip_overlap``, what several reference
    speakers say at once are left out. Without scored time the rate is 0, or
    100 if there are errors.
    """
    cells = scored_cells(ref, hyp, key, collar)
    pairs = speaker_mapping(shared_seconds(cells, key), key)
    pairs = pairs.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("ref", "hyp")).alias("_pairs"))
    kept = cells.where(~F.col("near") & (F.size("refs") < 2 if skip_overlap else F.lit(True)) & (F.size("refs") + F.size("hyps") > 0))
    right = F.filter(F.coalesce("_pairs", F.array()), lambda p: F.array_contains(F.col("refs"), p["ref"]) & F.array_contains(F.col("hyps"), p["hyp"]))
    joined = kept.join(pairs, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_right", F.size(right))
    r, h, s, zero = F.size("refs"), F.size("hyps"), F.col("seconds"), F.lit(0)
    sums = joined.withColumn("_name", F.coalesce(F.col(key).cast("string"), F.lit(""))).rollup("_name").agg(
        F.sum(s * r).alias("scored"),
        F.sum(s * F.greatest(r - h, zero)).alias("missed"),
        F.sum(s * F.greatest(h - r, zero)).alias("false_alarm"),
        F.sum(s * (F.least(r, h) - F.col("_right"))).alias("confused"),
    )
    errors = F.col("missed") + F.col("false_alarm") + F.col("confused")
    der = F.when(F.col("scored") > 0, 100 * errors / F.col("scored")).when(errors > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return sums.select(F.coalesce("_name", F.lit("ALL")).alias("condition"), "scored", "missed", "false_alarm", "confused", der.alias("der"))
