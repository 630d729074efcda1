"""Operators on rows in order: running sums, splits, batches, runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: str, key: str) -> Column:
    """A reproducible random order: the same in every engine and for every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def sum_before(rows: DataFrame, group: str, order: str, value: str, out: str = "before", part: Column | None = None) -> DataFrame:
    """The sum of ``value`` over the group's earlier rows.

    No task sees a whole group: rows are divided by ``part``, which must rise
    with the order (by default the first three digits of a hexadecimal key,
    so 4096 parts), the parts' sums are added up, and each part adds up its
    own rows.
    """
    part = F.substring(order, 1, 3) if part is None else part
    divided = rows.withColumn("_part", part)
    sums = divided.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = divided.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_group", "_p", "_base")


def budgeted(rows: DataFrame, group: str, key: str, value: str, budget: float, seed: str = "0") -> DataFrame:
    """Rows in random order until the budget is passed; the row that passes it is kept."""
    ordered = rows.withColumn("_order", shuffle_key(seed, key))
    return sum_before(ordered, group, "_order", value).where(F.col("before") <= budget).drop("_order", "before")


def validation_split(rows: DataFrame, group: str, key: str, value: str, first: int, budget: float, seed: str = "0") -> DataFrame:
    """The first rows in random order as ``val``, then ``train`` rows while the sum before them is under the budget."""
    ordered = sum_before(rows.withColumn("_order", shuffle_key(seed, key)).withColumn("_one", F.lit(1)), group, "_order", "_one", "_rank")
    val = ordered.where(F.col("_rank") < first).withColumn("split", F.lit("val"))
    rest = sum_before(ordered.where(F.col("_rank") >= first), group, "_order", value)
    train = rest.where(F.col("before") < budget).drop("before").withColumn("split", F.lit("train"))
    return val.unionByName(train).drop("_order", "_one", "_rank")


def frame_batches(rows: DataFrame, group: str, key: str, length: str, threshold: float, most: int = 0, drop_last: bool = False) -> DataFrame:
    """Batches of a group's rows in rising length: group, key, length, batch.

    A batch is closed where the next row would pass ``threshold`` in all or
    ``most`` rows (0: no limit). A row longer than the threshold goes, but
    closes the open batch too. The rule is sequential, so a group is the unit
    of work: divide large groups first.
    """
    picked = rows.select(group, key, F.col(length).cast("double").alias(length))
    fields = {f.name: f.dataType.simpleString() for f in picked.schema.fields}

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([(length, "ascending"), (key, "ascending")])
        batch, used, count, out = 0, 0.0, 0, []
        for size in data[length].to_numpy():
            if used + size <= threshold and (not most or count < most):
                used, count = used + size, count + 1
                out.append(batch)
                continue
            batch += count > 0
            used, count = (size, 1) if size <= threshold else (0.0, 0)
            out.append(batch if count else -1)
        numbers = np.array(out, dtype=np.int32)
        if drop_last and count:
            numbers[numbers == batch] = -1
        return data.append_column("batch", pa.array(numbers)).filter(pa.array(numbers >= 0))

    return picked.groupBy(group).applyInArrow(run, f"`{group}` {fields[group]}, `{key}` {fields[key]}, `{length}` double, batch int")


def flush_batches(rows: DataFrame, group: str, key: str, length: str, budget: float) -> DataFrame:
    """Batches in key order that are closed once they reach the budget; what is left over is a batch too."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([(key, "ascending")])
        batch, used, out = 0, 0, []
        for size in data[length].to_pylist():
            out.append(batch)
            used += size
            if used >= budget:
                batch, used = batch + 1, 0
        return data.append_column("batch", pa.array(out, pa.int32()))

    return rows.select(group, key, length).groupBy(group).applyInArrow(run, f"`{group}` {fields[group]}, `{key}` {fields[key]}, `{length}` {fields[length]}, batch int")


def first_seen(rows: DataFrame, group: str, position: str, label: str) -> DataFrame:
    """Labels renumbered from 0 in the order in which a group first has them."""
    first = rows.withColumn("_first", F.min(position).over(Window.partitionBy(group, label)))
    return first.withColumn("relabelled", F.dense_rank().over(Window.partitionBy(group).orderBy("_first")) - 1).drop("_first")


def runs(rows: DataFrame, group: str, start: Column, order: tuple[str, ...], out: str = "run") -> DataFrame:
    """Numbers runs: a run begins where ``start`` holds."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn(out, F.sum(F.when(start, 1).otherwise(0)).over(w))


def substituted(rows: DataFrame, key: str, valid: Column) -> DataFrame:
    """Every row's key with the key of the next valid row, its own included; after the last one the first.

    Rows are divided by ranges of the key, and only each range's first valid
    key is looked at across ranges.
    """
    marked = rows.select(key, F.when(valid, F.col(key)).alias("_valid"))
    size = 4096
    ranged = marked.withColumn("_range", F.floor(F.col(key) / size))
    firsts = ranged.groupBy("_range").agg(F.min("_valid").alias("_first"))
    after = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    later = firsts.select("_range", F.first("_first", ignorenulls=True).over(after).alias("_later"), F.min("_first").over(Window.partitionBy()).alias("_wrap"))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(0, Window.unboundedFollowing)
    own = ranged.withColumn("_own", F.first("_valid", ignorenulls=True).over(inside))
    return own.join(later, "_range").select(key, F.coalesce("_own", "_later", "_wrap").alias("used"))


def length_windows(rows: DataFrame, group: str, order: str, text: str, size: int, shift: int) -> DataFrame:
    """Windows of sentences by length: group, window, first, last (places of sentences).

    From a place on, sentences are taken until they have ``size`` characters.
    The next window starts at the first place such that the sentences after
    the start have ``shift``. The last window is replaced by the shortest one
    at the end that has ``size``.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([(order, "ascending")])
        sizes = np.array([len(x or "") for x in data[text].to_pylist()])
        ends = np.cumsum(sizes)
        n, i, out = len(sizes), 0, []
        while i < n:
            base = ends[i - 1] if i else 0
            out.append((i, min(int(np.searchsorted(ends, base + size)), n - 1)))
            i = int(np.searchsorted(ends, ends[i] + shift))
        if out:
            out[-1] = (max(0, int(np.searchsorted(ends, ends[-1] - size, side="right")) if ends[-1] >= size else 0), n - 1)
        names = pa.array([data[group][0].as_py()] * len(out), data.schema.field(group).type)
        return pa.table({group: names, "window": pa.array(range(1, len(out) + 1), pa.int32()), "first": pa.array([a for a, _ in out], pa.int32()), "last": pa.array([b for _, b in out], pa.int32())})

    return rows.select(group, order, text).groupBy(group).applyInArrow(run, f"`{group}` {fields[group]}, window int, first int, last int")


def vectorised(rows: DataFrame, function, schema: str) -> DataFrame:
    """Maps Arrow batches by a function of a batch, for models that are plugged in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return rows.mapInArrow(run, schema)


def falling_batches(rows: DataFrame, group: str, key: str, length: str, budget: float) -> DataFrame:
    """Batches of a group's rows in falling length: the first row of a batch says how many of its length fit, one at least."""
    picked = rows.select(group, key, length)
    fields = {f.name: f.dataType.simpleString() for f in picked.schema.fields}

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([(length, "descending"), (key, "descending")])
        sizes, out = data[length].to_pylist(), []
        while len(out) < len(sizes):
            room = max(int(budget / sizes[len(out)]), 1) if sizes[len(out)] else len(sizes)
            out += [(out[-1] + 1) if out else 0] * min(room, len(sizes) - len(out))
        return data.select([group, key]).append_column("batch", pa.array(out, pa.int32()))

    return picked.groupBy(group).applyInArrow(run, f"`{group}` {fields[group]}, `{key}` {fields[key]}, batch int")


def interpolated(seen: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """Values at all places from a group's first to its last; those between two seen ones lie on the line between them."""
    order = Window.partitionBy(group).orderBy(place)
    ahead = seen.select(group, place, value, F.lead(place).over(order).alias("_next"), F.lead(value).over(order).alias("_value"))
    last = F.greatest(F.coalesce(F.col("_next") - 1, F.col(place)), F.col(place))
    filled = ahead.select("*", F.explode(F.sequence(F.col(place), last)).alias("_at"))
    step = (F.col("_value") - F.col(value)) * (F.col("_at") - F.col(place)) / (F.col("_next") - F.col(place))
    return filled.select(group, F.col("_at").alias(place), (F.col(value) + F.coalesce(step, F.lit(0.0))).alias(value))


def by_voice(rows: DataFrame, group: str, order: str, voice: str, text: str) -> DataFrame:
    """group, voice and its segments in order: neighbouring rows of a voice are one segment, of ``first`` (its first place) and ``text``."""
    w = Window.partitionBy(group).orderBy(order)
    fresh = ~F.lag(voice).over(w).eqNullSafe(F.col(voice))
    marked = rows.select(group, order, F.col(voice).alias("voice"), F.col(text).alias("_text"), F.when(fresh, F.col(order)).alias("_fresh"))
    marked = marked.withColumn("first", F.max("_fresh").over(w))
    parts = F.array_sort(F.collect_list(F.struct(order, "_text")))
    merged = marked.groupBy(group, "voice", "first").agg(F.array_join(F.transform(parts, lambda x: x["_text"]), "").alias("text"))
    return merged.groupBy(group, "voice").agg(F.array_sort(F.collect_list(F.struct("first", "text"))).alias("segments"))
