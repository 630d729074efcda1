"""Metrics of detection, recognition and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType


def trade_off(scores: DataFrame, weight: str | None = None) -> DataFrame:
    """fnr and fpr at each place of the sorted scores, from (id, score, target), counts weighted where asked for.

    Rows with equal scores are ordered by id. Running counts are taken over
    ranges of scores first, so that no task sees all of them.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    quantised = scores.withColumn("_part", F.floor(F.col("score") * 512)).withColumn("_tw", F.col("target") * w).withColumn("_iw", (1 - F.col("target")) * w)
    sums = quantised.groupBy("_part").agg(F.sum("_tw").alias("t"), F.sum("_iw").alias("i"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sums.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c in "ti"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "ti"))
    inside = Window.partitionBy("_part").orderBy("score", "id").rowsBetween(Window.unboundedPreceding, 0)
    counted = quantised.withColumn("_t", F.sum("_tw").over(inside)).withColumn("_i", F.sum("_iw").over(inside))
    joined = counted.join(sums, "_part")
    return joined.select("id", "score", ((F.col("t_base") + F.col("_t")) / F.col("t_all")).alias("fnr"), (1 - (F.col("i_base") + F.col("_i")) / F.col("i_all")).alias("fpr"))


def histogram_curve(scores: DataFrame, least: int = 1_000_000) -> DataFrame:
    """fnr and fpr at each bin that has scores: ``least`` edges at least between the smallest and the largest score.

    At most as many rows as bins are put in order, whatever the scores.
    """
    ends = scores.agg(F.min("score").alias("_low"), F.max("score").alias("_high"), F.greatest(F.sum("target"), F.sum(1 - F.col("target")), F.lit(least)).alias("_edges"))
    place = F.floor((F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (F.col("_edges") - 1))
    bins = scores.crossJoin(F.broadcast(ends)).groupBy(F.least(place, F.col("_edges") - 2).cast("long").alias("bin")).agg(F.sum("target").alias("t"), F.sum(1 - F.col("target")).alias("i"))
    sums = bins.withColumn("_part", F.floor(F.col("bin") / 4096))
    parts = sums.groupBy("_part").agg(F.sum("t").alias("pt"), F.sum("i").alias("pi"))
    earlier, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    parts = parts.select("_part", *(F.coalesce(F.sum(f"p{c}").over(earlier), F.lit(0)).alias(f"{c}_base") for c in "ti"), *(F.sum(f"p{c}").over(every).alias(f"{c}_all") for c in "ti"))
    inside = Window.partitionBy("_part").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = sums.select("bin", "_part", F.sum("t").over(inside).alias("_t"), F.sum("i").over(inside).alias("_i")).join(parts, "_part")
    return counted.select("bin", ((F.col("t_base") + F.col("_t")) / F.col("t_all")).alias("fnr"), (1 - (F.col("i_base") + F.col("_i")) / F.col("i_all")).alias("fpr"))


def equalised(scores: DataFrame, part: str) -> DataFrame:
    """Adds ``weight``: as if every part had as many targets, and as many impostors, as the part with most of them."""
    sizes = scores.groupBy(F.col(part).alias("_part"), F.col("target").alias("_target")).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_most", F.max("_n").over(Window.partitionBy("_target")))
    joined = scores.join(sizes, F.col(part).eqNullSafe(F.col("_part")) & (F.col("target") == F.col("_target")))
    return joined.withColumn("weight", F.col("_most") / F.col("_n")).select(*scores.columns, "weight")


def equal_error_rate(scores: DataFrame) -> DataFrame:
    """Where misses and false alarms are equal, interpolated between the places around; eer and threshold."""
    curve = trade_off(scores)
    order, point = F.struct("score", "id"), F.struct("fnr", "fpr", "score")
    above = F.min_by(F.when(F.col("fnr") >= F.col("fpr"), point), F.when(F.col("fnr") >= F.col("fpr"), order)).alias("a")
    below = F.max_by(F.when(F.col("fnr") < F.col("fpr"), point), F.when(F.col("fnr") < F.col("fpr"), order)).alias("b")
    found = curve.agg(above, below)
    part = (F.col("a.fnr") - F.col("a.fpr")) / (F.col("b.fpr") - F.col("a.fpr") - (F.col("b.fnr") - F.col("a.fnr")))
    return found.select((F.col("a.fnr") + part * (F.col("b.fnr") - F.col("a.fnr"))).alias("eer"), F.col("a.score").alias("threshold"))


def detection_cost(scores: DataFrame, prior: float = 0.01, miss: float = 1.0, alarm: float = 1.0) -> DataFrame:
    cost = F.min(miss * F.col("fnr") * prior + alarm * F.col("fpr") * (1 - prior))
    return trade_off(scores).agg(cost.alias("min_dcf")).withColumn("min_dcf_norm", F.col("min_dcf") / min(miss * prior, alarm * (1 - prior)))


def average_precision(scores: DataFrame) -> DataFrame:
    """The area under precision by recall, precision made falling, from (id, score, target).

    Scores are put in order by ranges: ranks and hits before a range, and the
    best precision behind it, are taken over the ranges' sums.
    """
    ranged = scores.withColumn("_part", F.floor(-F.col("score") * 512))
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("target").alias("_h"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c in ("_n", "_h")))
    inside = Window.partitionBy("_part").orderBy(F.desc("score"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.select("_part", "score", "id", "target", F.count("*").over(inside).alias("_k"), F.sum("target").over(inside).alias("_hits")).join(sums, "_part")
    rank, hits = F.col("_n_base") + F.col("_k"), F.col("_h_base") + F.col("_hits")
    found = ranked.where("target = 1").select("_part", hits.alias("_at"), (hits / rank).alias("precision"))
    best = found.groupBy("_part").agg(F.max("precision").alias("_best"))
    behind = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    best = best.select("_part", F.max("_best").over(behind).alias("_later"))
    own = F.max("precision").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(0, Window.unboundedFollowing))
    final = found.withColumn("_own", own).join(best, "_part")
    return final.agg((F.sum(F.greatest("_own", F.coalesce("_later", F.lit(0.0)))) / F.count("*")).alias("average_precision"))


def binary_counts(truth, prediction) -> dict:
    """Sums for precision, recall and F1 of class 1."""
    return {
        "tp": F.sum(((truth == 1) & (prediction == 1)).cast("long")),
        "fp": F.sum(((truth == 0) & (prediction == 1)).cast("long")),
        "fn": F.sum(((truth == 1) & (prediction == 0)).cast("long")),
        "tn": F.sum(((truth == 0) & (prediction == 0)).cast("long")),
    }


def binary_report(rows: DataFrame, truth, prediction) -> DataFrame:
    """precision, recall and f1 of class 1, accuracy and n, in six places."""
    sums = binary_counts(truth, prediction)
    got = rows.agg(*(v.alias(k) for k, v in sums.items()), F.avg((truth == prediction).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    ratio = lambda a, b: F.round(a / (b + 1e-10), 6)
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return got.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.round("accuracy", 6).alias("accuracy"), "n")


def class_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """For each class of the truth its rows, guesses and hits, recall, precision and F1."""
    cells = rows.groupBy(F.col(truth).alias("_t"), F.col(guess).alias("_g")).agg(F.count("*").alias("_n"))
    both = cells.select(F.inline(F.array(
        F.struct(F.col("_t").alias("class"), F.col("_n").alias("total"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("_t") == F.col("_g"), F.col("_n")).otherwise(0).alias("hits")),
        F.struct(F.col("_g").alias("class"), F.lit(0).cast("long").alias("total"), F.col("_n").alias("guessed"), F.lit(0).cast("long").alias("hits")),
    )))
    sums = both.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("total", "guessed", "hits"))).where("total > 0")
    scored = sums.withColumn("recall", F.col("hits") / (F.col("total") + 1e-10)).withColumn("precision", F.col("hits") / (F.col("guessed") + 1e-10))
    f1 = 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision") + 1e-10)
    return scored.select("class", "total", "guessed", "hits", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.round(f1, 6).alias("f1"))


#: Costs that say at once how many edits, insertions and deletions there are; of cheapest alignments the one with most substitutions wins.
EDIT, INSERTION, DELETION = 1_000_000_000_000, 1_000_000, 1


def word_counts(reference: str, hypothesis: str) -> tuple[int, int, int]:
    """Edits, insertions and deletions between two sentences, by words (fewer than a million)."""
    a, b = reference.split(), hypothesis.split()
    number = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    x, y = np.array([number[w] for w in a], np.int64), np.array([number[w] for w in b], np.int64)
    steps = np.arange(len(y) + 1) * (EDIT + INSERTION)
    row = steps
    for word in x:
        new = row + (EDIT + DELETION)
        new[1:] = np.minimum(new[1:], row[:-1] + (y != word) * EDIT)
        row = np.minimum.accumulate(new - steps) + steps
    code = int(row[-1])
    return code // EDIT, code // INSERTION % INSERTION, code % INSERTION


@pandas_udf(StructType([StructField(c, LongType()) for c in ("edits", "insertions", "deletions")]))
def _word_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    rows = [word_counts(a or "", b or "") for a, b in zip(reference, hypothesis, strict=True)]
    return pd.DataFrame(rows, columns=["edits", "insertions", "deletions"], dtype="int64")


def word_errors(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds words (of the reference), edits, insertions, deletions and substitutions."""
    words = F.size(F.filter(F.split(F.coalesce(reference, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    found = pairs.withColumn("_counts", _word_counts(reference, hypothesis)).select("*", words.alias("words"), "_counts.*").drop("_counts")
    return found.withColumn("substitutions", F.col("edits") - F.col("insertions") - F.col("deletions"))


def corpus_error(errors: DataFrame) -> DataFrame:
    """wer: all edits by all words; wer_avg: the mean over sentences; both in percent with three places."""
    mean = F.avg(error_rate(F.col("edits"), F.col("words")))
    return errors.agg(F.round(F.sum("edits") / F.sum("words") * 100, 3).alias("wer"), F.round(mean * 100, 3).alias("wer_avg"))


def error_shares(errors: DataFrame) -> DataFrame:
    """The mean rate of sentences in percent, and the shares of the kinds of error in it."""
    mean = lambda c: F.round(F.avg(error_rate(F.col(c), F.col("words"))) * 100, 3)
    got = errors.agg(mean("edits").alias("wer"), *(mean(c).alias(c) for c in ("substitutions", "deletions", "insertions")))
    return got.select("wer", *(F.round(F.col(c) / F.col("wer"), 3).alias(c) for c in ("substitutions", "deletions", "insertions")))


def error_rate(edits, words):
    """Edits per word; infinite where there are no words but edits."""
    return F.when(words > 0, edits / words).when(edits > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
