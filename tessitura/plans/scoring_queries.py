"""Scores: word errors by kind, per-class reports, histograms of trials, who-spoke-when reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import intervals, metrics

from . import interval_queries, register, speaker_queries
from .tables import read

#: Test sentences as references; hypotheses lack every fifth word, have others in place of every seventh, and say some twice.
_SQL_PAIRS = """w AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS a FROM benchmark),
p AS (SELECT item_id, a, flatten(list_transform(range(0, len(a)), lambda i: CASE WHEN i % 5 = 2 THEN [] WHEN i % 7 = 3 THEN ['other'] WHEN i % 11 = 4 THEN [a[i + 1], a[i + 1]] ELSE [a[i + 1]] END)) AS b FROM w)"""

_SQL_EDITS = f"""WITH RECURSIVE {_SQL_PAIRS},
d AS (SELECT item_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: j * 1001000) AS r FROM p
UNION ALL SELECT item_id, a, b, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_min(list_transform(range(1, j + 1), lambda k:
  (CASE WHEN k = 1 THEN r[1] + 1000001 ELSE least(r[k] + 1000001, r[k - 1] + CASE WHEN a[i + 1] = b[k - 1] THEN 0 ELSE 1000000 END) END) + (j - k) * 1001000))) FROM d WHERE i < len(a)),
e AS (SELECT item_id, len(a) AS words, r[-1] AS code FROM d WHERE i = len(a)),
f AS (SELECT item_id, words, code // 1000000 AS edits, code // 1000 % 1000 AS insertions, code % 1000 AS deletions FROM e)"""


def _pairs(spark, sf_dir):
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = read(spark, sf_dir, "benchmark").select("item_id", words.alias("a"))
    said = F.transform("a", lambda x, i: F.when(i % 5 == 2, F.array().cast("array<string>")).when(i % 7 == 3, F.array(F.lit("other"))).when(i % 11 == 4, F.array(x, x)).otherwise(F.array(x)))
    return rows.select("item_id", F.array_join("a", " ").alias("ref"), F.array_join(F.flatten(said), " ").alias("hyp"))


def _edits(spark, sf_dir):
    return metrics.word_errors(_pairs(spark, sf_dir), "ref", "hyp")


@register(f"{_SQL_EDITS} SELECT item_id, words, edits, insertions, deletions, edits - insertions - deletions AS substitutions, round(edits / words, 6) AS wer FROM f")
def wer_pairs(spark, sf_dir):
    rate = F.round(metrics.error_rate(F.col("edits"), F.col("words")), 6)
    return _edits(spark, sf_dir).select("item_id", "words", "edits", "insertions", "deletions", "substitutions", rate.alias("wer"))


@register(f"{_SQL_EDITS} SELECT round(sum(edits) / sum(words) * 100, 3) AS wer, round(avg(edits / words) * 100, 3) AS wer_avg FROM f")
def wer_corpus(spark, sf_dir):
    return metrics.corpus_error(_edits(spark, sf_dir))


@register(f"""{_SQL_EDITS}, m AS (SELECT round(avg(edits / words) * 100, 3) AS wer, round(avg((edits - insertions - deletions) / words) * 100, 3) AS s, round(avg(deletions / words) * 100, 3) AS d, round(avg(insertions / words) * 100, 3) AS i FROM f)
SELECT wer, round(s / wer, 3) AS substitutions, round(d / wer, 3) AS deletions, round(i / wer, 3) AS insertions FROM m""")
def wer_breakdown(spark, sf_dir):
    return metrics.error_shares(_edits(spark, sf_dir))


_SQL_MARKS = "SELECT quality AS truth, toxic AS guess FROM labels"


@register(f"""WITH m AS ({_SQL_MARKS}), c AS (SELECT DISTINCT truth AS c FROM m), s AS (SELECT c, (SELECT count(*) FROM m WHERE truth = c) AS total, (SELECT count(*) FROM m WHERE guess = c) AS guessed, (SELECT count(*) FROM m WHERE truth = c AND guess = c) AS hits FROM c),
r AS (SELECT *, hits / (total + 1e-10) AS recall, hits / (guessed + 1e-10) AS precision FROM s) SELECT c AS class, total, guessed, hits, round(recall, 6) AS recall, round(precision, 6) AS precision, round(2 * recall * precision / (recall + precision + 1e-10), 6) AS f1 FROM r""")
def class_report(spark, sf_dir):
    return metrics.class_report(read(spark, sf_dir, "labels"), "quality", "toxic")


@register(f"SELECT round(100 * avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 2) AS accuracy FROM ({_SQL_MARKS})")
def prediction_accuracy(spark, sf_dir):
    """Predictions joined with the truth on their key."""
    labels = read(spark, sf_dir, "labels")
    joined = labels.select("doc_id", F.col("quality").alias("truth")).join(labels.select("doc_id", F.col("toxic").alias("guess")), "doc_id")
    return joined.agg(F.round(100 * F.avg((F.col("truth") == F.col("guess")).cast("int")), 2).alias("accuracy"))


@register(f"""WITH s AS (SELECT round(score, 9) AS score, target FROM ({speaker_queries._SQL_TRIALS})), e AS (SELECT min(score) AS low, max(score) AS high, greatest(sum(target), sum(1 - target), 1000000) - 1 AS bins FROM s),
b AS (SELECT least(CAST(floor((score - low) / (high - low) * bins) AS BIGINT), bins::BIGINT - 1) AS bin, sum(target) AS t, sum(1 - target) AS i FROM s, e GROUP BY 1)
SELECT bin, round(sum(t) OVER w / sum(t) OVER (), 6) AS fnr, round(1 - sum(i) OVER w / sum(i) OVER (), 6) AS fpr FROM b WINDOW w AS (ORDER BY bin)""")
def score_histogram(spark, sf_dir):
    curve = metrics.histogram_curve(speaker_queries._rounded(spark, sf_dir))
    return curve.select("bin", F.round("fnr", 6).alias("fnr"), F.round("fpr", 6).alias("fpr"))


@register(f"""WITH s AS (SELECT id, round(score, 9) AS score, target, 1 + id % 3 AS w FROM ({speaker_queries._SQL_TRIALS})) SELECT id, round(sum(target * w) OVER o / (SELECT sum(target * w) FROM s), 6) AS fnr, round(1 - sum((1 - target) * w) OVER o / (SELECT sum((1 - target) * w) FROM s), 6) AS fpr FROM s
WINDOW o AS (ORDER BY score, id ROWS UNBOUNDED PRECEDING)""")
def weighted_det_points(spark, sf_dir):
    rows = speaker_queries._rounded(spark, sf_dir).withColumn("w", 1 + F.pmod("id", F.lit(3)))
    return metrics.trade_off(rows, weight="w").select("id", F.round("fnr", 6).alias("fnr"), F.round("fpr", 6).alias("fpr"))


@register(f"""WITH s AS (SELECT id, target, id % 4 AS part FROM ({speaker_queries._SQL_TRIALS})), n AS (SELECT part, target, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT target, max(n) AS m FROM n GROUP BY target)
SELECT id, round(m / n, 6) AS weight FROM s JOIN n USING (part, target) JOIN m USING (target)""")
def equalised_trials(spark, sf_dir):
    rows = speaker_queries._trials(spark, sf_dir).withColumn("part", F.pmod("id", F.lit(4)))
    return metrics.equalised(rows, "part").select("id", F.round("weight", 6).alias("weight"))


@register("""WITH r AS (SELECT CASE WHEN event_id % 5 = 0 THEN -100 WHEN value > 20 THEN 1 ELSE 0 END AS y, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS p FROM events),
s AS (SELECT sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM r WHERE y <> -100)
SELECT round(tp / (tp + fp + 1e-10), 6) AS precision, round(tp / (tp + fn + 1e-10), 6) AS recall, round(2 * tp / (2 * tp + fp + fn + 1e-10), 6) AS f1, round(accuracy, 6) AS accuracy, n FROM s""")
def masked_metrics(spark, sf_dir):
    y = F.when(F.pmod("event_id", F.lit(5)) == 0, -100).when(F.col("value") > 20, 1).otherwise(0)
    rows = read(spark, sf_dir, "events").select(y.alias("y"), F.when(F.pmod("user_id", F.lit(3)) == 0, 1).otherwise(0).alias("p")).where("y <> -100")
    return metrics.binary_report(rows, F.col("y"), F.col("p"))


#: The system hears two thirds of the segments, a second late, under names of its own.
_SQL_SIDES = f"""{interval_queries._SQL_SEG}, ref AS (SELECT rec, label, start, stop FROM seg), hyp AS (SELECT rec, 's' || length(label) || left(label, 1) AS label, start + 1 AS start, stop + 1 AS stop FROM seg WHERE event_id % 3 <> 0),
b AS (SELECT DISTINCT rec, unnest([start, stop, start - 0.25, start + 0.25, stop - 0.25, stop + 0.25]) AS t FROM ref UNION SELECT rec, unnest([start, stop]) FROM hyp),
cells AS (SELECT * FROM (SELECT rec, t AS start, lead(t) OVER (PARTITION BY rec ORDER BY t) AS stop FROM b) WHERE stop IS NOT NULL),
rs AS (SELECT c.rec, c.start, list_sort(list_distinct(list(s.label))) AS r FROM cells c JOIN ref s ON s.rec = c.rec AND s.start <= c.start AND s.stop >= c.stop GROUP BY ALL),
hs AS (SELECT c.rec, c.start, list_sort(list_distinct(list(s.label))) AS h FROM cells c JOIN hyp s ON s.rec = c.rec AND s.start <= c.start AND s.stop >= c.stop GROUP BY ALL),
xs AS (SELECT DISTINCT c.rec, c.start FROM cells c JOIN (SELECT rec, unnest([start, stop]) AS t FROM ref) z ON z.rec = c.rec AND z.t - 0.25 <= c.start AND z.t + 0.25 >= c.stop),
k AS (SELECT c.rec, c.start, c.stop - c.start AS d, coalesce(r, []) AS r, coalesce(h, []) AS h, xs.rec IS NOT NULL AS x FROM cells c LEFT JOIN rs USING (rec, start) LEFT JOIN hs USING (rec, start) LEFT JOIN xs USING (rec, start)),
shared AS (SELECT rec, ref, hyp, sum(d) AS seconds FROM (SELECT rec, d, unnest(r) AS ref, h FROM k), LATERAL (SELECT unnest(h) AS hyp) GROUP BY rec, ref, hyp)"""

_SQL_MAPPED = f"""WITH RECURSIVE {_SQL_SIDES}, refs AS (SELECT rec, ref, row_number() OVER (PARTITION BY rec ORDER BY ref) AS n FROM (SELECT DISTINCT rec, ref FROM shared)),
t AS (SELECT DISTINCT rec, 0 AS n, CAST([] AS VARCHAR[]) AS used, CAST([] AS STRUCT(ref VARCHAR, hyp VARCHAR)[]) AS m, 0.0::DOUBLE AS total FROM shared
UNION ALL SELECT t.rec, t.n + 1, CASE WHEN s.hyp IS NULL THEN t.used ELSE list_append(t.used, s.hyp) END, CASE WHEN s.hyp IS NULL THEN t.m ELSE list_append(t.m, {{ref: r.ref, hyp: s.hyp}}) END, t.total + coalesce(s.seconds, 0)
  FROM t JOIN refs r ON r.rec = t.rec AND r.n = t.n + 1, LATERAL (SELECT hyp, seconds FROM shared s WHERE s.rec = r.rec AND s.ref = r.ref AND NOT list_contains(t.used, s.hyp) UNION ALL SELECT NULL, NULL) s),
best AS (SELECT rec, arg_max(m, round(total, 6)) AS m FROM t WHERE n = (SELECT max(n) FROM refs r WHERE r.rec = t.rec) GROUP BY rec)"""


def _sides(spark, sf_dir):
    seg = interval_queries._segments(spark, sf_dir)
    name = F.concat(F.lit("s"), F.length("label").cast("string"), F.left("label", F.lit(1)))
    hyp = seg.where("event_id % 3 <> 0").select("rec", name.alias("label"), (F.col("start") + 1).alias("start"), (F.col("stop") + 1).alias("stop"))
    return seg.select("rec", "label", "start", "stop"), hyp


@register(f"WITH {_SQL_SIDES} SELECT rec, ref, hyp, round(seconds, 6) AS seconds FROM shared")
def speaker_overlap(spark, sf_dir):
    cells = intervals.scored_cells(*_sides(spark, sf_dir), "rec", 0.25)
    return intervals.shared_seconds(cells, "rec").select("rec", "ref", "hyp", F.round("seconds", 6).alias("seconds"))


@register(f"{_SQL_MAPPED}, p AS (SELECT rec, unnest(m) AS x FROM best) SELECT rec, sum(seconds) AS seconds, count(*) AS pairs FROM (SELECT p.rec, round(s.seconds, 6) AS seconds FROM p JOIN shared s ON s.rec = p.rec AND s.ref = p.x.ref AND s.hyp = p.x.hyp) GROUP BY rec")
def speaker_mapping(spark, sf_dir):
    """The heaviest one-to-one mapping; as ties may be broken either way, its total is compared."""
    shared = intervals.shared_seconds(intervals.scored_cells(*_sides(spark, sf_dir), "rec", 0.25), "rec")
    joined = intervals.speaker_mapping(shared, "rec").join(shared, ["rec", "ref", "hyp"])
    return joined.groupBy("rec").agg(F.sum(F.round("seconds", 6)).alias("seconds"), F.count("*").alias("pairs"))


@register(f"""{_SQL_MAPPED}, j AS (SELECT k.rec, d, len(r) AS nr, len(h) AS nh, len(list_filter(coalesce(m, []), lambda p: list_contains(r, p.ref) AND list_contains(h, p.hyp))) AS a FROM k LEFT JOIN best USING (rec) WHERE NOT x AND len(r) < 2 AND len(r) + len(h) > 0),
s AS (SELECT rec, sum(d * nr) AS scored, sum(d * greatest(nr - nh, 0)) AS missed, sum(d * greatest(nh - nr, 0)) AS false_alarm, sum(d * (least(nr, nh) - a)) AS confused FROM j GROUP BY ROLLUP (rec))
SELECT coalesce(rec::VARCHAR, 'ALL') AS condition, round(scored, 3) AS scored, round(missed, 3) AS missed, round(false_alarm, 3) AS false_alarm, round(confused, 3) AS confused,
  round(CASE WHEN scored > 0 THEN 100 * (missed + false_alarm + confused) / scored WHEN missed + false_alarm + confused > 0 THEN 100 ELSE 0 END, 3) AS der FROM s""")
def der_report(spark, sf_dir):
    """Mapping, collars of a quarter second, overlapped speech left out, and the report by recording and over all."""
    found = intervals.diarization_report(*_sides(spark, sf_dir), "rec", collar=0.25, skip_overlap=True)
    return found.select("condition", *(F.round(c, 3).alias(c) for c in ("scored", "missed", "false_alarm", "confused", "der")))


@register(f"""WITH {_SQL_SIDES}, one AS (SELECT rec, label AS ref, CASE WHEN length(label) > 5 THEN 'long' ELSE 'short' END AS kind FROM ref GROUP BY ALL),
n AS (SELECT rec, start, d, (SELECT count(*) FROM (SELECT unnest(r) AS x) WHERE length(x) > 5) AS rl, (SELECT count(*) FROM (SELECT unnest(r) AS x) WHERE length(x) <= 5) AS rs, (SELECT count(*) FROM (SELECT unnest(h) AS x) WHERE x[2:2] > '5') AS hl, (SELECT count(*) FROM (SELECT unnest(h) AS x) WHERE x[2:2] <= '5') AS hs FROM k),
c AS (SELECT unnest([{{r: 'long', h: 'long', s: d * least(rl, hl)}}, {{r: 'long', h: 'short', s: d * least(rl, hs)}}, {{r: 'short', h: 'long', s: d * least(rs, hl)}}, {{r: 'short', h: 'short', s: d * least(rs, hs)}}]) AS x FROM n)
SELECT x.r AS ref_type, x.h AS sys_type, round(sum(x.s), 4) AS seconds FROM c GROUP BY ALL HAVING sum(x.s) > 0""")
def type_matrix(spark, sf_dir):
    """Seconds that speakers of a type on one side speak together with those of a type on the other."""
    ref, hyp = _sides(spark, sf_dir)
    cells = intervals.scored_cells(ref, hyp, "rec", 0.25)
    kinds = {"long": True, "short": False}
    several = lambda names, size, long: F.size(F.filter(names, lambda x: (size(x) > 5) == F.lit(long)))
    ref_size, hyp_size = F.length, lambda x: F.substring(x, 2, 1).cast("int")
    sized = cells.select("seconds", *(several("refs", ref_size, v).alias(f"r_{k}") for k, v in kinds.items()), *(several("hyps", hyp_size, v).alias(f"h_{k}") for k, v in kinds.items()))
    joint = F.array(*(F.struct(F.lit(r).alias("ref_type"), F.lit(h).alias("sys_type"), (F.col("seconds") * F.least(f"r_{r}", f"h_{h}")).alias("seconds")) for r in kinds for h in kinds))
    return sized.select(F.inline(joint)).groupBy("ref_type", "sys_type").agg(F.sum("seconds").alias("seconds")).where("seconds > 0").withColumn("seconds", F.round("seconds", 4))


@register(f"WITH {interval_queries._SQL_SEG} SELECT rec, label, round(sum(stop - start), 6) AS seconds FROM seg GROUP BY rec, label")
def speaker_seconds(spark, sf_dir):
    seg = interval_queries._segments(spark, sf_dir)
    return seg.groupBy("rec", "label").agg(F.round(F.sum(F.col("stop") - F.col("start")), 6).alias("seconds"))


@register("""SELECT vec_id, round(coalesce(list_sum(x), 0) / greatest(len(x), 1), 6) AS mean, round(list_max(x), 6) AS high, round(list_min(x), 6) AS low FROM (SELECT vec_id, list_transform(list_filter(embedding, lambda v, i: (i - 1) % 7 < vec_id % 7), lambda v: v::DOUBLE) AS x FROM embeddings)""")
def masked_axis(spark, sf_dir):
    """Mean, largest and smallest of the places under a mask; the mean of none is 0."""
    x = F.transform(F.filter("embedding", lambda v, i: i % 7 < F.pmod("vec_id", F.lit(7))), lambda v: v.cast("double"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size("x"), F.lit(1))
    return rows.select("vec_id", F.round(mean, 6).alias("mean"), F.round(F.array_max("x"), 6).alias("high"), F.round(F.array_min("x"), 6).alias("low"))


@register("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start, stop, label) AS k FROM (SELECT user_id AS rec, event_type AS label, (event_id * 37 % 3600)::DOUBLE AS start, (event_id * 37 % 3600) + round(least(abs(value), 60) + 0.5, 2) AS stop FROM events)),
f AS (SELECT rec, k, 1 AS turn, start AS s, stop AS e, label AS l, NULL::DOUBLE AS cut FROM o WHERE k = 1
UNION ALL SELECT o.rec, o.k, CASE WHEN o.label = f.l AND o.start <= f.e OR greatest(o.start, f.s) >= o.stop THEN f.turn ELSE f.turn + 1 END,
  CASE WHEN o.label = f.l AND o.start <= f.e OR greatest(o.start, f.s) >= o.stop THEN f.s WHEN o.label <> f.l AND o.start < f.e THEN (greatest(o.start, f.s) + least(f.e, o.stop)) / 2 ELSE o.start END,
  CASE WHEN o.label = f.l AND o.start <= f.e THEN greatest(f.e, o.stop) WHEN greatest(o.start, f.s) >= o.stop THEN f.e ELSE o.stop END,
  CASE WHEN o.label = f.l AND o.start <= f.e OR greatest(o.start, f.s) >= o.stop THEN f.l ELSE o.label END,
  CASE WHEN o.label <> f.l AND o.start < f.e AND greatest(o.start, f.s) < o.stop THEN (greatest(o.start, f.s) + least(f.e, o.stop)) / 2 END
  FROM f JOIN o ON o.rec = f.rec AND o.k = f.k + 1),
t AS (SELECT rec, turn, any_value(l) AS label, min(s) AS s, max(e) AS e, max(cut) AS cut FROM f GROUP BY rec, turn)
SELECT rec, turn - 1 AS turn, round(s, 6) AS start, round(coalesce(lead(cut) OVER (PARTITION BY rec ORDER BY turn), e), 6) AS stop, label FROM t""")
def rttm_merge(spark, sf_dir):
    turns = intervals.turns_to_rttm(interval_queries._segments(spark, sf_dir), "rec")
    return turns.select("rec", "turn", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "label")


@register("""WITH s AS (SELECT id, round(score, 9) AS score, target FROM (SELECT a.vec_id * 1000000 + b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS target FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 5))
SELECT count(*) AS n, round(avg(CASE WHEN (score > 0) = (target = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s""")
def gathered_accuracy(spark, sf_dir):
    """Scores and labels of all tasks in one metric: an ordinary aggregation."""
    right = (F.col("score") > 0) == (F.col("target") == 1)
    return speaker_queries._rounded(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"))
