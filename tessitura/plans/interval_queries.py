"""Intervals: segments, runs, sweeps and who-spoke-when scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import numeric as N
from tessitura.operators import intervals, joins, ordered
from tessitura.sources import manifests

from . import register
from .tables import read

#: Events as labelled intervals of a recording, in seconds of an hour so that they overlap.
_SQL_SEG = "seg AS (SELECT user_id AS rec, event_id, event_type AS label, (event_id * 37 % 3600)::DOUBLE AS start, (event_id * 37 % 3600) + round(least(abs(value), 60) + 0.5, 2) AS stop FROM events)"


def _segments(spark, sf_dir):
    start = F.pmod(F.col("event_id") * 37, F.lit(3600)).cast("double")
    stop = start + F.round(F.least(F.abs("value"), F.lit(60)) + 0.5, 2)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), "event_id", F.col("event_type").alias("label"), start.alias("start"), stop.alias("stop"))


@register(f"""WITH {_SQL_SEG}, n AS (SELECT *, greatest(CAST(ceil((stop - start - 1.5) / 0.75) AS BIGINT), 0) AS fits FROM seg),
r AS (SELECT rec, round(start + k * 0.75, 2) AS a, round(start + k * 0.75 + 1.5, 2) AS b FROM (SELECT *, unnest(range(0, fits)) AS k FROM n)
UNION ALL SELECT rec, round(greatest(least(stop - 1.5, start + fits * 0.75), start), 2), round(stop, 2) FROM n WHERE start + fits * 0.75 < stop) SELECT DISTINCT rec, a AS start, b AS stop FROM r""")
def subsegments(spark, sf_dir):
    windows = _segments(spark, sf_dir).select("rec", F.explode(N.sub_starts(F.col("start"), F.col("stop"), 1.5, 0.75)).alias("w"))
    return windows.select("rec", "w.start", "w.stop").distinct()


@register(f"""WITH {_SQL_SEG} SELECT event_id, k, k * 3.0 AS start, least((k + 1) * 3.0, stop - start) AS stop FROM (SELECT *, unnest(range(0, greatest(1, CAST(floor((stop - start) / 3) AS BIGINT)))) AS k FROM seg)""")
def fixed_chunks(spark, sf_dir):
    n = F.greatest(F.lit(1), F.floor((F.col("stop") - F.col("start")) / 3))
    rows = _segments(spark, sf_dir).select("event_id", (F.col("stop") - F.col("start")).alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    return rows.select("event_id", "k", (F.col("k") * 3.0).alias("start"), F.least((F.col("k") + 1) * 3.0, F.col("d")).alias("stop"))


_SQL_MERGED = f"""WITH {_SQL_SEG}, f AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY rec ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM seg),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY rec ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM f)"""


@register(_SQL_MERGED + " SELECT rec, min(start) AS start, max(stop) AS stop FROM i GROUP BY rec, island")
def merge_regions(spark, sf_dir):
    return intervals.merged(_segments(spark, sf_dir), "rec").select("rec", "start", "stop")



@register(f"WITH {_SQL_SEG} SELECT rec AS file, '0' AS channel, round(start, 2) AS start, round(round(start, 2) + round(stop - start, 2), 2) AS stop, label AS speaker FROM seg")
def rttm_roundtrip(spark, sf_dir):
    lines = manifests.rttm_lines(_segments(spark, sf_dir), "rec")
    back = manifests.read_rttm(lines)
    return back.select(F.col("file").cast("long").alias("file"), "channel", "start", F.round("stop", 2).alias("stop"), "speaker")


@register(f"WITH {_SQL_SEG} SELECT rec, min(start) AS start, max(stop) AS stop FROM seg GROUP BY rec")
def default_regions(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("rec").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


@register(f"""WITH {_SQL_SEG}, o AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label OR start - lag(start) OVER w > 120 THEN 1 ELSE 0 END AS fresh FROM seg WINDOW w AS (PARTITION BY rec ORDER BY start, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY rec ORDER BY start, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT rec, run::BIGINT AS run, any_value(label) AS label, min(start) AS start, max(start) AS stop FROM r GROUP BY rec, run HAVING max(start) - min(start) >= 1e-4""")
def run_segments(spark, sf_dir):
    w = Window.partitionBy("rec").orderBy("start", "event_id")
    fresh = ~F.lag("label").over(w).eqNullSafe(F.col("label")) | (F.col("start") - F.lag("start").over(w) > 120)
    marked = _segments(spark, sf_dir).withColumn("fresh", fresh)
    numbered = ordered.runs(marked, "rec", F.col("fresh"), ("start", "event_id"))
    return numbered.groupBy("rec", "run").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("start").alias("stop")).where("stop - start >= 1e-4")


@register(f"""WITH {_SQL_SEG} SELECT rec, event_id, v_label, round(shared, 6) AS shared FROM (SELECT a.rec, a.event_id, b.label AS v_label, sum(least(a.stop, b.stop) - greatest(a.start, b.start)) AS shared FROM seg a JOIN seg b ON a.rec = b.rec AND a.event_id <> b.event_id AND a.stop > b.start AND b.stop > a.start
GROUP BY a.rec, a.event_id, b.label) WHERE shared > 0.5""")
def overlap_join(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    other = seg.select("rec", F.col("event_id").alias("v_id"), F.col("label").alias("v_label"), F.col("start").alias("v_start"), F.col("stop").alias("v_stop"))
    pairs = joins.overlap_join(seg, other, "rec", 60.0).where("event_id <> v_id")
    shared = F.sum(F.least("stop", "v_stop") - F.greatest("start", "v_start"))
    return pairs.groupBy("rec", "event_id", "v_label").agg(shared.alias("shared")).where("shared > 0.5").select("rec", "event_id", "v_label", F.round("shared", 6).alias("shared"))


_SQL_SWEEP = f"""WITH {_SQL_SEG}, b AS (SELECT DISTINCT rec, unnest([start, stop]) AS t FROM seg), cells AS (SELECT rec, t AS start, lead(t) OVER (PARTITION BY rec ORDER BY t) AS stop FROM b),
act AS (SELECT c.rec, c.start, c.stop, list_sort(list_distinct(list(s.label))) AS labels FROM cells c JOIN seg s ON s.rec = c.rec AND s.start <= c.start AND s.stop >= c.stop WHERE c.stop IS NOT NULL GROUP BY ALL)"""


@register(_SQL_SWEEP + " SELECT rec, start, stop, array_to_string(labels, ',') AS labels FROM act")
def event_sweep(spark, sf_dir):
    return intervals.active(_segments(spark, sf_dir), "rec", "label").select("rec", "start", "stop", F.array_join("labels", ",").alias("labels"))


@register(_SQL_SWEEP + " SELECT rec, round(sum(stop - start), 6) AS kept FROM act WHERE len(labels) < 2 GROUP BY rec")
def overlap_exclude(spark, sf_dir):
    cells = intervals.active(_segments(spark, sf_dir), "rec", "label").where(F.size("labels") < 2)
    return cells.groupBy("rec").agg(F.round(F.sum(F.col("stop") - F.col("start")), 6).alias("kept"))


@register(f"""WITH {_SQL_SEG}, z AS (SELECT DISTINCT rec, unnest([start, stop]) AS t FROM seg), c AS (SELECT rec, t - 0.25 AS start, t + 0.25 AS stop FROM z),
f AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY rec ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM c),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY rec ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM f), m AS (SELECT rec, min(start) AS start, max(stop) AS stop FROM i GROUP BY rec, island)
SELECT rec, stop AS start, next AS stop FROM (SELECT rec, stop, lead(start) OVER (PARTITION BY rec ORDER BY start) AS next FROM m) WHERE next IS NOT NULL""")
def collar_exclude(spark, sf_dir):
    ends = _segments(spark, sf_dir).select("rec", F.explode(F.array("start", "stop")).alias("t")).distinct()
    collars = intervals.merged(ends.select("rec", (F.col("t") - 0.25).alias("start"), (F.col("t") + 0.25).alias("stop")), "rec")
    w = Window.partitionBy("rec").orderBy("start")
    return collars.select("rec", F.col("stop").alias("start"), F.lead("start").over(w).alias("stop")).where("stop IS NOT NULL")


_SQL_DER = f"""WITH {_SQL_SEG}, b AS (SELECT DISTINCT rec, unnest([start, stop]) AS t FROM (SELECT rec, start, stop FROM seg UNION ALL SELECT rec, start + 1, stop + 1 FROM seg WHERE event_id % 3 <> 0)),
cells AS (SELECT rec, t AS start, lead(t) OVER (PARTITION BY rec ORDER BY t) AS stop FROM b),
ref AS (SELECT c.rec, c.start, count(DISTINCT s.label) AS n FROM cells c JOIN seg s ON s.rec = c.rec AND s.start <= c.start AND s.stop >= c.stop GROUP BY c.rec, c.start),
hyp AS (SELECT c.rec, c.start, count(DISTINCT s.label) AS n FROM cells c JOIN (SELECT rec, label, start + 1 AS start, stop + 1 AS stop FROM seg WHERE event_id % 3 <> 0) s ON s.rec = c.rec AND s.start <= c.start AND s.stop >= c.stop GROUP BY c.rec, c.start),
agree AS (SELECT c.rec, c.start, count(DISTINCT s.label) AS n FROM cells c JOIN seg s ON s.rec = c.rec AND s.start <= c.start AND s.stop >= c.stop JOIN (SELECT rec, label, start + 1 AS start, stop + 1 AS stop FROM seg WHERE event_id % 3 <> 0) h ON h.rec = c.rec AND h.label = s.label AND h.start <= c.start AND h.stop >= c.stop GROUP BY c.rec, c.start),
j AS (SELECT c.rec, c.stop - c.start AS d, coalesce(r.n, 0) AS r, coalesce(h.n, 0) AS h, coalesce(a.n, 0) AS a FROM cells c LEFT JOIN ref r USING (rec, start) LEFT JOIN hyp h USING (rec, start) LEFT JOIN agree a USING (rec, start) WHERE c.stop IS NOT NULL)
SELECT rec, round(sum(d * r), 4) AS scored, round(sum(d * greatest(r - h, 0)), 4) AS missed, round(sum(d * greatest(h - r, 0)), 4) AS false_alarm, round(sum(d * (least(r, h) - a)), 4) AS confused FROM j GROUP BY rec"""


@register(_SQL_DER)
def der_totals(spark, sf_dir):
    """Speakers are named alike on both sides here, so the mapping is the identity."""
    ref = _segments(spark, sf_dir)
    hyp = ref.where("event_id % 3 <> 0").withColumn("start", F.col("start") + 1).withColumn("stop", F.col("stop") + 1)
    named = ref.withColumn("who", F.concat(F.lit("r:"), "label")).unionByName(hyp.withColumn("who", F.concat(F.lit("h:"), "label")))
    cells = intervals.active(named.select("rec", "who", "start", "stop"), "rec", "who")
    side = lambda s: F.transform(F.filter("labels", lambda x: x.startswith(s)), lambda x: F.substr(x, F.lit(3)))
    d = F.col("stop") - F.col("start")
    sized = cells.select("rec", d.alias("d"), side("r:").alias("rs"), side("h:").alias("hs")).select("rec", "d", F.size("rs").alias("r"), F.size("hs").alias("h"), F.size(F.array_intersect("rs", "hs")).alias("a"))
    zero = F.lit(0)
    return sized.groupBy("rec").agg(
        F.round(F.sum(F.col("d") * F.col("r")), 4).alias("scored"),
        F.round(F.sum(F.col("d") * F.greatest(F.col("r") - F.col("h"), zero)), 4).alias("missed"),
        F.round(F.sum(F.col("d") * F.greatest(F.col("h") - F.col("r"), zero)), 4).alias("false_alarm"),
        F.round(F.sum(F.col("d") * (F.least("r", "h") - F.col("a"))), 4).alias("confused"),
    )



@register("""SELECT conv_id, turn, text || CASE WHEN right(text, 1) IN ('.', '!', '?', ',') THEN '' WHEN lead(role) OVER w IS DISTINCT FROM role THEN '.' ELSE ',' END AS repaired FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def punct_repair(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    mark = F.when(F.right("text", F.lit(1)).isin(".", "!", "?", ","), "").when(~F.lead("role").over(w).eqNullSafe(F.col("role")), ".").otherwise(",")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", mark).alias("repaired"))


@register("""SELECT conv_id, turn, before FROM (SELECT *, lag(role) OVER w AS prior, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE prior <> role""")
def change_points(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("prior"), "role", before.alias("before")).where("prior <> role").select("conv_id", "turn", "before")



@register("""SELECT user_id, event_id, round(CASE WHEN n = 1 THEN value ELSE s / c END, 6) AS smooth FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER o AS k FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) e,
LATERAL (SELECT 1) x, LATERAL (SELECT sum(value) AS s, count(*) AS c FROM (SELECT value, row_number() OVER (ORDER BY event_id) AS j FROM events f WHERE f.user_id = e.user_id) WHERE j BETWEEN e.k - 2 AND least(e.k + 2, e.n - 1)) y WHERE e.n > 0""")
def centred_smoothing(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("event_id")
    near = order.rowsBetween(-2, 2)
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "value", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    inner = F.when(F.col("k") < F.col("n"), F.col("value"))  # the last value is in no mean
    return rows.select("user_id", "event_id", F.round(F.when(F.col("n") == 1, F.col("value")).otherwise(F.avg(inner).over(near)), 6).alias("smooth"))



@register(f"WITH {_SQL_SEG} SELECT event_id, unnest(range(0, greatest(CAST(floor((stop - start) * 100) AS BIGINT) - 500, 0), 300)) AS start FROM seg")
def noise_clips(spark, sf_dir):
    last = F.floor((F.col("stop") - F.col("start")) * 100) - 500
    starts = F.when(last > 0, F.sequence(F.lit(0).cast("long"), last - 1, F.lit(300).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return _segments(spark, sf_dir).select("event_id", F.explode(starts).alias("start"))


@register("SELECT user_id, event_type, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id, event_type")
def entity_spans(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


@register("""SELECT conv_id, first, string_agg(text, ' ' ORDER BY turn) AS text FROM (SELECT conv_id, turn, role, text, max(CASE WHEN prior IS DISTINCT FROM role THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations)) GROUP BY conv_id, first""")
def same_voice_merge(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    fresh = ~F.lag("role").over(w).eqNullSafe(F.col("role"))
    marked = read(spark, sf_dir, "conversations").withColumn("first", F.when(fresh, F.col("turn"))).withColumn("first", F.max("first").over(w))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return marked.groupBy("conv_id", "first").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


@register("""SELECT conv_id, turn, part, t[greatest(part * 200 - s, 0) + 1 : least((part + 1) * 200, s + n) - s] AS piece FROM (SELECT conv_id, turn, text AS t, n, s, unnest(range(s // 200, (s + n - 1) // 200 + 1)) AS part FROM (SELECT *, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM conversations) WHERE n > 0)""")
def span_slices(spark, sf_dir):
    """Turns laid end to end and cut into slices of 200 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.char_length("text").alias("n"), F.coalesce(F.sum(F.char_length("text")).over(w), F.lit(0)).alias("s")).where("n > 0")
    cut = rows.select("*", F.explode(F.sequence(F.floor(F.col("s") / 200), F.floor((F.col("s") + F.col("n") - 1) / 200))).alias("part"))
    a, b = F.greatest(F.col("part") * 200 - F.col("s"), F.lit(0)), F.least((F.col("part") + 1) * 200, F.col("s") + F.col("n")) - F.col("s")
    return cut.select("conv_id", "turn", "part", F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")).alias("piece"))
