"""Speakers: embeddings, trials, clusters, and the metrics on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import numeric as N
from tessitura.operators import clustering, joins, metrics, ordered, vectors

from . import register
from .tables import read

_SQL_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
#: Trials: every embedding against those up to five numbers later, so their count grows with the embeddings.
_SQL_TRIALS = f"SELECT a.vec_id * 1000000 + b.vec_id AS id, {_SQL_COS} AS score, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS target FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 5"


def _trials(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    left = rows.select("vec_id", "embedding", "label", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 5)).alias("other"))
    right = rows.select(F.col("vec_id").alias("other"), F.col("embedding").alias("b"), F.col("label").alias("b_label"))
    score = N.cosine(F.col("embedding"), F.col("b"))
    return left.join(right, "other").select((F.col("vec_id") * 1000000 + F.col("other")).alias("id"), score.alias("score"), (F.col("label") == F.col("b_label")).cast("int").alias("target"))


@register(f"SELECT id, round(score, 5) AS score, target FROM ({_SQL_TRIALS})")
def trial_scores(spark, sf_dir):
    return _trials(spark, sf_dir).select("id", F.round("score", 5).alias("score"), "target")


_SQL_CURVE = f"""s AS (SELECT id, round(score, 9) AS score, target FROM ({_SQL_TRIALS})), c AS (SELECT id, score, sum(target) OVER w / (SELECT sum(target) FROM s) AS fnr, 1 - sum(1 - target) OVER w / (SELECT sum(1 - target) FROM s) AS fpr FROM s
WINDOW w AS (ORDER BY score, id ROWS UNBOUNDED PRECEDING))"""


def _rounded(spark, sf_dir):
    return _trials(spark, sf_dir).withColumn("score", F.round("score", 9))


@register(f"WITH {_SQL_CURVE} SELECT id, round(fnr, 6) AS fnr, round(fpr, 6) AS fpr FROM c")
def det_points(spark, sf_dir):
    return metrics.trade_off(_rounded(spark, sf_dir)).select("id", F.round("fnr", 6).alias("fnr"), F.round("fpr", 6).alias("fpr"))


@register(f"""WITH {_SQL_CURVE}, x1 AS (SELECT * FROM c WHERE fnr >= fpr ORDER BY score, id LIMIT 1), x2 AS (SELECT * FROM c WHERE fnr < fpr ORDER BY score DESC, id DESC LIMIT 1)
SELECT round(x1.fnr + (x1.fnr - x1.fpr) / (x2.fpr - x1.fpr - (x2.fnr - x1.fnr)) * (x2.fnr - x1.fnr), 6) AS eer, round(x1.score, 6) AS threshold FROM x1, x2""")
def eer(spark, sf_dir):
    return metrics.equal_error_rate(_rounded(spark, sf_dir)).select(F.round("eer", 6).alias("eer"), F.round("threshold", 6).alias("threshold"))


@register(f"WITH {_SQL_CURVE} SELECT round(min(fnr * 0.01 + fpr * 0.99), 6) AS min_dcf, round(min(fnr * 0.01 + fpr * 0.99) / 0.01, 6) AS min_dcf_norm FROM c")
def min_dcf(spark, sf_dir):
    return metrics.detection_cost(_rounded(spark, sf_dir)).select(F.round("min_dcf", 6).alias("min_dcf"), F.round("min_dcf_norm", 6).alias("min_dcf_norm"))


@register(f"""WITH s AS (SELECT id, round(score, 9) AS score, target FROM ({_SQL_TRIALS})), r AS (SELECT target, row_number() OVER w AS n, sum(target) OVER w AS hits FROM s WINDOW w AS (ORDER BY score DESC, id DESC ROWS UNBOUNDED PRECEDING)),
h AS (SELECT n, max(hits / n) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best, target FROM r WHERE target = 1) SELECT round(sum(best) / count(*), 6) AS average_precision FROM h""")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_rounded(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


@register("SELECT label, count(*) AS n, array_to_string(list(vec_id ORDER BY vec_id), ' ') AS utts FROM embeddings GROUP BY label")
def spk2utt(spark, sf_dir):
    utts = F.array_sort(F.collect_list("vec_id"))
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.array_join(utts.cast("array<string>"), " ").alias("utts"))


@register("SELECT label, vec_id FROM embeddings")
def utt2spk(spark, sf_dir):
    listed = spk2utt(spark, sf_dir)
    return listed.select("label", F.explode(F.split("utts", " ").cast("array<bigint>")).alias("vec_id"))


@register("SELECT user_id, event_id, value FROM (SELECT *, sum(abs(value)) OVER (PARTITION BY user_id) AS total FROM events) WHERE total > 500")
def spk_min_duration(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    long = events.groupBy("user_id").agg(F.sum(F.abs("value")).alias("total")).where("total > 500")
    return events.join(long, "user_id", "left_semi").select("user_id", "event_id", "value")


@register("""SELECT label, pos, round(avg(v), 6) AS mean, round(sqrt(var_samp(v) + 1e-8), 6) AS deviation FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, pos""")
def centroid(spark, sf_dir):
    flat = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    return flat.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.sqrt(F.var_samp(v) + 1e-8), 6).alias("deviation"))


_SQL_CENTRES = "centres AS (SELECT label, list(m ORDER BY pos) AS centre FROM (SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, pos) GROUP BY label)"


@register(f"WITH {_SQL_CENTRES} SELECT vec_id, arg_max(c.label, round(list_cosine_similarity(embedding::DOUBLE[], centre), 9)) AS nearest, round(max(list_cosine_similarity(embedding::DOUBLE[], centre)), 6) AS similarity FROM embeddings, centres c GROUP BY vec_id")
def nearest_centroid(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    found = vectors.nearest(rows.select("vec_id", "embedding"), "embedding", vectors.centroids(rows, "label", "embedding"))
    return found.select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


@register(f"""WITH {_SQL_CENTRES}, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), cut AS (SELECT avg(n) AS m FROM sizes),
large AS (SELECT c.* FROM centres c JOIN sizes USING (label) WHERE n >= (SELECT m FROM cut))
SELECT vec_id, CASE WHEN e.label IN (SELECT label FROM large) THEN e.label ELSE (SELECT arg_max(l.label, list_cosine_similarity(e.embedding::DOUBLE[], l.centre)) FROM large l) END AS label FROM embeddings e""")
def small_cluster_reassign(spark, sf_dir):
    """Rows of small clusters go to the nearest large one; all get 0 if none is large."""
    rows = read(spark, sf_dir, "embeddings")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    marked = sizes.withColumn("large", F.col("n") >= F.avg("n").over(Window.partitionBy())).drop("n")
    large = vectors.centroids(rows, "label", "embedding").join(marked.where("large"), "label").select("label", "centre")
    found = vectors.nearest(rows.join(marked, "label").select("vec_id", "label", "embedding", "large"), "embedding", large)
    return found.select("vec_id", F.when(F.col("large"), F.col("label")).otherwise(F.coalesce("nearest", F.lit(0))).alias("label"))


@register(f"""SELECT rec, i, j, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim, j) AS k, count(*) OVER (PARTITION BY i) AS n FROM (
SELECT a.vec_id // 100 AS rec, a.vec_id AS i, b.vec_id AS j, round({_SQL_COS}, 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id // 100 = b.vec_id // 100)) WHERE k > least(CAST(floor(0.9 * n) AS BIGINT), n - 6)""")
def affinity_prune(spark, sf_dir):
    """Affinities within a recording, which has a hundred rows at most, however large the table is."""
    rows = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("rec"), "vec_id", "embedding")
    right = rows.select("rec", F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    pairs = rows.join(right, "rec").select("rec", F.col("vec_id").alias("i"), "j", F.round(N.cosine(F.col("embedding"), F.col("b")), 9).alias("sim"))
    order = Window.partitionBy("i")
    ranked = pairs.withColumn("k", F.row_number().over(order.orderBy("sim", "j"))).withColumn("n", F.count("*").over(order))
    return ranked.where(F.col("k") > F.least(F.floor(0.9 * F.col("n")), F.col("n") - 6)).select("rec", "i", "j", F.round("sim", 6).alias("sim"))


@register(f"SELECT a.vec_id, round(max({_SQL_COS}), 6) AS similarity, round(max(-ln(sqrt(greatest(2 - 2 * {_SQL_COS}, 0)) + 1e-8)), 6) AS spread FROM embeddings a JOIN embeddings b ON a.vec_id // 64 = b.vec_id // 64 AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def nearest_neighbour(spark, sf_dir):
    """The nearest other row of a batch of 64."""
    rows = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("batch"), "vec_id", "embedding")
    right = rows.select("batch", F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    near = rows.join(right, "batch").where("vec_id <> j").groupBy("vec_id").agg(F.max(N.cosine(F.col("embedding"), F.col("b"))).alias("s"))
    distance = F.sqrt(F.greatest(2 - 2 * F.col("s"), F.lit(0.0)))
    return near.select("vec_id", F.round("s", 6).alias("similarity"), F.round(-F.log(distance + 1e-8), 6).alias("spread"))


@register("""SELECT vec_id, label, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS relabelled FROM (SELECT *, min(vec_id) OVER (PARTITION BY label) AS f FROM embeddings)""")
def relabel_first_seen(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    firsts = rows.groupBy("label").agg(F.min("vec_id").alias("f"))
    numbered = firsts.select("label", (F.row_number().over(Window.orderBy("f")) - 1).alias("relabelled"))
    return rows.join(F.broadcast(numbered), "label").select("vec_id", "label", "relabelled")


@register("SELECT vec_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS relabelled FROM embeddings")
def relabel_sorted(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    numbered = rows.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("relabelled"))
    return rows.join(numbered, "label").select("vec_id", "relabelled")


@register("""SELECT conv_id, turn, role, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS INTEGER) AS relabelled FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations)""")
def role_indices(spark, sf_dir):
    return ordered.first_seen(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


_SQL_MARKS = "SELECT quality AS truth, toxic AS guess FROM labels"


@register(f"SELECT coalesce(truth::VARCHAR, 'all') AS truth, coalesce(guess::VARCHAR, 'all') AS guess, count(*) AS n FROM ({_SQL_MARKS}) GROUP BY CUBE (truth, guess)")
def confusion(spark, sf_dir):
    marks = read(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("guess"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return marks.cube("truth", "guess").agg(F.count("*").alias("n")).select(name("truth"), name("guess"), "n")


@register(f"""SELECT round(tp / (tp + fp + 1e-10), 6) AS precision, round(tp / (tp + fn + 1e-10), 6) AS recall, round(2 * tp / (2 * tp + fp + fn + 1e-10), 6) AS f1, round((tp + tn) / n, 6) AS accuracy FROM (
SELECT sum(CASE WHEN truth = 1 AND guess = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN truth = 0 AND guess = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN truth = 1 AND guess = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN truth = 0 AND guess = 0 THEN 1 ELSE 0 END) AS tn, count(*) AS n FROM ({_SQL_MARKS}))""")
def binary_metrics(spark, sf_dir):
    sums = metrics.binary_counts(F.col("quality"), F.col("toxic"))
    got = read(spark, sf_dir, "labels").agg(*(v.alias(k) for k, v in sums.items()), F.count("*").alias("n"))
    ratio = lambda a, b: F.round(a / (b + 1e-10), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return got.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.round((tp + tn) / F.col("n"), 6).alias("accuracy"))



@register("""SELECT coalesce(event_type, 'all') AS event_type, round(avg(abs(value - 10)), 6) AS mae, round(avg(abs(value - 10) / (abs(value) + 1)), 6) AS mre FROM events GROUP BY ROLLUP (event_type)""")
def per_language_error(spark, sf_dir):
    off = F.abs(F.col("value") - 10)
    got = read(spark, sf_dir, "events").rollup("event_type").agg(F.round(F.avg(off), 6).alias("mae"), F.round(F.avg(off / (F.abs("value") + 1)), 6).alias("mre"))
    return got.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "mae", "mre")


@register("SELECT arg_min(user_id, (m, user_id)) AS best, round(min(m), 6) AS error FROM (SELECT user_id, avg(abs(value - 10)) AS m FROM events GROUP BY user_id)")
def best_checkpoint(spark, sf_dir):
    means = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.abs(F.col("value") - 10)).alias("m"))
    return means.agg(F.min_by("user_id", F.struct("m", "user_id")).alias("best"), F.round(F.min("m"), 6).alias("error"))


@register("SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS mean FROM events GROUP BY event_type")
def weighted_mean(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id"), 6).alias("mean"))


@register("""SELECT vec_id, round(x / greatest(sqrt(m), 1e-12), 6) AS scaled FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding) AS m FROM embeddings)""")
def rms_gain(spark, sf_dir):
    x = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(x, F.lit(0)).cast("double") / F.greatest(F.sqrt(N.dot(x, x) / F.size(x)), F.lit(1e-12)), 6).alias("scaled"))


@register("""SELECT event_id, round((-0.08397278 * v + 1.22083953) * v + 0.0052439, 6) AS signal, round((-0.13166888 * v + 1.60915514) * v - 0.39604546, 6) AS background, round((-0.06766283 * v + 1.11546468) * v + 0.04602535, 6) AS overall FROM (SELECT event_id, abs(value) / 20 AS v FROM events)""")
def quality_mapping(spark, sf_dir):
    v = F.abs("value") / 20
    return read(spark, sf_dir, "events").select("event_id", *(F.round(N.polynomial(v, c), 6).alias(k) for k, c in N.QUALITY.items()))


@register("""WITH b AS (SELECT event_id, event_id % 10 AS l, event_id % 7 AS t, event_id % 10 + 5 AS r, event_id % 7 + 4 AS d FROM events)
SELECT event_id, round(i / (20 + 16 - i + 1e-5), 6) AS overlap FROM (SELECT event_id, greatest(least(r, 8) - greatest(l, 4), 0) * greatest(least(d, 6) - greatest(t, 2), 0) AS i FROM b)""")
def box_overlap(spark, sf_dir):
    x, y = F.pmod("event_id", F.lit(10)).cast("double"), F.pmod("event_id", F.lit(7)).cast("double")
    fixed = tuple(F.lit(v) for v in (4.0, 2.0, 8.0, 6.0))
    return read(spark, sf_dir, "events").select("event_id", F.round(N.box_overlap((x, y, x + 5, y + 4), fixed), 6).alias("overlap"))


@register("""WITH m AS (SELECT l_returnflag AS i, l_linestatus AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
r1 AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM m), c1 AS (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM r1),
r2 AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM c1), c2 AS (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM r2),
r3 AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM c2), c3 AS (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM r3) SELECT i, j, round(v, 6) AS v FROM c3""")
def balanced_matrix(spark, sf_dir):
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("i"), F.col("l_linestatus").alias("j")).agg(F.sum("l_quantity").alias("v"))
    for _ in range(3):
        for side in "ij":
            cells = cells.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy(side)))
    return cells.select("i", "j", F.round("v", 6).alias("v"))


@register("""SELECT vec_id, round(CASE WHEN label % 2 = 0 THEN m / n ELSE 1.0 END, 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM embeddings), (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))""")
def equalised_weights(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("m", F.max("n").over(Window.partitionBy()))
    return rows.join(F.broadcast(sizes), "label").select("vec_id", F.round(F.when(F.col("label") % 2 == 0, F.col("m") / F.col("n")).otherwise(F.lit(1.0)), 6).alias("weight"))


@register()
def spectral_labels(spark, sf_dir):
    return clustering.cluster(read(spark, sf_dir, "embeddings").withColumn("rec", F.floor(F.col("vec_id") / 100)), "rec", "vec_id", "embedding")


@register()
def average_link_labels(spark, sf_dir):
    return clustering.cluster(read(spark, sf_dir, "embeddings").withColumn("rec", F.floor(F.col("vec_id") / 100)), "rec", "vec_id", "embedding", method="average_link", merge=0.9)


@register("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def dedupe_or_fail(spark, sf_dir):
    checked = joins.require_unique(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return checked.groupBy("label").agg(F.count("*").alias("n"))


