"""Summaries, picks, sets and windows that the other modules don't have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.operators import anchors

from . import interval_queries, register
from .tables import read


@register("""SELECT event_type, round(avg(value), 5) AS five, round(avg(value), 4) AS four, coalesce(avg(CASE WHEN value > 1e9 THEN value END), 0) AS empty, round(sum(CASE WHEN value > 10 THEN value ELSE 0 END) / sum(value), 6) AS share FROM events GROUP BY event_type""")
def mean_metrics(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.avg(v), 5).alias("five"), F.round(F.avg(v), 4).alias("four"), F.coalesce(F.avg(F.when(v > 1e9, v)), F.lit(0.0)).alias("empty"), F.round(F.sum(F.when(v > 10, v).otherwise(0)) / F.sum(v), 6).alias("share")
    )


@register("""SELECT count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS deviation, round(min(m), 6) AS low, round(max(m), 6) AS high FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id)""")
def clip_summary(spark, sf_dir):
    means = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    return means.agg(F.count("*").alias("n"), *(F.round(f("m"), 6).alias(n) for n, f in (("mean", F.avg), ("deviation", F.stddev_samp), ("low", F.min), ("high", F.max))))



@register("SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS word FROM documents) GROUP BY word) ORDER BY n DESC, word LIMIT 100")
def top_words(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@register("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")
def keep_last(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, sf_dir, "events").withColumn("k", F.row_number().over(order)).where("k <= 3").select("user_id", "event_id")


@register("SELECT doc_id FROM documents WHERE source NOT LIKE '%9%'")
def device_exclusion(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(~F.contains("source", F.lit("9"))).select("doc_id")


@register("SELECT e.event_id FROM events e JOIN (SELECT user_id, min(event_id) + 10 AS cut FROM events GROUP BY user_id) o USING (user_id) WHERE e.event_id >= o.cut")
def start_offset_cut(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    offsets = events.groupBy("user_id").agg((F.min("event_id") + 10).alias("cut"))
    return events.join(offsets, "user_id").where("event_id >= cut").select("event_id")


@register("SELECT doc_id, 1 AS kind FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 0 FROM labels WHERE toxic = 0")
def positives_then_negatives(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    return labels.where("toxic = 1").select("doc_id", F.lit(1).alias("kind")).unionByName(labels.where("toxic = 0").select("doc_id", F.lit(0).alias("kind")))


@register("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").exceptAll(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


@register("SELECT lower(c_mktsegment) AS word FROM customer UNION SELECT lower(p_brand) FROM part")
def vocabulary_union(spark, sf_dir):
    a, b = read(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("word")), read(spark, sf_dir, "part").select(F.lower("p_brand").alias("word"))
    return a.union(b).distinct()


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@register("SELECT n_nationkey, coalesce(map([0, 1, 2], ['a', 'b', 'c'])[n_regionkey], 'other') AS name, CASE n_name WHEN 'FRANCE' THEN 6 ELSE -1 END AS back FROM nation")
def map_lookups(spark, sf_dir):
    known = F.create_map(*(F.lit(x) for p in ((0, "a"), (1, "b"), (2, "c")) for x in p))
    inverse = F.map_from_entries(F.transform(F.map_entries(F.create_map(F.lit(6), F.lit("FRANCE"))), lambda e: F.struct(e["value"], e["key"])))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.element_at(known, F.col("n_regionkey")), F.lit("other")).alias("name"), F.coalesce(F.element_at(inverse, F.col("n_name")), F.lit(-1)).alias("back"))


@register("SELECT page_id, string_split(url, '/')[-1] AS name, string_split(url, '/')[3] AS host FROM pages")
def path_keys(spark, sf_dir):
    parts = F.split("url", "/")
    return read(spark, sf_dir, "pages").select("page_id", F.element_at(parts, -1).alias("name"), F.get(parts, F.lit(2)).alias("host"))


@register("SELECT vec_id, CAST(ceil(len(embedding) / 10.0) AS BIGINT) AS n, round(embedding[(95 - 1) % 64 + 1]::DOUBLE, 6) AS around FROM embeddings")
def circular_chunks(spark, sf_dir):
    """Chunks of ten places; the last one goes on from the start again."""
    n = F.ceil(F.size("embedding") / 10)
    padded = F.transform(F.sequence(F.lit(0), F.lit(94)), lambda i: F.get("embedding", F.pmod(i, F.size("embedding"))))
    return read(spark, sf_dir, "embeddings").select("vec_id", n.alias("n"), F.round(F.get(padded, F.lit(94)).cast("double"), 6).alias("around"))


@register("SELECT vec_id, len(s) AS n, round(list_sum(list_transform(s, lambda x: x[1]))::DOUBLE, 5) AS firsts FROM (SELECT vec_id, list_transform(range(0, 31), lambda i: list_transform(embedding[2 * i + 1:2 * i + 3], lambda v: v::DOUBLE)) AS s FROM embeddings)")
def frame_stacking(spark, sf_dir):
    """Three places every two."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    stacked = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.slice(x, i * 2 + 1, F.lit(3)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", stacked.alias("s"))
    return rows.select("vec_id", F.size("s").cast("long").alias("n"), F.round(F.aggregate(F.transform("s", lambda w: F.get(w, F.lit(0))), F.lit(0.0), lambda a, v: a + v), 5).alias("firsts"))


@register("SELECT vec_id, len(x) AS n, round(x[50], 6) AS middle, round(x[70], 6) AS late FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_resize(list_transform(embedding, lambda v: v::DOUBLE), 80, 0.0) ELSE list_transform(embedding[5:64], lambda v: v::DOUBLE) END AS x FROM embeddings)")
def crop_or_pad(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    fixed = F.when(F.pmod("vec_id", F.lit(2)) == 0, F.concat(x, F.array_repeat(F.lit(0.0), 80 - F.size(x)))).otherwise(F.slice(x, 5, 60))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", fixed.alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.get("x", F.lit(49)), 6).alias("middle"), F.round(F.get("x", F.lit(69)), 6).alias("late"))


@register("""SELECT conv_id, turn, length(text) - length(regexp_replace(text, '[.,?!]', '', 'g')) AS candidates, CASE WHEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role AND right(text, 1) IN ('.', ',', '?', '!') THEN 1 ELSE 0 END AS changes FROM conversations""")
def punctuation_labels(spark, sf_dir):
    """Labels by character: -100 where there is no mark, 1 at the last mark of a turn that another speaker follows, else 0."""
    follows = ~F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).eqNullSafe(F.col("role"))
    rows = read(spark, sf_dir, "conversations").withColumn("follows", follows).withColumn("chars", F.filter(F.split("text", ""), lambda c: c != ""))
    label = F.transform("chars", lambda c, i: F.when(~c.isin(".", ",", "?", "!"), -100).when(F.col("follows") & (i == F.size("chars") - 1), 1).otherwise(0))
    labelled = rows.select("conv_id", "turn", label.alias("y"))
    return labelled.select("conv_id", "turn", F.size(F.filter("y", lambda v: v >= 0)).cast("long").alias("candidates"), F.size(F.filter("y", lambda v: v == 1)).alias("changes"))


@register("""WITH RECURSIVE s AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '([;:,.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM benchmark),
f AS (SELECT item_id, parts, 1 AS k, CAST([] AS VARCHAR[]) AS done, '' AS open FROM s
UNION ALL SELECT item_id, parts, k + 1, CASE WHEN octet_length(encode(open)) + octet_length(encode(parts[k])) <= 100 OR open = '' THEN done ELSE list_append(done, trim(open)) END,
 CASE WHEN octet_length(encode(open)) + octet_length(encode(parts[k])) <= 100 THEN open || parts[k] || ' ' ELSE parts[k] || ' ' END FROM f WHERE k <= len(parts))
SELECT item_id, array_to_string(list_append(done, trim(open)), '|') AS chunks FROM f WHERE k = len(parts) + 1""")
def text_chunks(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.chunks_within(F.col("text"), 100), "|").alias("chunks"))


@register("""WITH a AS (SELECT user_id, event_id AS t, value AS v FROM events WHERE event_type = 'click'), e AS (SELECT user_id, event_id AS t FROM events WHERE event_type <> 'click'),
j AS (SELECT e.user_id, e.t, (SELECT max(t) FROM a WHERE a.user_id = e.user_id AND a.t <= e.t) AS lt, (SELECT min(t) FROM a WHERE a.user_id = e.user_id AND a.t >= e.t) AS ht FROM e)
SELECT j.user_id, j.t, round(CASE WHEN lt IS NOT NULL AND ht IS NOT NULL THEN l.v + (h.v - l.v) * CASE WHEN ht > lt THEN (j.t - lt)::DOUBLE / (ht - lt) ELSE 0 END WHEN lt IS NOT NULL THEN l.v + j.t - lt WHEN ht IS NOT NULL THEN h.v + j.t - ht END, 6) AS found
FROM j LEFT JOIN a l ON l.user_id = j.user_id AND l.t = j.lt LEFT JOIN a h ON h.user_id = j.user_id AND h.t = j.ht""")
def nearest_anchors(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("t"), F.col("value").alias("v"), "event_type")
    found = anchors.between_anchors(events.where("event_type <> 'click'").select("user_id", "t"), events.where("event_type = 'click'"), "user_id")
    return found.select("user_id", "t", F.round("found", 6).alias("found"))


@register("SELECT user_id, event_type, arg_max(event_id, (value, event_id)) AS best FROM events GROUP BY user_id, event_type")
def best_word(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best"))



@register(f"""SELECT rec, CASE WHEN scored > 0 THEN round(100 * (missed + false_alarm + confused) / scored, 4) WHEN missed + false_alarm + confused > 0 THEN 100.0 ELSE 0.0 END AS der FROM ({interval_queries._SQL_DER})""")
def der_rates(spark, sf_dir):
    errors = F.col("missed") + F.col("false_alarm") + F.col("confused")
    rate = F.when(F.col("scored") > 0, F.round(100 * errors / F.col("scored"), 4)).when(errors > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return interval_queries.der_totals(spark, sf_dir).select("rec", rate.alias("der"))


@register("SELECT doc_id FROM documents WHERE trim(regexp_replace(text, '[a-z]', '', 'g')) <> ''")
def non_empty_output(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.trim(F.regexp_replace("text", "[a-z]", "")) != "").select("doc_id")


@register("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_id % 7 <> 0 GROUP BY event_type")
def nan_scores_dropped(spark, sf_dir):
    score = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return read(spark, sf_dir, "events").withColumn("score", score).where(~F.isnan("score")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@register("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS target FROM events")
def trial_labels(spark, sf_dir):
    """1 or target, 0 or nontarget; anything else is an error."""
    written = F.element_at(F.array(*(F.lit(x) for x in ("1", "target", "0", "nontarget"))), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", written.alias("label"))
    target = F.when(F.col("label").isin("1", "target"), 1).when(F.col("label").isin("0", "nontarget"), 0).otherwise(F.raise_error(F.concat(F.lit("unknown label "), "label")).cast("int"))
    return rows.select("event_id", target.alias("target"))



@register("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def speaker_join(spark, sf_dir):
    return read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")

