"""Manifests: parsing, filters, joins, budgets, batches, rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import numeric as N
from tessitura.functions import text as T
from tessitura.operators import ordered
from tessitura.sources import manifests

from . import register
from .tables import read

#: Documents as manifest rows: 15 characters a second. By a double, for decimals are cut to a few places.
SECONDS = "n_chars / 15D"


def _rows(spark, sf_dir):
    return read(spark, sf_dir, "documents").withColumn("duration", F.expr(SECONDS))


@register("""SELECT doc_id AS path, CAST(n_chars AS DOUBLE) AS duration, CASE WHEN doc_id % 4 = 2 THEN 3.5 END AS mos, md5(replace(text, '|', ' ')) AS text
FROM documents WHERE doc_id % 4 IN (1, 2)""")
def manifest_parse(spark, sf_dir):
    text = F.replace("text", F.lit("|"), F.lit(" "))
    kind, path, seconds = F.pmod("doc_id", F.lit(4)), F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    line = F.when(kind == 0, path).when(kind == 1, F.concat_ws("|", path, seconds, text)).when(kind == 2, F.concat_ws("|", path, seconds, F.lit("3.5"), text)).otherwise(F.concat_ws("|", path, seconds, F.lit("1"), F.lit("2"), text))
    parsed = manifests.parse_lines(read(spark, sf_dir, "documents").select(line.alias("value")))
    return parsed.where("reject IS NULL").select(F.col("path").cast("long").alias("path"), "duration", "mos", F.md5("text").alias("text"))


@register("SELECT d.doc_id, quality AS mos FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL OR quality >= 1")
def mos_filter(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.where(F.col("quality").isNull() | (F.col("quality") >= 1)).select("doc_id", F.col("quality").alias("mos"))


@register("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def exists_semi(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@register("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def done_anti(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@register("SELECT lang, count(*) AS n, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, count(l.doc_id) AS n_found FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def sidecar_join(spark, sf_dir):
    side = read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("found"))
    joined = read(spark, sf_dir, "documents").join(side, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.when(F.col("found").isNull(), 1).otherwise(0)).alias("n_missing"), F.count("found").alias("n_found"))


@register("SELECT lang, count(*) AS n, round(sum(n_chars / 15.0) / 3600, 6) AS hours FROM documents GROUP BY lang")
def total_hours(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum("duration") / 3600, 6).alias("hours"))


@register("""SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM documents) WHERE s <= 50000""")
def budget_cutoff(spark, sf_dir):
    return ordered.budgeted(read(spark, sf_dir, "documents"), "lang", "doc_id", "n_chars", 50000).select("doc_id")


@register("""WITH r AS (SELECT doc_id, lang, n_chars, md5('7:' || doc_id) AS o FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY o) AS k FROM r),
t AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM n WHERE k > 10)
SELECT doc_id, lang, 'val' AS split FROM n WHERE k <= 10 UNION ALL SELECT doc_id, lang, 'train' FROM t WHERE s < 40000""")
def val_train_split(spark, sf_dir):
    split = ordered.validation_split(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars", 10, 40000, seed="7")
    return split.select("doc_id", "lang", "split")


@register("""SELECT bucket, count(*) AS n FROM (SELECT round_even(v / 0.25, 0) * 0.25 AS bucket FROM (SELECT len(regexp_extract_all(text, '\\S+')) / (n_chars / 15.0) AS v FROM documents)) WHERE bucket > 0 AND bucket <= 8 GROUP BY bucket""")
def rate_histogram(spark, sf_dir):
    rate = F.try_divide(F.regexp_count("text", F.lit(r"[^ \t\n\f\r]+")), "duration")  # no rate without characters
    return _rows(spark, sf_dir).select(N.rate_bucket(rate).cast("double").alias("bucket")).where("bucket > 0 AND bucket <= 8").groupBy("bucket").agg(F.count("*").alias("n"))


@register("""SELECT event_id, CAST(least(floor(greatest(abs(value), 0.25) / 0.25 - 1), 31) AS INTEGER) AS class FROM events""")
def class_index(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", N.rate_class(F.abs("value")).alias("class"))


@register("""WITH c AS (SELECT event_id, CAST(least(floor(greatest(abs(value), 0.25) / 0.25 - 1), 31) AS INTEGER) AS k FROM events),
w AS (SELECT event_id, k, list_transform(range(0, 32), lambda i: exp(-power(i - k, 2) / 2.0)) AS r FROM c)
SELECT event_id, round(r[k + 1] / list_sum(r), 6) AS peak, round(list_sum(list_transform(r, lambda v: v / list_sum(r))), 6) AS total FROM w""")
def soft_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", N.rate_class(F.abs("value")).alias("k"))
    soft = rows.select("event_id", "k", N.soft_labels(F.col("k")).alias("w"))
    return soft.select("event_id", F.round(F.get("w", F.col("k")), 6).alias("peak"), F.round(F.aggregate("w", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@register("""SELECT event_id, t AS frames FROM (SELECT event_id, CAST(floor(abs(value) * 24000 / 256) AS BIGINT) AS t FROM events)""")
def frame_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", N.frames(F.abs("value")).cast("long").alias("frames"))


@register("""WITH v AS (SELECT doc_id, CASE WHEN n_chars BETWEEN 200 AND 3000 THEN doc_id END AS ok FROM documents)
SELECT doc_id, coalesce(first_value(ok IGNORE NULLS) OVER (ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), (SELECT min(ok) FROM v)) AS used FROM v""")
def length_replace(spark, sf_dir):
    return ordered.substituted(read(spark, sf_dir, "documents"), "doc_id", F.col("n_chars").between(200, 3000))


@register("""WITH RECURSIVE r AS (SELECT source, doc_id, CAST(n_chars AS DOUBLE) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, n, k, CASE WHEN n <= 8000 THEN n ELSE 0 END AS used, CASE WHEN n <= 8000 THEN 1 ELSE 0 END AS c, 0 AS batch, n <= 8000 AS kept FROM r WHERE k = 1
UNION ALL SELECT r.source, r.doc_id, r.n, r.k,
 CASE WHEN f.used + r.n <= 8000 AND f.c < 16 THEN f.used + r.n WHEN r.n <= 8000 THEN r.n ELSE 0 END,
 CASE WHEN f.used + r.n <= 8000 AND f.c < 16 THEN f.c + 1 WHEN r.n <= 8000 THEN 1 ELSE 0 END,
 CASE WHEN f.used + r.n <= 8000 AND f.c < 16 THEN f.batch WHEN f.c > 0 THEN f.batch + 1 ELSE f.batch END, r.n <= 8000
 FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1)
SELECT source, doc_id, n AS n_chars, batch FROM f WHERE kept""")
def frame_batches(spark, sf_dir):
    return ordered.frame_batches(read(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 8000, 16)



@register("""WITH RECURSIVE b AS (SELECT doc_id, n_chars, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, n_chars, k, 0 AS batch, CASE WHEN n_chars >= 20000 THEN 0 ELSE n_chars END AS used, CASE WHEN n_chars >= 20000 THEN 1 ELSE 0 END AS next FROM b WHERE k = 1
UNION ALL SELECT b.source, b.doc_id, b.n_chars, b.k, f.next, CASE WHEN f.used + b.n_chars >= 20000 THEN 0 ELSE f.used + b.n_chars END, CASE WHEN f.used + b.n_chars >= 20000 THEN f.next + 1 ELSE f.next END FROM f JOIN b ON b.source = f.source AND b.k = f.k + 1)
SELECT source, doc_id, n_chars, batch FROM f""")
def flush_batches(spark, sf_dir):
    return ordered.flush_batches(read(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 20000)



@register("""SELECT d.doc_id, b.text AS target, l.quality AS prompt FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id LEFT JOIN labels l USING (doc_id)""")
def testset_join(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(40)).alias("item_id"))
    target = read(spark, sf_dir, "benchmark").withColumnRenamed("text", "target")
    return docs.join(target, "item_id").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "target", F.col("quality").alias("prompt"))


@register("""SELECT d.doc_id, coalesce(a.toxic, b.toxic) AS found FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id - 1""")
def fallback_lookup(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    first, second = labels.select("doc_id", F.col("toxic").alias("a")), labels.select((F.col("doc_id") + 1).alias("doc_id"), F.col("toxic").alias("b"))
    return read(spark, sf_dir, "documents").join(first, "doc_id", "left").join(second, "doc_id", "left").select("doc_id", F.coalesce("a", "b").alias("found"))


@register("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 8 AS worker, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / ((SELECT count(*) FROM orders) // 8 + 1)) AS BIGINT) AS block FROM orders")
def worker_shards(spark, sf_dir):
    keyed = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("all").alias("g"), F.lit(1).alias("one"))
    numbered = ordered.sum_before(keyed, "g", "o_orderkey", "one", "place", part=F.floor(F.col("o_orderkey") / 65536))
    size = numbered.groupBy("g").agg((F.floor(F.count("*") / 8) + 1).alias("size"))
    return numbered.join(F.broadcast(size), "g").select("o_orderkey", F.pmod("place", F.lit(8)).cast("long").alias("worker"), F.floor(F.col("place") / F.col("size")).alias("block"))


@register("""SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 5""")
def top_k(spark, sf_dir):
    order = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, sf_dir, "documents").withColumn("k", F.row_number().over(order)).where("k <= 5").select("lang", "doc_id", "n_chars")


@register("""SELECT role, batch, max(n) AS width, sum(n)::BIGINT AS filled, count(*) * max(n) - sum(n)::BIGINT AS padding FROM (SELECT role, conv_id // 8 AS batch, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations) GROUP BY role, batch""")
def collate_pad(spark, sf_dir):
    tokens = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    rows = read(spark, sf_dir, "conversations").select("role", F.floor(F.col("conv_id") / 8).alias("batch"), tokens.alias("t"))
    batches = rows.groupBy("role", "batch").agg(F.collect_list("t").alias("rows"), F.max(F.size("t")).alias("width"))
    padded = batches.select("role", "batch", "width", F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit("<pad>"), F.col("width") - F.size(r)))).alias("m"))
    cells = F.flatten("m")
    return padded.select("role", "batch", F.col("width").cast("long").alias("width"), F.size(F.filter(cells, lambda v: v != "<pad>")).cast("long").alias("filled"), F.size(F.filter(cells, lambda v: v == "<pad>")).cast("long").alias("padding"))


@register("""SELECT event_id, len(t) AS n, list_sum(list_transform(t, lambda v, i: v * i))::BIGINT AS checksum FROM (SELECT event_id, flatten(list_transform(range(0, c), lambda j: list_transform(range(0, l // c + CASE WHEN j >= c - l % c THEN 1 ELSE 0 END), lambda z: j))) AS t
FROM (SELECT event_id, event_id % 9 + 1 AS c, event_id % 50 + 9 AS l FROM events))""")
def upsample_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.pmod("event_id", F.lit(9)) + 1).cast("int").alias("c"), (F.pmod("event_id", F.lit(50)) + 9).cast("int").alias("l"))
    spread = rows.select("event_id", N.spread_tokens(F.col("c"), F.col("l")).alias("t"))
    total = F.aggregate(F.transform("t", lambda v, i: v * (i + 1)), F.lit(0), lambda s, v: s + v)
    return spread.select("event_id", F.size("t").cast("long").alias("n"), total.cast("long").alias("checksum"))


@register("""SELECT event_id, CAST(CASE WHEN p > 0 THEN round_even(p / (t - p) * k, 0) ELSE 0 END AS INTEGER) AS prefix FROM (SELECT event_id, (event_id % 40)::DOUBLE AS p, (event_id % 40 + 30)::DOUBLE AS t, event_id % 17 + 1 AS k FROM events)""")
def prefix_padding(spark, sf_dir):
    p = F.pmod("event_id", F.lit(40)).cast("double")
    return read(spark, sf_dir, "events").select("event_id", N.prefix_length(p, p + 30, F.pmod("event_id", F.lit(17)) + 1).alias("prefix"))


@register("""SELECT event_id, list_sum(m)::BIGINT AS ones, list_position(m, 1) AS first FROM (SELECT event_id, list_transform(range(0, 20), lambda i: CASE WHEN i >= event_id % 7 AND i < event_id % 7 + event_id % 11 + 1 THEN 1 ELSE 0 END) AS m FROM events)""")
def interval_masks(spark, sf_dir):
    start = F.pmod("event_id", F.lit(7))
    m = N.mask(start, start + F.pmod("event_id", F.lit(11)) + 1, F.lit(20))
    rows = read(spark, sf_dir, "events").select("event_id", m.alias("m"))
    return rows.select("event_id", F.aggregate("m", F.lit(0), lambda s, v: s + v).cast("long").alias("ones"), F.array_position("m", 1).cast("int").alias("first"))


@register("""SELECT item_id, octet_length(encode(text)) AS ref_bytes, 300 + CAST(floor(300.0 / octet_length(encode(text)) * 80 / 1.25) AS BIGINT) AS by_bytes,
  300 + CAST(floor(greatest(len(regexp_extract_all(text, '[,.?!;:。，、！？；：]')), 1) / greatest(2.5, 0.1) / 1.25 * 24000 / 256) AS BIGINT) AS by_rate FROM benchmark""")
def duration_estimate(spark, sf_dir):
    size = F.octet_length("text")
    by_rate = F.floor(F.greatest(T.punctuation_count(F.col("text")), F.lit(1)) / F.greatest(F.lit(2.5), F.lit(0.1)) / 1.25 * N.SAMPLE_RATE / N.HOP)
    return read(spark, sf_dir, "benchmark").select("item_id", size.cast("long").alias("ref_bytes"), (300 + F.floor(300.0 / size * 80 / 1.25)).alias("by_bytes"), (300 + by_rate).alias("by_rate"))


@register("""SELECT lang, avg(CASE WHEN n_chars < 60 OR n_chars > 20000 THEN 1.0 ELSE 0.0 END) > 0.1 AS over_budget FROM documents GROUP BY lang""")
def error_budget(spark, sf_dir):
    failed = (F.col("n_chars") < 60) | (F.col("n_chars") > 20000)
    return read(spark, sf_dir, "documents").groupBy("lang").agg((F.avg(failed.cast("int")) > 0.1).alias("over_budget"))


@register("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def content_cache(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@register("SELECT item_id, l AS lang FROM benchmark, (SELECT unnest(['en', 'fr', 'de']) AS l) WHERE l <> CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END")
def translation_targets(spark, sf_dir):
    source = F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr")
    return read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.array_remove(F.array(*(F.lit(x) for x in ("en", "fr", "de"))), source))).alias("lang"))


@register("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 7 ELSE 9 END AS steps, CASE p_partkey % 4 WHEN 0 THEN 0.1875 WHEN 1 THEN 0.1875 ELSE 3 / 9.0 END AS third FROM part""")
def step_schedule(spark, sf_dir):
    kind = F.pmod("p_partkey", F.lit(4))
    steps = F.when(kind == 0, 6).when(kind == 1, 7).otherwise(9)
    known = F.create_map(*(x for n, v in N.PRUNED_STEPS.items() for x in (F.lit(n), F.array(*(F.lit(float(y)) for y in v)))))
    pruned = F.transform(F.element_at(known, steps), lambda v: v / 32)
    even = F.transform(F.sequence(F.lit(0), steps), lambda i: i / steps)
    return read(spark, sf_dir, "part").select("p_partkey", steps.alias("steps"), F.get(F.coalesce(pruned, even), F.lit(3)).alias("third"))


@register("""SELECT 95282.0 * 3600 * 24000 / 256 AS frames, ceil(95282.0 * 3600 * 24000 / 256 / 307200) AS updates_per_epoch""")
def epoch_plan(spark, sf_dir):
    frames = F.lit(95282.0) * 3600 * N.SAMPLE_RATE / N.HOP
    return spark.range(1).select(frames.alias("frames"), F.ceil(frames / 307200).cast("double").alias("updates_per_epoch"))
