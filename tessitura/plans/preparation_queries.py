"""Preparation: ranges and rejects, side-cars, candidates by length, batches, spans, prefixes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import numeric as N
from tessitura.functions import text as T
from tessitura.operators import joins, ordered

from . import register, sql
from .tables import read

#: Frames of 3 and 31 seconds, between which prompts are.
LOW, HIGH = 3 * N.SAMPLE_RATE // N.HOP, 31 * N.SAMPLE_RATE // N.HOP


def _total(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") * N.SAMPLE_RATE / N.HOP / 15).alias("frames"))


_SQL_TOTAL = f"t AS (SELECT doc_id, CAST(floor(n_chars * {N.SAMPLE_RATE} / {N.HOP} / 15) AS BIGINT) AS frames FROM documents)"


@register(f"WITH {_SQL_TOTAL} SELECT doc_id, CASE WHEN frames NOT BETWEEN {LOW} AND {HIGH} THEN 'duration ' || (frames * {N.HOP} // {N.SAMPLE_RATE}) || 's out of range [3, 31]' END AS reject FROM t")
def length_range(spark, sf_dir):
    """Rows out of range aren't dropped in silence: they say why they are rejected."""
    seconds = F.floor(F.col("frames") * N.HOP / N.SAMPLE_RATE).cast("string")
    reject = F.when(~F.col("frames").between(LOW, HIGH), F.concat(F.lit("duration "), seconds, F.lit("s out of range [3, 31]")))
    return _total(spark, sf_dir).select("doc_id", reject.alias("reject"))


@register(f"""WITH RECURSIVE {_SQL_TOTAL}, k AS (SELECT *, CAST(floor((frames - {LOW}) / {HIGH - LOW + 1}.0 * 200) AS BIGINT) AS bucket FROM t WHERE frames BETWEEN {LOW} AND {HIGH}),
b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS k FROM k),
f AS (SELECT bucket, doc_id, frames, k, 0 AS batch, CASE WHEN frames >= 4000 THEN 0 ELSE frames END AS used, CASE WHEN frames >= 4000 THEN 1 ELSE 0 END AS next FROM b WHERE k = 1
UNION ALL SELECT b.bucket, b.doc_id, b.frames, b.k, f.next, CASE WHEN f.used + b.frames >= 4000 THEN 0 ELSE f.used + b.frames END, CASE WHEN f.used + b.frames >= 4000 THEN f.next + 1 ELSE f.next END FROM f JOIN b ON b.bucket = f.bucket AND b.k = f.k + 1)
SELECT bucket, doc_id, frames, batch FROM f""")
def length_buckets(spark, sf_dir):
    """Prompts in 200 buckets of length, each cut into batches that are closed once they have 4000 frames; leftovers are batches too."""
    rows = _total(spark, sf_dir).where(F.col("frames").between(LOW, HIGH))
    bucket = F.floor((F.col("frames") - LOW) / (HIGH - LOW + 1) * 200)
    return ordered.flush_batches(rows.withColumn("bucket", bucket), "bucket", "doc_id", "frames", 4000)


@register("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS k FROM documents),
f AS (SELECT source, doc_id, k, 0 AS batch, greatest(20000 // n_chars, 1) AS room FROM o WHERE k = 1
UNION ALL SELECT o.source, o.doc_id, o.k, CASE WHEN f.room > 1 THEN f.batch ELSE f.batch + 1 END, CASE WHEN f.room > 1 THEN f.room - 1 ELSE greatest(20000 // o.n_chars, 1) END FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, doc_id, batch FROM f""")
def falling_batches(spark, sf_dir):
    return ordered.falling_batches(read(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 20000)


_SQL_SIZES = "s AS (SELECT doc_id, source, octet_length(encode(text)) AS n, text FROM documents)"


@register(f"""WITH {_SQL_SIZES} SELECT a.doc_id, list(b.doc_id ORDER BY b.n, b.doc_id)[1 + (a.doc_id * 7919) % count(*)] AS chosen, count(*) AS n_candidates
FROM s a JOIN s b ON a.source = b.source AND b.n BETWEEN 0.1 * a.n AND 0.4 * a.n GROUP BY a.doc_id""")
def pair_by_length(spark, sf_dir):
    """Each document with one of a tenth to two fifths of its bytes. Candidates are counted, never listed."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("n"))
    found = joins.pick_in_range(rows, rows, "source", "doc_id", "n", 0.1 * F.col("n"), 0.4 * F.col("n"), F.col("doc_id") * 7919)
    return found.where("n_candidates > 0").select("doc_id", "chosen", "n_candidates")


_SQL_CUT = "array_to_string(list_filter(w, lambda x, i: list_sum(list_transform(list_filter(w, lambda v, j: j <= i), lambda u: octet_length(encode(u)) + 1)) <= budget), ' ')"


@register(f"""WITH {_SQL_SIZES}, none AS (SELECT * FROM s a WHERE n < 400 AND NOT EXISTS (SELECT 1 FROM s b WHERE a.source = b.source AND b.n BETWEEN 0.1 * a.n AND 0.4 * a.n)),
c AS (SELECT a.doc_id, floor(any_value(0.4 * a.n)) AS budget, list(b.doc_id ORDER BY b.n, b.doc_id)[1 + (a.doc_id * 7919) % count(*)] AS chosen FROM none a JOIN s b ON a.source = b.source AND b.n >= 0.4 * a.n GROUP BY a.doc_id),
w AS (SELECT c.doc_id, chosen, budget, list_filter(string_split_regex(substring(s.text, 1, CAST(2 * budget + 2 AS INTEGER)), '\\s+'), lambda x: x <> '') AS w FROM c JOIN s ON s.doc_id = chosen)
SELECT doc_id, chosen, {_SQL_CUT} AS cut FROM w""")
def fallback_candidates(spark, sf_dir):
    """Short documents without a candidate of the right length get a longer one, cut by words to the bytes they may have."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("n"), "text")
    first = joins.pick_in_range(rows.drop("text"), rows.drop("text"), "source", "doc_id", "n", 0.1 * F.col("n"), 0.4 * F.col("n"), F.col("doc_id") * 7919)
    none = first.where("n_candidates = 0 AND n < 400").select("doc_id", "source", "n")
    longer = joins.pick_in_range(none, rows.drop("text"), "source", "doc_id", "n", 0.4 * F.col("n"), F.lit(float(1 << 40)), F.col("doc_id") * 7919).where("n_candidates > 0")
    budget = F.floor(0.4 * F.col("n"))
    texts = rows.select(F.col("doc_id").alias("chosen"), "text")
    cut = T.words_within(F.substring(F.col("text"), F.lit(1), (2 * budget + 2).cast("int")), budget)
    return longer.join(texts, "chosen").select("doc_id", "chosen", cut.alias("cut"))


@register("SELECT c_custkey, replace(c_name || ' of ' || c_mktsegment, ' ', '_') AS label FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def listed_labels(spark, sf_dir):
    """Ids of a list with a field of another file, blanks as underscores."""
    label = F.replace(F.concat("c_name", F.lit(" of "), "c_mktsegment"), F.lit(" "), F.lit("_"))
    listed = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(listed, "c_custkey", "left_semi").select("c_custkey", label.alias("label"))


@register("SELECT 'rec_' || label AS rec, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY label")
def recordings_of_keys(spark, sf_dir):
    """Keys end in a start and a stop; what comes before names the recording."""
    key = F.concat_ws("_", F.lit("rec"), F.col("label").cast("string"), (F.col("vec_id") / 2).cast("string"), (F.col("vec_id") / 2 + 1.5).cast("string"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", key.alias("key"))
    return rows.groupBy(F.regexp_replace("key", "_[^_]*_[^_]*$", "").alias("rec")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@register("SELECT n_regionkey, pos::BIGINT AS pos, list_sort(list(n_name))[pos] AS test, list_reverse_sort(list(n_name))[pos] AS ref FROM nation, (SELECT unnest(range(1, 6)) AS pos) GROUP BY n_regionkey, pos")
def positional_pairs(spark, sf_dir):
    """Two lists of one length, paired by place; lists of different lengths are an error."""
    names = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("test"), F.sort_array(F.collect_list("n_name"), asc=False).alias("ref"))
    return joins.positional(names, "test", "ref").select("n_regionkey", F.col("pos").cast("long").alias("pos"), "test", "ref")


@register("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'af' WHEN 1 THEN 'am' WHEN 2 THEN 'as' WHEN 3 THEN 'eu' ELSE 'me' END AS code FROM nation")
def strict_codes(spark, sf_dir):
    """A map that must have every key."""
    known = dict(enumerate(("af", "am", "as", "eu", "me")))
    return read(spark, sf_dir, "nation").select("n_nationkey", T.strict_lookup(F.col("n_regionkey"), known).alias("code"))


@register("SELECT 'out/gt_' || d.doc_id || '.wav' || '|' || md5(d.text) AS line FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)")
def listed_pairs(spark, sf_dir):
    """Lines of file and text for the texts whose file is there; keys lose what comes before their first underscore."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("test_"), F.col("doc_id").cast("string")).alias("utt"), "text")
    there = read(spark, sf_dir, "labels").select(F.concat(F.lit("out/gt_"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("file"))
    keyed = docs.withColumn("file", F.concat(F.lit("out/gt_"), F.regexp_extract("utt", "^[^_]*_(.*)$", 1), F.lit(".wav")))
    return keyed.join(there, "file", "left_semi").select(F.concat_ws("|", "file", F.md5("text")).alias("line"))


@register("SELECT conv_id, turn, role AS lang, trim(text) AS text FROM conversations WHERE turn % 3 <> 1 AND trim(text) <> ''")
def manual_spans(spark, sf_dir):
    """Spans of a language and a text; those whose text is blank go."""
    text = F.when(F.pmod("turn", F.lit(3)) == 1, F.lit("  \n ")).otherwise(F.col("text"))
    spans = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.col("role").alias("lang"), text.alias("text"))).alias("spans"))
    kept = F.transform(F.filter("spans", lambda s: F.trim(F.regexp_replace(s["text"], r"^\s+|\s+$", "")) != ""), lambda s: F.struct(s["turn"], s["lang"], F.trim(s["text"]).alias("text")))
    return spans.select("conv_id", F.inline(kept).alias("turn", "lang", "text"))


@register(f"""WITH u AS (SELECT event_id, event_id % 9 AS units, CASE WHEN event_id % 9 < 4 THEN least(1.25, 0.5) ELSE 1.25 END AS speed, abs(value) / 10 AS rate FROM events)
SELECT event_id, 300 + CAST(floor(greatest(1.0, units / greatest(rate, 0.1) / speed) * {N.SAMPLE_RATE} / {N.HOP}) AS BIGINT) AS frames FROM u""")
def short_text_duration(spark, sf_dir):
    """Texts under four units are spoken at half speed at most, and none is shorter than a second."""
    units = F.pmod("event_id", F.lit(9))
    return read(spark, sf_dir, "events").select("event_id", (300 + N.spoken_frames(units, F.abs("value") / 10, F.lit(1.25))).alias("frames"))


@register("SELECT d.doc_id, md5(b.text || '_ _' || d.text) AS total, d.n_chars * 24000 / 256 / 15.0 + coalesce(l.quality, 0) * 100 AS frames FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id LEFT JOIN labels l USING (doc_id)")
def prompted_texts(spark, sf_dir):
    """Prompt and text in one, and frames as a ratio: those of the duration and of the prompt where there is one."""
    docs = read(spark, sf_dir, "documents").withColumn("item_id", F.pmod("doc_id", F.lit(40)))
    joined = docs.join(read(spark, sf_dir, "benchmark").withColumnRenamed("text", "prompt"), "item_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    frames = F.col("n_chars") * N.SAMPLE_RATE / N.HOP / 15.0 + F.coalesce(F.col("quality"), F.lit(0)) * 100
    return joined.select("doc_id", F.md5(F.concat("prompt", F.lit("_ _"), "text")).alias("total"), frames.alias("frames"))


@register("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), d AS (SELECT * FROM o WHERE event_id % 3 <> 0),
g AS (SELECT user_id, k, value, lead(k, 1, k + 1) OVER w AS nk, lead(value, 1, value) OVER w AS nv FROM d WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, p AS k, round(value + (nv - value) * (p - k) / (nk - k), 6) AS value FROM (SELECT *, unnest(range(k, nk)) AS p FROM g)""")
def interpolation(spark, sf_dir):
    """Frames without a detection between two with one lie on the line between them; every gap is filled."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    seen = read(spark, sf_dir, "events").select("user_id", "event_id", "value", F.row_number().over(order).cast("long").alias("k")).where("event_id % 3 <> 0")
    return ordered.interpolated(seen, "user_id", "k", "value").select("user_id", "k", F.round("value", 6).alias("value"))


@register("""WITH t AS (SELECT event_id, event_id % 40 AS p, event_id % 17 AS n, (event_id % 40 + 30)::DOUBLE AS l FROM events), q AS (SELECT *, CASE WHEN p > 0 AND n > 0 THEN CAST(round_even(p / (l - p) * n, 0) AS BIGINT) ELSE 0 END AS c FROM t)
SELECT event_id, array_to_string(list_concat(CASE WHEN c > 0 THEN list_concat(list_transform(range(0, c), lambda i: 7), [8, 9]) ELSE [] END, range(0, n)), ',') AS tokens FROM q""")
def prefixed_tokens(spark, sf_dir):
    """Prefix tokens as many as the prompt's share asks for, anchor tokens, then the text's own."""
    prompt, n = F.pmod("event_id", F.lit(40)), F.pmod("event_id", F.lit(17))
    own = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    rows = read(spark, sf_dir, "events").select("event_id", prompt.cast("double").alias("p"), own.alias("t"))
    tokens = N.prefixed(F.col("t"), F.col("p"), F.col("p") + 30, F.lit(7).cast("long"), F.array(F.lit(8).cast("long"), F.lit(9).cast("long")))
    return rows.select("event_id", F.array_join(tokens.cast("array<string>"), ",").alias("tokens"))


@register("""SELECT conv_id, role AS voice, array_to_string(list(first ORDER BY first), ',') AS firsts, md5(string_agg(text, chr(10) ORDER BY first)) AS texts FROM (SELECT conv_id, first, any_value(role) AS role, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, max(CASE WHEN prior IS DISTINCT FROM role THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS first
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations)) GROUP BY conv_id, first) GROUP BY conv_id, role""")
def voices(spark, sf_dir):
    """Neighbouring segments of a voice as one; then each voice's segments, in their order."""
    return ordered.by_voice(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select(
        "conv_id", "voice", F.array_join(F.transform("segments", lambda s: s["first"].cast("string")), ",").alias("firsts"), F.md5(F.array_join(F.transform("segments", lambda s: s["text"]), "\n")).alias("texts")
    )


@register(f"""SELECT page_id, md5({sql.squeezed('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[\\[\\](){}]', ' ', 'g'),
  ',(\\S)', 'ˌ\\1', 'g'), ',$', 'ˌ'), '[&ㄜでかすπ%@]', '', 'g'), '\\|+', '|', 'g'), ' \\| ', ' ', 'g'), '^\\||\\|$', '', 'g')''')}) AS cleaned FROM (SELECT page_id, regexp_replace(replace(html, ',,', ', '), '\\s+', ' ', 'g') AS html FROM pages)""")
def post_clean(spark, sf_dir):
    html = F.regexp_replace(F.replace("html", F.lit(",,"), F.lit(", ")), r"\s+", " ")  # the SQL has no look-ahead for two commas in a row
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.post_clean(html)).alias("cleaned"))


@register(f"""SELECT doc_id, md5(array_to_string(CASE doc_id % 3 WHEN 0 THEN {sql.tokens_v6('text')} WHEN 1 THEN flatten(list_transform(regexp_extract_all({sql.single_blanks("text")}, ' |[^ |]+'), lambda x: CASE WHEN regexp_full_match(x, '[^0-9]+[0-9]+') THEN [regexp_extract(x, '^([^0-9]+)', 1), regexp_extract(x, '([0-9]+)$', 1)] ELSE [x] END)) ELSE [] END, chr(1))) AS digest FROM documents""")
def tokens_by_version(spark, sf_dir):
    """The tokenizer is chosen by its version; one that isn't known gives no tokens."""
    version = F.element_at(F.array(*(F.lit(x) for x in ("ipa_v6", "ipa_v3", "ipa_v9"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.tokens(F.col("text"), version), "\x01")).alias("digest"))


@register(f"""WITH t AS (SELECT item_id, {sql.tokens_v6(sql.clean('text'))} AS tokens FROM benchmark), v AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT token FROM (SELECT unnest(tokens) AS token FROM t) GROUP BY token HAVING count(*) >= 2)),
m AS (SELECT map(list(token), list(id)) AS m FROM v), f AS (SELECT item_id, flatten(list_transform(tokens, lambda x: CASE WHEN m[x] IS NULL AND x <> '…' THEN list_filter(string_split(x, ''), lambda c: c <> '') ELSE [x] END)) AS pieces, m FROM t, m)
SELECT item_id, array_to_string(list_transform(pieces, lambda x: coalesce(m[x], 0)), ',') AS ids FROM f""")
def ordered_ids(spark, sf_dir):
    """Ids in the order of the text; of tokens that aren't known those of their characters, 0 for these if they aren't known either."""
    docs = read(spark, sf_dir, "benchmark").select("item_id", T.tokens_v6(T.clean_text(F.col("text"))).alias("tokens"))
    known = docs.select(F.explode("tokens").alias("token")).groupBy("token").count().where("count >= 2").select("token", F.row_number().over(Window.orderBy("token")).cast("long").alias("id"))
    ids = joins.looked_up(docs, "item_id", "tokens", known)
    return ids.select("item_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@register("""SELECT item_id, lower(replace(regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g'), '  ', ' ')) AS en, array_to_string(string_split(replace(regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g'), '  ', ' '), ''), ' ') AS zh FROM benchmark""")
def listed_punctuation(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "benchmark").select("item_id", T.normalise_by_list(text, F.lit("en")).alias("en"), T.normalise_by_list(text, F.lit("zh")).alias("zh"))


@register("SELECT event_id, round((least(floor(greatest(abs(value), 0.25) / 0.25 - 1), 31) + 1) * 0.25, 6) AS rate FROM events")
def class_rates(spark, sf_dir):
    """Classes and back: the rate that a class stands for."""
    return read(spark, sf_dir, "events").select("event_id", N.class_rate(N.rate_class(F.abs("value"))).alias("rate"))


@register("""SELECT vec_id, round(list_max(list_transform(x, lambda v: greatest(least(v * g, 1), -1))), 6) AS clipped, round(list_max(list_transform(x, lambda v: CASE WHEN abs(v * g) <= 0.8 THEN v * g ELSE sign(v) * (0.8 + 0.2 * ((exp(2 * ((abs(v * g) - 0.8) / 0.2)) - 1) / (exp(2 * ((abs(v * g) - 0.8) / 0.2)) + 1))) END)), 6) AS limited
FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, 5.0 AS g FROM embeddings)""")
def limited_gain(spark, sf_dir):
    """Samples after a gain: clipped, and with a soft limiter."""
    x = F.transform("embedding", lambda v: v.cast("double") * 5.0)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    return rows.select("vec_id", F.round(F.array_max(F.transform("x", lambda v: N.clipped(v))), 6).alias("clipped"), F.round(F.array_max(F.transform("x", lambda v: N.limited(v))), 6).alias("limited"))


@register("SELECT event_id, (event_id * 37 + 5) // 10 / 100.0 AS seconds FROM events")
def rounded_seconds(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", N.seconds(F.col("event_id") * 37).alias("seconds"))


@register("""SELECT user_id, event_type, count(*) AS n, max(event_id) - min(event_id) AS span FROM events GROUP BY user_id, event_type HAVING count(*) > 1 AND max(event_id) - min(event_id) >= 500 AND avg(abs(value)) > 5""")
def kept_tracks(spark, sf_dir):
    """Tracks with several detections, long and large enough."""
    tracks = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.max("event_id") - F.min("event_id")).alias("span"), F.avg(F.abs("value")).alias("size"))
    return tracks.where("n > 1 AND span >= 500 AND size > 5").select("user_id", "event_type", "n", "span")


@register("""SELECT frame, arg_max(event_id, active) AS face FROM (SELECT event_id // 4 AS frame, event_id, CASE WHEN value > 10 THEN 1 ELSE 0 END AS active, event_id % 10 / 10.0 AS quality FROM events) GROUP BY frame HAVING sum(active) = 1 AND max(CASE WHEN active = 1 THEN quality END) >= 0.7""")
def active_faces(spark, sf_dir):
    """Frames with exactly one active face, if its quality is good enough."""
    rows = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("frame"), "event_id", F.when(F.col("value") > 10, 1).otherwise(0).alias("active"), (F.pmod("event_id", F.lit(10)) / 10).alias("quality"))
    found = rows.groupBy("frame").agg(F.sum("active").alias("n"), F.max_by("event_id", "active").alias("face"), F.max(F.when(F.col("active") == 1, F.col("quality"))).alias("quality"))
    return found.where("n = 1 AND quality >= 0.7").select("frame", "face")


_SQL_ENDS = "s AS (SELECT conv_id, list(e ORDER BY turn) AS ends FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS e FROM conversations) GROUP BY conv_id)"


@register(f"""WITH RECURSIVE {_SQL_ENDS}, f AS (SELECT conv_id, ends, 0::BIGINT AS i, 1 AS w FROM s UNION ALL SELECT conv_id, ends, len(list_filter(ends, lambda e: e < ends[i + 1] + 320)), w + 1 FROM f WHERE len(list_filter(ends, lambda e: e < ends[i + 1] + 320)) < len(ends)),
g AS (SELECT conv_id, w, i, least(len(list_filter(ends, lambda e: e < CASE WHEN i = 0 THEN 0 ELSE ends[i] END + 960)), len(ends) - 1) AS last, ends, max(w) OVER (PARTITION BY conv_id) AS m FROM f)
SELECT conv_id, w AS "window", CASE WHEN w < m THEN i WHEN ends[-1] >= 960 THEN len(list_filter(ends, lambda e: e <= ends[-1] - 960)) ELSE 0 END AS first, CASE WHEN w < m THEN last ELSE len(ends) - 1 END AS last FROM g""")
def sentence_windows(spark, sf_dir):
    return ordered.length_windows(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 960, 320)
