"""Text: cleaning, tokens, vocabulary, filters, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.operators import ordered

from . import register, sql
from .tables import read


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, lang and n: how often each token is in the documents of a language.

    No token but the blank goes beyond a word. So words are counted first, on
    the map side, only distinct ones are cut into tokens, and blanks are counted
    in the text.
    """
    docs = read(spark, sf_dir, "documents").select("lang", T.clean_text(F.col("text")).alias("text"))
    words = docs.select("lang", F.explode(F.split("text", " ")).alias("word")).where("word <> ''").groupBy("word", "lang").agg(F.count("*").alias("n"))
    inside = words.select("lang", "n", F.explode_outer(T.tokens_v6(F.col("word"))).alias("token")).where("token IS NOT NULL")
    blanks = docs.select("lang", T.blanks_v6(F.col("text")).cast("long").alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0").withColumn("token", F.lit(" "))
    return inside.unionByName(blanks).groupBy("token", "lang").agg(F.sum("n").alias("n"))


def _numbered(tokens: DataFrame) -> DataFrame:
    """token and id: numbers from 1 in the order of the tokens, counted by their first signs."""
    ranked = ordered.sum_before(tokens.select("token", F.lit(1).alias("all"), F.lit(1).cast("long").alias("one")), "all", "token", "one", part=F.substring("token", 1, 2))
    return ranked.select("token", (F.col("before") + 1).alias("id"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", T.tokens_v6(T.clean_text(F.col("text"))).alias("tokens"))
    # outer, for the plain form is given a filter on the array's size, which would tokenise everything twice
    return docs.select("doc_id", "lang", F.explode_outer("tokens").alias("token")).where("token IS NOT NULL")


_SQL_TOKENS = f"SELECT doc_id, lang, unnest({sql.tokens_v6(sql.clean('text'))}) AS token FROM documents"


@register(f"""WITH t AS ({_SQL_TOKENS})
SELECT token, count(*) AS total_count, count(DISTINCT lang) AS num_langs, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages FROM t GROUP BY token""")
def token_stats(spark, sf_dir):
    by_lang = _weighted(spark, sf_dir)
    return by_lang.groupBy("token").agg(
        F.sum("n").alias("total_count"), F.count("lang").alias("num_langs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages")
    )


@register(f"""WITH t AS (SELECT DISTINCT token FROM ({_SQL_TOKENS}))
SELECT token, row_number() OVER (ORDER BY token) AS id FROM t UNION ALL SELECT '<pad>', 0""")
def vocab(spark, sf_dir):
    tokens = _weighted(spark, sf_dir).select("token").distinct()
    return _numbered(tokens).unionByName(spark.createDataFrame([(T.PAD, 0)], "token string, id long"))


@register(f"""WITH t AS (SELECT doc_id, lang, pos, tokens[pos] AS token FROM (SELECT doc_id, lang, tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM (SELECT doc_id, lang, {sql.tokens_v6(sql.clean('text'))} AS tokens FROM documents))),
known AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT token FROM t GROUP BY token HAVING count(*) >= 5)),
pieces AS (SELECT doc_id, unnest(CASE WHEN known.id IS NULL AND t.token <> '…' THEN string_split(t.token, '') ELSE [t.token] END) AS piece FROM t LEFT JOIN known USING (token))
SELECT doc_id, count(*) AS n_ids, CAST(sum(coalesce(known.id, 0)) AS BIGINT) AS id_sum, count(*) - count(known.id) AS n_unknown FROM pieces LEFT JOIN known ON piece = known.token GROUP BY doc_id""")
def token_ids(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    known = _numbered(_weighted(spark, sf_dir).groupBy("token").agg(F.sum("n").alias("n")).where("n >= 5").select("token"))
    first = tokens.join(known, "token", "left")
    pieces = first.select("doc_id", F.explode(F.when(F.col("id").isNull() & (F.col("token") != T.ELLIPSIS), F.filter(F.split("token", ""), lambda x: x != "")).otherwise(F.array("token"))).alias("piece"))
    return pieces.join(known.withColumnRenamed("token", "piece"), "piece", "left").groupBy("doc_id").agg(
        F.count("*").alias("n_ids"), F.sum(F.coalesce("id", F.lit(0))).alias("id_sum"), (F.count("*") - F.count("id")).alias("n_unknown")
    )


@register(f"""SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, chr(1))) AS digest FROM (
SELECT doc_id, flatten(list_transform(regexp_extract_all({sql.single_blanks("replace(text, ',', '|')")}, ' |[^ |]+'), lambda x: CASE WHEN regexp_full_match(x, '[^0-9]+[0-9]+') THEN [regexp_extract(x, '^([^0-9]+)', 1), regexp_extract(x, '([0-9]+)$', 1)] ELSE [x] END)) AS tokens FROM documents)""")
def tokens_v3(spark, sf_dir):
    tokens = T.tokens_v3(F.replace("text", F.lit(","), F.lit("|")))
    return read(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "\x01")).alias("digest"))


@register(f"SELECT doc_id, md5({sql.clean('text')}) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("cleaned"))



@register("""SELECT doc_id, md5(CASE WHEN t = '' THEN t ELSE upper(t[1]) || t[2:] END) AS normalised FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '!!', '!'), '¡¡', '¡'), '!,', '!'), '!.', '!'), '?,', '?'), '?.', '?'), '-', ' '),
  '[„“»«”]', '"', 'g'), '#', ''), '*', ' '), '\\s+([.,!?;:])', '\\1', 'g'), '([¡¿])\\s+', '\\1', 'g') AS t FROM documents)""")
def tts_normalise(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise_for_speech(F.col("text"))).alias("normalised"))


@register(f"""SELECT doc_id, md5({sql.squeezed("regexp_replace(lower(CASE WHEN lang IN ('zh', 'ja', 'ko', 'th', 'de') THEN array_to_string(string_split(text, ''), ' ') ELSE text END), '[\\p{P}\\p{S}]', '', 'g')")}) AS normalised FROM documents""")
def wer_normalise(spark, sf_dir):
    lang = F.when(F.col("lang") == "de", "xx-th").otherwise(F.col("lang"))  # German stands in for a language without blanks
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise_for_wer(F.col("text"), lang)).alias("normalised"))


@register("""SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, regexp_extract_all(text, '\\p{L}+(?:[''’]\\p{L}+)*') AS w FROM documents)""")
def pronounced_words(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", T.pronounced_words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words"))


@register("""SELECT doc_id, CAST(CASE WHEN lang = 'fr' THEN len(regexp_extract_all(text, '\\p{L}+(?:[''’]\\p{L}+)*')) WHEN lang = 'en' THEN len(regexp_extract_all(text, '[一-鿿]')) END AS BIGINT) AS n_syllables,
  len(regexp_extract_all(text, '[,.?!;:。，、！？；：]')) AS n_punctuation FROM documents""")
def syllable_units(spark, sf_dir):
    lang = F.when(F.col("lang") == "fr", "vi").when(F.col("lang") == "en", "zh").otherwise(F.col("lang"))  # stand-ins for languages without a dictionary
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.syllables(text, lang).cast("long").alias("n_syllables"), T.punctuation_count(text).cast("long").alias("n_punctuation"))


@register("""SELECT doc_id FROM documents WHERE regexp_full_match(text, '[\\p{L}\\s\\p{Z}''",.?!;:。，、！？；：「」『』【】\\-]*')""")
def charset_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(T.only_valid_characters(F.col("text"), F.col("lang"))).select("doc_id")


@register("""SELECT item_id, max(n) > 10 AS repeats FROM (SELECT item_id, g, count(*) AS n FROM (
  SELECT item_id, substring(text, CAST(unnest(range(1, length(text))) AS BIGINT), 2) AS g FROM benchmark) GROUP BY item_id, g) GROUP BY item_id""")
def repetition_filter(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.repeats_itself(F.col("text")).alias("repeats"))


@register("""SELECT doc_id, CASE lang WHEN 'zh' THEN 'cmn' WHEN 'en' THEN 'en-us' WHEN 'fr' THEN 'fr-fr' WHEN 'pt' THEN 'pt-br' ELSE lang END AS phonemizer,
  nullif(split_part(replace(lower(trim(' ' || upper(lang) || '_' || source)), '_', '-'), '-', 1), '') AS code FROM documents""")
def language_codes(spark, sf_dir):
    tag = F.concat(F.lit(" "), F.upper("lang"), F.lit("_"), F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", T.phonemizer_code(F.col("lang")).alias("phonemizer"), T.language_code(tag).alias("code"))


@register("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 3 THEN source ELSE 'main' END AS voice,
  CASE WHEN doc_id % 4 = 3 THEN NULL ELSE lang END AS lang FROM documents""")
def voice_tags(spark, sf_dir):
    kind = F.pmod("doc_id", F.lit(4))
    tag = F.when(kind == 0, F.concat_ws("|", "source", "lang")).when(kind == 1, F.concat(F.lit("lang:"), "lang")).when(kind == 2, F.upper("lang")).otherwise(F.col("source"))
    tagged = read(spark, sf_dir, "documents").select("doc_id", F.trim(tag).alias("tag"))
    marked = F.lower("tag").rlike("^lang[:=]")
    code = T.language_code(F.regexp_replace("tag", "^(?i)lang[:=]", ""))
    bare = T.language_code(F.col("tag")).rlike("^[a-z]{2,3}$")
    voice = F.when(F.contains("tag", F.lit("|")), F.coalesce(F.nullif(F.trim(F.split_part("tag", F.lit("|"), F.lit(1))), F.lit("")), F.lit("main"))).when(marked | bare, "main").otherwise(F.col("tag"))
    lang = F.when(F.contains("tag", F.lit("|")), T.language_code(F.split_part("tag", F.lit("|"), F.lit(2)))).when(marked | bare, code)
    return tagged.select("doc_id", voice.alias("voice"), lang.alias("lang"))


@register("SELECT item_id, CASE WHEN text = '' OR suffix(text, '. ') OR suffix(text, '。') THEN text WHEN suffix(text, '.') THEN text || ' ' ELSE text || '. ' END AS prompt FROM benchmark")
def end_sentence(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.end_sentence(F.col("text")).alias("prompt"))


@register("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g')[1:80] AS name, regexp_extract(url, '([^/]*)$', 1) AS stem FROM pages")
def safe_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.substring(F.regexp_replace("url", "[^A-Za-z0-9_.-]", "_"), 1, 80).alias("name"), F.regexp_extract("url", "([^/]*)$", 1).alias("stem"))


@register("SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w, i: w <> '' AND list_sum(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda v, j: j <= i), lambda u: octet_length(encode(u)) + 1)) <= 60), ' ') AS cut FROM benchmark")
def truncate_bytes(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.words_within(F.col("text"), F.lit(60)).alias("cut"))


@register("""SELECT doc_id, pos - 1 AS pos, md5(parts[pos]) AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (
  SELECT doc_id, regexp_extract_all(replace(text, chr(10), ' '), '[^.?!]*[.?!]|[^.?!]+$') AS parts FROM documents))""")
def sentence_split(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", T.sentences(F.replace("text", F.lit("\n"), F.lit(" ")), ".?!").alias("parts"))
    return docs.select("doc_id", F.posexplode("parts").alias("pos", "part")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("part").alias("part"))


@register("""SELECT vec_id, 'rec_' || label AS wav, start, stop FROM (SELECT vec_id, label, vec_id % 7 / 2.0 AS start, vec_id % 7 / 2.0 + 1.5 AS stop FROM embeddings)""")
def key_parts(spark, sf_dir):
    start = F.pmod("vec_id", F.lit(7)) / 2
    keyed = read(spark, sf_dir, "embeddings").select("vec_id", F.concat_ws("_", F.lit("rec"), "label", start.cast("string"), (start + 1.5).cast("string")).alias("key"))
    pattern = "^(.*)_([^_]*)_([^_]*)$"
    return keyed.select("vec_id", F.regexp_extract("key", pattern, 1).alias("wav"), F.regexp_extract("key", pattern, 2).cast("double").alias("start"), F.regexp_extract("key", pattern, 3).cast("double").alias("stop"))


@register("""SELECT doc_id, length(text) AS n_chars, octet_length(encode(text)) AS n_bytes, len(regexp_extract_all(text, '\\S+')) AS n_words FROM documents""")
def text_lengths(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_words"))


@register("""SELECT conv_id, turn, md5(trim(replace(replace(replace(text || '<sil><%>', '<sil>', ''), '<%>', ''), '<->', ''))) AS plain FROM conversations""")
def markup_removed(spark, sf_dir):
    marked = F.concat("text", F.lit("<sil><%>"))
    plain = F.trim(T.replaced(marked, [("<sil>", ""), ("<%>", ""), ("<->", "")]))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.when(~plain.rlike("<sil>|<%>"), plain).otherwise(F.raise_error(F.lit("markup is left")))).alias("plain"))


@register("""WITH c AS (SELECT item_id, pos, t[pos:pos] AS ch, CASE WHEN regexp_full_match(t[pos:pos], '[一-鿿]') THEN 'cjk' WHEN regexp_full_match(t[pos:pos], '[가-힯]') THEN 'ko' WHEN regexp_full_match(t[pos:pos], '\\p{L}|\\p{M}') THEN 'other' END AS kind
  FROM (SELECT item_id, t, unnest(range(1, length(t) + 1)) AS pos FROM (SELECT item_id, replace(replace(text, 'th', '中文'), 'es', '한국') AS t FROM benchmark))),
carried AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER w, first_value(kind IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS k FROM c WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
marked AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY item_id ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM carried),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM marked)
SELECT item_id, CAST(run AS BIGINT) AS run, any_value(k) AS script, string_agg(ch, '' ORDER BY pos) AS part FROM runs GROUP BY item_id, run""")
def script_runs(spark, sf_dir):
    mixed = T.replaced(F.col("text"), [("th", "中文"), ("es", "한국")])  # stand-ins for mixed writing
    chars = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.filter(F.split(mixed, ""), lambda x: x != "")).alias("pos", "ch"))
    kind = F.when(F.col("ch").rlike(r"^[\x{4e00}-\x{9fff}]$"), "cjk").when(F.col("ch").rlike(r"^[\x{ac00}-\x{d7af}]$"), "ko").when(F.col("ch").rlike(r"^(\p{L}|\p{M})$"), "other")
    order = Window.partitionBy("item_id").orderBy("pos")
    after = order.rowsBetween(0, Window.unboundedFollowing)
    carried = chars.withColumn("kind", kind).withColumn("script", F.coalesce(F.last("kind", ignorenulls=True).over(order), F.first("kind", ignorenulls=True).over(after)))
    fresh = F.when(F.col("script").eqNullSafe(F.lag("script").over(order)), 0).otherwise(1)
    numbered = carried.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    parts = F.array_sort(F.collect_list(F.struct("pos", "ch")))
    return numbered.groupBy("item_id", "run").agg(F.first("script").alias("script"), F.array_join(F.transform(parts, lambda x: x["ch"]), "").alias("part"))
