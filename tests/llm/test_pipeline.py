from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tessitura.llm.common import DOCUMENT_COLUMNS, table


def test_stages(spark, tmp_path):
    docs, counts = table(spark, SMALL, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(docs.columns) == DOCUMENT_COLUMNS
    assert counts[0] >= 195 and counts[0] >= counts[1] >= counts[2] >= counts[3] > 100
    kept = spark.read.parquet(f"{tmp_path}/3")
    tokens = {r.doc_id: r.doc_tokens for r in docs.select("doc_id", "doc_tokens").distinct().collect()}
    assert set(tokens) == {r.doc_id for r in kept.collect()}
    assert docs.selectExpr("sum(length)").first()[0] == sum(tokens.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_run_leaves_only_its_result(spark):
    from tessitura.llm.common import made

    before = made(spark)
    got = corpus_pipeline.run(spark, SMALL)
    left = [x for x in made(spark) if x not in before]
    assert len(left) == 1 and "pipeline-4" in left[0] and got.count() > 0


#: Documents whose fate each stage's rule settles: (doc_id, text, what becomes of it).
WORDS = {"en": "the of and to in that was with for are this have from they which".split(), "fr": "les des une dans que pour avec sont cette mais nous vous leur tout fait".split()}
#: Columns that the operators use themselves.
CLASH = ("row", "id", "text_key", "score", "lang_pred", "kept", "n_removed", "n_words", "spans", "runs", "_key", "_id", "_text", "item_id", "n", "node", "root")


def planted():
    rng = np.random.default_rng(21)
    make = lambda lang, n: " ".join(f"{rng.choice(WORDS[lang])}{rng.integers(3)}" if rng.random() < 0.5 else str(rng.choice(WORDS[lang])) + "".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))
    rows, item = [], make("en", 30)
    for k in range(120):
        lang = "en" if k % 2 else "fr"
        rows.append((k, make(lang, 80), lang, "kept"))
    passage = make("en", 60)
    rows += [(200, None, "en", "gone"), (201, "", "fr", "gone"), (202, "1 2 3 --", "en", "gone")]
    rows += [(203, rows[1][1], "en", "gone"), (204, " ".join(rows[3][1].split()[:-1] + ["edited"]), "en", "gone"), (None, rows[5][1].upper(), "en", "gone")]
    rows += [(205, f"{make('en', 40)} {passage}", "en", "cut"), (206, f"{passage} {make('en', 40)}", "en", "cut"), (207, passage, "en", "gone")]
    rows += [(208, f"{make('en', 30)} {item} {make('en', 30)}", "en", "gone"), (None, f"{make('en', 30)} {item.upper()}", "en", "gone"), (None, make("en", 50), "en", "kept")]
    rows += [(209, make("en", 40_000), "en", "kept")]
    return rows, item, passage


def test_planted_cases_through_all_stages(spark, tmp_path):
    rows, item, passage = planted()
    shaped = [(k, t, lang, "s", len(t or ""), fate) for k, t, lang, fate in rows]
    docs = spark.createDataFrame(shaped, "doc_id long, text string, lang string, source string, n_chars long, fate string")
    for name in CLASH:
        docs = docs.withColumn(name, F.lit(1.5))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, found, str(tmp_path))
        assert tuple(found.columns) == DOCUMENT_COLUMNS and found.schema["n_chars"].dataType.simpleString() == "bigint"
        found = spark.createDataFrame(found.collect(), found.schema)
    got = Counter((r.doc_id, r.text) for r in found.collect())
    want = Counter((k, t if fate == "kept" else t.replace(passage, "").strip()) for k, t, _, fate in rows if fate != "gone")
    assert got == want
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == Counter(k for k, _ in want)


def test_stages_of_nothing(spark, tmp_path):
    docs = table(spark, SMALL, "documents").where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SMALL, "benchmark").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("number", [1, 2, 3])
def test_stages_on_odd_rows(spark, number):
    """Nulls in every column, repeated rows, texts of blanks or of one word."""
    rows = [(None, None, None, None, None)] * 2 + [(1, "", "en", "a", 0), (2, " \n ", None, "a", 3), (3, "one", "en", None, 3), (3, "one", "en", None, 3), (4, "one", None, None, None), (5, "w " * 50_000, "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(corpus_pipeline.STAGES[number][1](spark, docs, SMALL).collect(), key=str)
    if number == 1:
        assert Counter(r.doc_id for r in got) == {1: 1, 3: 1, 5: 1}
    elif number == 2:
        assert Counter(r.doc_id for r in got) == {None: 2, 1: 1, 2: 1, 3: 2, 4: 1}
    else:
        assert got == sorted(docs.collect(), key=str)
