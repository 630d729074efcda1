"""Edge cases by hand: what the data doesn't hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import numeric as N
from tessitura.functions import text as T
from tessitura.operators import clustering, intervals, joins, metrics, ordered
from tessitura.sources import manifests


def value(spark, column, **named):
    row = spark.createDataFrame([tuple(named.values())], list(named)) if named else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_clean_text_six_dots_and_odd_blanks(spark):
    assert value(spark, T.clean_text(F.col("t")), t="a......b c​d，e") == "a … … b c d , e"


def split_like_words(text):
    """Tokens by words, as an independent restatement."""
    import re

    out, words = [], re.sub("[&ㄜでかすπ%@]", "", text).split(" ")
    for i, word in enumerate(words):
        if word:
            out += re.findall("[a-zA-ZÀ-ʯ]+|[^|\n]", word) + ([" "] if i < len(words) - 1 else [])
    return out


@pytest.mark.parametrize("text", ["", " ", "a", " a  b ", "ab1c|d e||f ", "x |  y", "ˈhɛ|loʊ 12", "  "])
def test_tokens_v6(spark, text):
    assert value(spark, T.tokens_v6(F.col("t")), t=text) == split_like_words(text)


def test_tokens_v3_tones(spark):
    assert value(spark, T.tokens_v3(F.col("t")), t="ni21|xau213 4|a1b  c") == ["ni", "21", "xau", "213", " ", "4", "a1b", " ", "c"]


@pytest.mark.parametrize(("repeats", "found"), [(10, False), (11, True)])
def test_repetition_tolerance(spark, repeats, found):
    assert value(spark, T.repeats_itself(F.col("t")), t=" xy".join("abcdefghijklmnop"[: repeats + 1])) is (found)


@pytest.mark.parametrize(("rate", "bucket", "klass"), [(0.125, 0.0, 0), (0.375, 0.5, 0), (0.0, 0.0, 0), (8.0, 8.0, 31), (99.0, 99.0, 31)])
def test_rates(spark, rate, bucket, klass):
    assert float(value(spark, N.rate_bucket(F.col("r")), r=rate)) == bucket
    assert value(spark, N.rate_class(F.col("r")), r=rate) == klass


@pytest.mark.parametrize(("stop", "want"), [(1.0, [(0, 1.0)]), (1.5, [(0, 1.5)]), (1.6, [(0, 1.5), (0.1, 1.6)]), (5.0, [(0, 1.5), (0.75, 2.25), (1.5, 3.0), (2.25, 3.75), (3.0, 4.5), (3.5, 5.0)])])
def test_sub_segments(spark, stop, want):
    got = value(spark, N.sub_starts(F.lit(0.0), F.col("s"), 1.5, 0.75), s=stop)
    assert [(r["start"], r["stop"]) for r in got] == want


def test_truncation_by_bytes(spark):
    assert value(spark, T.words_within(F.col("t"), F.lit(7)), t="é中 ab cd") == "é中"
    assert value(spark, T.words_within(F.col("t"), F.lit(2)), t="abc") == ""


def test_manifest_arities(spark):
    lines = spark.createDataFrame([("a|1",), ("a|1.5|x",), ("a|1.5|3.2|y",), ("a|1|2|3|z",), ("",), ("a|no|x",)], ["value"])
    got = [(r.reject, r.text, r.mos) for r in manifests.parse_lines(lines).collect()]
    assert got[0][0] == "2 fields" and got[3][0] == "5 fields" and got[4][0] == "1 fields" and got[5][0] == "duration is no number"
    assert got[1] == (None, "x", None) and got[2] == (None, "y", 3.2)


def test_key_maps_and_transcripts(spark):
    lines = spark.createDataFrame([("u1 a b",), ("",), ("u2\tc d",)], ["value"])
    assert {(r.key, r.val) for r in manifests.read_pairs(lines, tab=True).collect()} == {("u1", "a b"), ("u2", "c d")}
    timed = spark.createDataFrame([("s 1 2",), ("s 1 2 a b",)], ["value"])
    assert [r.text for r in manifests.read_transcript(timed).collect()] == ["", "ab"]
    with pytest.raises(Exception, match="fewer than three"):
        manifests.read_transcript(spark.createDataFrame([("s 1",)], ["value"])).collect()


def test_rttm_and_regions(spark):
    lines = spark.createDataFrame([(";; c",), ("SPEAKER f 1 0.5 <na> <NA> <NA> s <NA>",), ("LEXEME f 1 0 1 x x x x",), ("short",)], ["value"])
    assert [tuple(r) for r in manifests.read_rttm(lines).collect()] == [("f", "1", 0.5, 0.5, "s")]
    with pytest.raises(Exception, match="no length"):
        manifests.read_uem(spark.createDataFrame([("f 1 2 2",)], ["value"])).collect()


def test_metric_lines(spark):
    with_last = spark.createDataFrame([('{"sim": 0.5}',), ("SIM: 0.75",)], ["value"])
    without = spark.createDataFrame([('{"sim": 0.5}',), ('{"sim": 1.0}',)], ["value"])
    assert manifests.read_metric_lines(with_last, "sim").first()["sim"] == 0.75
    assert manifests.read_metric_lines(without, "sim").first()["sim"] == 0.75


@pytest.mark.parametrize("budget", [0, 10, 1e9])
def test_budget_keeps_the_row_that_passes_it(spark, budget):
    rows = spark.createDataFrame([("g", k, 5) for k in range(8)], "g string, k long, v long")
    n = ordered.budgeted(rows, "g", "k", "v", budget).count()
    assert n == {0: 1, 10: 3, 1e9: 8}[budget]


def test_frame_batches(spark):
    rows = spark.createDataFrame([("g", k, v) for k, v in enumerate([3, 10, 4, 99, 6])], "g string, k long, v long")
    got = ordered.frame_batches(rows, "g", "k", "v", 10)
    assert sorted((r.k, r.batch) for r in got.collect()) == [(0, 0), (1, 2), (2, 0), (4, 1)]
    assert ordered.frame_batches(rows, "g", "k", "v", 10, most=1).select("batch").distinct().count() == 4
    assert ordered.frame_batches(rows.where("false"), "g", "k", "v", 10).count() == 0


def test_substitution_wraps_around(spark):
    rows = spark.createDataFrame([(k,) for k in range(6)], "k long")
    got = {r.k: r.used for r in ordered.substituted(rows, "k", F.col("k").isin(1, 4)).collect()}
    assert got == {0: 1, 1: 1, 2: 4, 3: 4, 4: 4, 5: 1}


def test_turns(spark):
    rows = spark.createDataFrame([("r", 0.0, 2.0, "a"), ("r", 1.0, 3.0, "a"), ("r", 2.0, 5.0, "b"), ("r", 5.0, 6.0, "b"), ("r", 7.0, 8.0, "b")], "rec string, start double, stop double, label string")
    got = [(r.start, r.stop, r.label) for r in intervals.turns_to_rttm(rows, "rec").orderBy("turn").collect()]
    assert got == [(0.0, 2.5, "a"), (2.5, 6.0, "b"), (7.0, 8.0, "b")]


def test_merge_contained_and_touching(spark):
    rows = spark.createDataFrame([("r", 0.0, 9.0), ("r", 1.0, 2.0), ("r", 9.0, 10.0), ("r", 11.0, 12.0)], "rec string, start double, stop double")
    assert sorted((r.start, r.stop) for r in intervals.merged(rows, "rec").collect()) == [(0.0, 10.0), (11.0, 12.0)]


def test_assignment_is_the_best():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(30):
        w = rng.integers(0, 9, rng.integers(1, 6, 2)).astype(float)
        n, m = w.shape
        size = max(n, m)
        square = np.zeros((size, size))
        square[:n, :m] = w
        best = max(sum(square[i, p[i]] for i in range(size)) for p in permutations(range(size)))
        assert sum(w[i, j] for i, j in intervals.assignment(w)) == best


def test_word_errors(spark):
    assert metrics.word_counts("a b c", "a c d") == (2, 0, 0)
    assert metrics.word_counts("", "x y") == (2, 2, 0)
    assert value(spark, metrics.error_rate(F.lit(2), F.lit(0))) == math.inf
    assert value(spark, metrics.error_rate(F.lit(0), F.lit(0))) == 0.0


def test_unique_keys_are_required(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert joins.require_unique(rows, "k").count() == 2
    with pytest.raises(Exception, match="occurs twice"):
        joins.require_unique(rows.union(rows), "k").collect()


def test_range_join_takes_both_ends(spark):
    a = spark.createDataFrame([("g", 10)], "g string, n long")
    b = spark.createDataFrame([("g", m) for m in (0, 1, 2, 4, 5)], "g string, m long")
    got = joins.range_join(a, b, ["g"], 0.1 * F.col("n"), 0.4 * F.col("n"), F.col("m"), 2)
    assert sorted(r.m for r in got.collect()) == [1, 2, 4]


def test_small_clusters():
    x = np.eye(3)[[0, 0, 0, 0, 1, 2]]
    assert clustering.absorb_small(np.array([5, 5, 5, 5, 6, 7]), x).tolist() == [5] * 6
    assert clustering.absorb_small(np.array([1, 2, 3, 4, 5, 6]), x).tolist() == [0] * 6


def test_clusters_find_groups(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(8)[:3]
    rows = [("r", k, (centres[k % 3] + rng.normal(0, 0.02, 8)).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows + [("few", k, [1.0] * 8) for k in range(5)], "rec string, k long, v array<double>")
    for method in ("spectral", "average_link"):
        got = clustering.cluster(df, "rec", "k", "v", method=method).collect()
        assert {r.label for r in got if r.rec == "few"} == {1}
        labels = {k % 3: {r.label for r in got if r.rec == "r" and r.k % 3 == k % 3} for k in range(3)}
        assert all(len(v) == 1 for v in labels.values()) and len(set.union(*labels.values())) == 3
    with pytest.raises(ValueError, match="isn't available"):
        clustering.cluster(df, "rec", "k", "v", method="umap_hdbscan")


def test_suppression():
    boxes = np.array([[0, 0, 2, 2], [0, 0, 2, 1.9], [5, 5, 6, 6]], float)
    assert clustering.suppress(boxes, np.array([0.9, 0.8, 0.7]), 0.5) == [0, 2]
    assert clustering.suppress(boxes[:0], np.zeros(0), 0.5) == []


def test_word_errors_equal_brute_force():
    """Every alignment is tried; of the cheapest the one with most substitutions counts."""
    from functools import lru_cache

    def slow(a, b):
        @lru_cache(None)
        def best(i, j):
            if i == len(a):
                return (len(b) - j, len(b) - j, 0)
            if j == len(b):
                return (len(a) - i, 0, len(a) - i)
            e, n, d = best(i + 1, j + 1)
            ways = [(e + (a[i] != b[j]), n, d)]
            e, n, d = best(i, j + 1)
            ways.append((e + 1, n + 1, d))
            e, n, d = best(i + 1, j)
            return min([*ways, (e + 1, n, d + 1)])

        return best(0, 0)

    rng = np.random.default_rng(23)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2))
        assert metrics.word_counts(" ".join(a), " ".join(b)) == slow(tuple(a), tuple(b))


def test_turns_never_shrink(spark):
    rows = [("a", 0.0, 10.0, "x"), ("a", 2.0, 3.0, "x"), ("a", 4.0, 6.0, "y"), ("a", 4.5, 4.8, "z"), ("b", 0.0, 4.0, "x"), ("b", 3.0, 5.0, "y"), ("b", 6.0, 7.0, "y"), ("c", 0.0, 10.0, "x"), ("c", 1.0, 9.0, "y"), ("c", 2.0, 3.0, "x")]
    got = intervals.turns_to_rttm(spark.createDataFrame(rows, "rec string, start double, stop double, label string"), "rec").orderBy("rec", "turn").collect()
    assert [tuple(r) for r in got] == [("a", 0, 0.0, 5.0, "x"), ("a", 1, 5.0, 6.0, "y"), ("b", 0, 0.0, 3.5, "x"), ("b", 1, 3.5, 5.0, "y"), ("b", 2, 6.0, 7.0, "y"), ("c", 0, 0.0, 5.0, "x"), ("c", 1, 5.0, 9.0, "y")]


def test_diarization_report(spark):
    """One second missed, one false alarm, two of a wrong speaker, out of ten."""
    schema = "rec string, label string, start double, stop double"
    ref = spark.createDataFrame([("r", "A", 0.0, 6.0), ("r", "B", 6.0, 10.0)], schema)
    hyp = spark.createDataFrame([("r", "1", 1.0, 8.0), ("r", "2", 8.0, 11.0)], schema)
    got = {r.condition: (r.scored, r.missed, r.false_alarm, r.confused, round(r.der, 6)) for r in intervals.diarization_report(ref, hyp, "rec").collect()}
    assert got == {"r": (10.0, 1.0, 1.0, 2.0, 40.0), "ALL": (10.0, 1.0, 1.0, 2.0, 40.0)}
    assert {r.der for r in intervals.diarization_report(ref, ref, "rec", collar=0.25, skip_overlap=True).collect()} == {0.0}
    assert {r.der for r in intervals.diarization_report(ref.where("false"), hyp, "rec").collect() if r.condition == "r"} == {100.0}


def test_required_shares_and_files(spark):
    from tessitura.operators import joins

    rows = spark.createDataFrame([(k, k < 1) for k in range(10)], "id long, bad boolean")
    assert joins.require_share(rows, rows.bad).count() == 9
    with pytest.raises(Exception, match="more than 10%"):
        joins.require_share(rows, rows.id < 2).collect()
    assert joins.require_present(rows, rows.select("id"), "id").count() == 10
    with pytest.raises(Exception, match="missing: 3"):
        joins.require_present(rows, rows.where("id <> 3").select("id"), "id").collect()
    with pytest.raises(Exception, match="lists of 1 and 2"):
        joins.positional(spark.createDataFrame([(["a"], ["b", "c"])], "x array<string>, y array<string>"), "x", "y").collect()


def test_samples_and_tracks(spark):
    from tessitura.operators import signal

    got = signal.cross_faded([np.ones(4), np.full(4, 3.0), np.ones(1)], 3)
    assert np.allclose(got, [1, 1, 2, 3, 3]) and len(signal.cross_faded([], 3)) == 0
    noisy = signal.mixed(np.ones(8), np.array([1.0, -1.0]), 20)
    assert np.isclose(np.mean((noisy - 1) ** 2), 0.01)
    assert np.allclose(signal.reverberated(np.array([1.0, 0, 0]), np.array([3.0, 4.0])), [0.6, 0.8, 0])
    boxes = [(1, 1, 0.0), (1, 2, 50.0), (2, 3, 51.0), (2, 4, 1.0), (5, 5, 2.0), (9, 6, 2.0)]
    faces = spark.createDataFrame([("s", f, i, x, 0.0, x + 10, 10.0) for f, i, x in boxes], "shot string, frame long, id long, left double, top double, right double, bottom double")
    assert {r.id: r.track for r in signal.tracks(faces, "shot", 3).collect()} == {1: 0, 4: 0, 5: 0, 2: 1, 3: 1, 6: 2}
    waves = spark.createDataFrame([("r", 1, [3.0, 3.0]), ("r", 0, [1.0, 1.0])], "rec string, k int, samples array<double>")
    assert signal.concatenated(waves, "rec", "k", "samples", 0).first().samples == [1.0, 1.0, 3.0, 3.0]


def test_nearest_in_blocks(spark):
    from tessitura.operators import vectors

    rng = np.random.default_rng(24)
    points, centres = rng.normal(size=(30, 4)), rng.normal(size=(25, 4))
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)] * 2, "id long, v array<double>")
    middle = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "label long, centre array<double>")
    want = (points / np.linalg.norm(points, axis=1, keepdims=True) @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T).argmax(axis=1)
    for block in (1000, 4):
        got = vectors.nearest(rows, "v", middle, block).collect()
        assert {r.id: r.nearest for r in got} == dict(enumerate(want.tolist())) and len(got) == 60
    assert vectors.nearest(rows, "v", middle.where("false")).where("nearest IS NULL").count() == 60


def documents_in(folder, rows):
    """A table of documents by their texts and numbers of characters, as its view in DuckDB."""
    import duckdb
    import pandas as pd

    path = f"{folder}/documents.parquet"
    pd.DataFrame([(k, text, n) for k, (text, n) in enumerate(rows)], columns=["doc_id", "text", "n_chars"]).astype({"n_chars": "Int64"}).to_parquet(path)
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{path}'").fetchall()
    return connection


def test_rates_equal_sql_on_odd_rows(spark, tmp_path):
    from oracle import same

    from tessitura import plans

    queries, oracles = plans.load()
    # halves of a step, which a duration of few decimals misses; no characters; a vertical tab, which divides no words
    ties = [("a " * w, 120 * w // k) for w in range(1, 60) for k in range(1, 65, 2) if 120 * w % k == 0]
    odd = [("", 0), ("a", 0), ("a\x0bb\x0bc", 45), ("a\x0cb", 30), (None, 10), ("a b", None), ("a", -15), ("a", 7), ("a\u00a0b\u2028c", 22)]
    connection = documents_in(tmp_path, ties + odd)
    same(queries["rate_histogram"](spark, str(tmp_path)), oracles["rate_histogram"], connection)


def test_speech_equals_sql_on_odd_texts(spark, tmp_path):
    from oracle import same

    from tessitura import plans

    queries, oracles = plans.load()
    letters = [chr(k) for k in (*range(1, 0x3100), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x10400, 0x10E00), *range(0x1E900, 0x1E960))]
    odd = ["", " ", None, "ßa", "ΑΣ ΣΑΣ.", "İI", "\u00a0 a \u3000", "a \u2028", "a\x0b!", "¿ \x0b a", "Ɤa Σ", "e\u0301!", "e\u0301e\u0301", "\x85a\x85 ", "😀B"]
    texts = odd + letters + [f"a{x} {x}B ." for x in letters]
    connection = documents_in(tmp_path, [(x, 1) for x in texts])
    same(queries["tts_normalise"](spark, str(tmp_path)), oracles["tts_normalise"], connection)
