"""Readers, writers and streams, by writing and reading back."""

import struct

import numpy as np
import pytest
from conftest import SMALL

from tessitura.operators import metrics
from tessitura.sources import files, formats, sinks
from tessitura.sources.manifests import last_of_pairs, read_manifests, read_metric_lines, read_pairs, read_rttm, read_transcript, read_uem
from tessitura.streaming import incremental


def wav(samples, rate=16000, channels=1):
    data = np.asarray(samples, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + b"data" + struct.pack("<I", len(data)) + data


def test_wavs(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([0, 16384, -16384, 0], channels=2))
    (tmp_path / "b.wav").write_bytes(b"RIFFnothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.decode_wavs(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.wav"].samples == [0.25, -0.25] and got["a.wav"].sample_rate == 16000 and got["b.wav"].error
    listed = files.listing(spark, str(tmp_path), "*.wav").select(files.stem(files.F.col("path")).alias("s"), files.path_part(files.F.col("path"), 2).alias("p"))
    assert sorted((r.s, r.p) for r in listed.collect()) == [("a", tmp_path.name), ("b", tmp_path.name)]


def test_manifest_files(spark, tmp_path):
    (tmp_path / "metadata_de_x.csv").write_text("audio_file|duration|text\na.wav|1.5|hallo\n")
    got = read_manifests(spark, str(tmp_path)).collect()
    assert [(r.path, r.lang, r.text) for r in got] == [("a.wav", "de", "hallo")]


def test_vocabulary_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("<pad>", 0), ("a", 1), (" ", 2), ("é", 3)], "token string, id long")
    sinks.write_vocabulary(rows, f"{tmp_path}/v")
    assert sorted(map(tuple, files.vocabulary(spark, f"{tmp_path}/v").collect())) == sorted(map(tuple, rows.collect()))


def test_text_round_trips(spark, tmp_path):
    turns = spark.createDataFrame([("f", 0.0, 1.5, "s1")], "file string, start double, stop double, label string")
    sinks.write_rttm(turns, f"{tmp_path}/r")
    assert [tuple(r) for r in read_rttm(spark.read.text(f"{tmp_path}/r")).collect()] == [("f", "0", 0.0, 1.5, "s1")]
    sinks.write_pairs(spark.createDataFrame([("u", "a b")], "key string, val string"), f"{tmp_path}/p")
    assert [tuple(r) for r in read_pairs(spark.read.text(f"{tmp_path}/p")).collect()] == [("u", "a b")]
    sinks.write_transcript(spark.createDataFrame([("s", 0.0, 1.0, "a\nb")], "speaker string, start double, stop double, text string"), f"{tmp_path}/t")
    assert [r.text for r in read_transcript(spark.read.text(f"{tmp_path}/t")).collect()] == ["ab"]
    sinks.write_scores(spark.createDataFrame([(1, 2, 0.5)], "enrol int, test int, score double"), f"{tmp_path}/s")
    assert spark.read.text(f"{tmp_path}/s").first()[0] == "1 2 0.50000"


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "en", 2.0), (2, "de", 4.0)], "id long, lang string, duration double")
    sinks.write_samples(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write_samples(rows, f"{tmp_path}/t")
    sinks.write_durations(rows, f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d").first()["seconds"] == 6.0
    sinks.write_embeddings(rows, f"{tmp_path}/e")
    sinks.append_missing(rows.union(spark.createDataFrame([(3, "fr", 1.0)], rows.schema)), f"{tmp_path}/e", "id")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/e").collect()) == [1, 2, 3]
    sinks.write_rows_and_metric(rows.withColumnRenamed("duration", "sim"), f"{tmp_path}/m", "sim")
    assert spark.read.json(f"{tmp_path}/m/metric").first()["sim"] == 3.0
    sinks.write_token_stats(spark.createDataFrame([("a", 1, 1, "en"), ("b", 5, 2, "de,en")], "token string, total_count long, num_langs long, languages string"), f"{tmp_path}/k")
    assert [r.Token for r in spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/k").collect()] == ["b", "a"]
    sinks.write_summary(rows, f"{tmp_path}/c.csv")
    assert files.by_extension(spark, f"{tmp_path}/c.csv").count() == 2
    assert files.keyed_csv(spark, f"{tmp_path}/c.csv", "id long, lang string, duration double", "id").count() == 2
    with pytest.raises(ValueError, match="no reader"):
        files.by_extension(spark, "x.ark")


def test_lists(spark):
    lines = spark.createDataFrame([("u1|p|w.wav|t",), ("u2|p|/w.wav|t|g.wav",), ("bad",)], ["value"])
    assert [(r.prompt_wav, r.wav) for r in files.prompt_list(lines, "/d").collect()] == [("/d/w.wav", "/d/wavs/u1.wav"), ("/w.wav", "/d/g.wav")]
    crossed = spark.createDataFrame([("1-2-3\t1.5\ta\t4-5-6\t2\tb",), ("x",)], ["value"])
    assert [r.wav for r in files.cross_list(crossed, "/d").collect()] == ["/d/4/5/4-5-6.flac"]
    doc = spark.createDataFrame([('{"a_0_1": {"file": "a", "start": 0.0, "stop": 1.5, "sample_rate": 16000}}',)], ["value"])
    assert [tuple(r) for r in files.intervals_json(doc).collect()] == [("a_0_1", "a", 0.0, 1.5, 16000)]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.csv").write_text("a|1.0|One two.\nbad\n")
    for round_ in (1, 2):  # the second round has one new file only
        incremental.prepare(incremental.manifests(spark, str(source)), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == round_
        (source / "2.csv").write_text("b|2.0|3.5|Three.\n")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert incremental.activity(events).selectExpr("sum(n)").first()[0] == events.count()


def test_further_readers(spark, tmp_path):
    import json

    (tmp_path / "side").mkdir()
    (tmp_path / "side" / "a.json").write_text(json.dumps({"gen_len": 7, "text_ipa": "x"}))
    (tmp_path / "side" / "b.json").write_text("{broken")
    assert sorted((r.key, r.gen_len, r.reject) for r in formats.read_sidecars(spark, f"{tmp_path}/side").collect()) == [("a", 7, None), ("b", None, "no side-car")]
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    pairs = formats.read_pair_list(lines("w1|t", "w2|r|t", "w3|x|t|r"))
    assert sorted(tuple(r) for r in pairs.collect()) == [("w1", None, "t"), ("w2", "r", "t"), ("w3", "r", "t")]
    there = spark.createDataFrame([("w2",)], "wav string")
    assert formats.read_pair_list(lines("w1|t", "w2|r|t"), there).count() == 1
    with pytest.raises(Exception, match="2, 3 or 4 fields"):
        formats.read_pair_list(lines("w|a|b|c|d")).collect()
    grid = """File type = "ooTextFile"\nObject class = "TextGrid"\nitem []:\n item [1]:\n class = "IntervalTier"\n name = "S1"\n xmin = 0\n xmax = 5\n intervals: size = 2\n intervals [1]:\n xmin = 2\n xmax = 3.5\n text = "say ""hi"" "\n intervals [2]:\n xmin = 3.5\n xmax = 5\n text = " "\n item [2]:\n class = "IntervalTier"\n name = "S2"\n xmin = 0\n xmax = 5\n intervals [1]:\n xmin = 0.5\n xmax = 1\n text = "yes"\n"""
    got = formats.read_textgrid(spark.createDataFrame([("u", grid)], "utt string, value string")).collect()
    assert [tuple(r) for r in got] == [("u", "S2", 0.5, 1.0, "yes"), ("u", "S1", 2.0, 3.5, 'say "hi"')]
    assert [tuple(r) for r in formats.read_speakers(lines("s1 a b", "", "s2 c")).collect()] == [("s1", "a"), ("s1", "b"), ("s2", "c")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "val_20.jsonl").write_text('{"lang": "en"}\n{"summary": {"mean_absolute_error": 0.5, "mean_relative_error": 0.1}}\n')
    (tmp_path / "log" / "val_9.jsonl").write_text('{"summary": {"other": 1}}\n')
    assert [tuple(r) for r in formats.read_history(spark, f"{tmp_path}/log").collect()] == [(20, 0.5, 0.1)]
    (tmp_path / "cmvn").write_text("<Nnet>\n<AddShift> 2 2\n<LearnRateCoef> 0 [ 1.5 -2 ]\n<Rescale> 2 2\n<LearnRateCoef> 0 [ 3 4 ]\n</Nnet>\n")
    assert tuple(formats.read_statistics(spark, f"{tmp_path}/cmvn").first()) == ([1.5, -2.0], [3.0, 4.0])
    jobs = formats.conversion_jobs(spark, f"{tmp_path}/side", "a.*", "convert {source} {target}").first()
    assert jobs.target.endswith("/side/a.wav") and jobs.command == f"convert {jobs.source} {jobs.target}"
    regions = read_uem(lines("f 1 0 2", "f 1 2 3", "g 1 1 2"))
    assert formats.disjoint_regions(regions).count() == 3
    with pytest.raises(Exception, match="overlap in f"):
        formats.disjoint_regions(read_uem(lines("f 1 0 2", "f 1 1 3"))).collect()
    metrics = spark.createDataFrame([(0, '{"sim": 1}'), (1, "SIM: 9"), (2, "SIM: 4"), (3, "")], "line int, value string")
    assert read_metric_lines(metrics, "sim").first()[0] == 4.0 and read_metric_lines(metrics.where("line = 0"), "sim").first()[0] == 1.0
    assert {tuple(r) for r in last_of_pairs(read_pairs(lines("a 1", "b 2", "a 3")).coalesce(1)).collect()} == {("a", "3"), ("b", "2")}


def test_further_writers(spark, tmp_path):
    import json

    rows = spark.createDataFrame([(0.5, "b"), (0.25, "a"), (0.5, "c")], "speed double, name string")
    sinks.write_counts(rows, f"{tmp_path}/n", "speed")
    assert spark.read.text(f"{tmp_path}/n").first()[0] == '{"0.25":1,"0.5":2}'
    sinks.write_json_array(rows, f"{tmp_path}/j", "name")
    assert json.loads(spark.read.text(f"{tmp_path}/j").first()[0]) == [{"speed": 0.25, "name": "a"}, {"speed": 0.5, "name": "b"}, {"speed": 0.5, "name": "c"}]
    report = metrics.class_report(spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "t int, g int"), "t", "g")
    sinks.write_class_report(report, f"{tmp_path}/c")
    assert [tuple(r) for r in spark.read.option("header", "true").csv(f"{tmp_path}/c").collect()] == [("0", "1", "2", "1", "1.000", "0.500", "0.667"), ("1", "2", "1", "1", "0.500", "1.000", "0.667"), ("Total", "3", "3", "2", None, None, None)]
    assert sinks.write_segments(rows, f"{tmp_path}/s", {"dur": 3}) and not sinks.write_segments(rows, f"{tmp_path}/s", {"dur": 3})
    with pytest.raises(ValueError, match="other options"):
        sinks.write_segments(rows, f"{tmp_path}/s", {"dur": 4})
    waves = spark.createDataFrame([("a", [0.0, 0.5, -1.0, 2.0])], "path string, samples array<double>")
    sinks.write_wavs(waves, f"{tmp_path}/w", 16000)
    back = files.decode_wavs(spark.read.parquet(f"{tmp_path}/w")).first()
    assert back.sample_rate == 16000 and np.allclose(back.samples, [0, 0.5, -1, 1], atol=1e-4)
    sinks.write_generated(waves, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g").first().samples[1] == 0.5
    for k in "xy":
        sinks.write_rttm(spark.createDataFrame([(k, 0.0, 1.0, "s")], "file string, start double, stop double, label string"), f"{tmp_path}/{k}.rttm")
    sinks.concatenate_rttm(spark, [f"{tmp_path}/x.rttm", f"{tmp_path}/y.rttm"], f"{tmp_path}/all.rttm")
    assert sorted(r.file for r in read_rttm(spark.read.text(f"{tmp_path}/all.rttm")).collect()) == ["x", "y"]
