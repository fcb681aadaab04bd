"""Lists that name files: broken rows, spans, places; calibration factors; tasks of the command line."""

import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral import cli
from timbral.functions import vec
from timbral.operators import datadir, scoring, signal
from timbral.sources import binary, lists, ranges, text_tables


def mean_model():
    """A model for tests: the mean and deviation of each bin."""
    return lambda x: np.concatenate([x.mean(0), x.std(0)])


def _wave(path, seconds=1.0, rate=16000, tone=200.0):
    x = np.sin(np.arange(int(seconds * rate)) * 2 * np.pi * tone / rate) * 8000
    path.write_bytes(binary.wav_bytes(x, rate))
    return x.astype("<i2").astype(float)


def test_list_lines_that_are_broken_fail_or_go(spark, tmp_path):
    (tmp_path / "list").write_text('{"key": "a", "spk": "s", "wav": "x"}\n\n{"key": "b", "spk"\nnothing\n{"spk": "s"}\n')
    assert [r.key for r in lists.read_list_lines(spark, str(tmp_path / "list"), on_bad="drop").collect()] == ["a"]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        lists.read_list_lines(spark, str(tmp_path / "list")).collect()
    with pytest.raises(ValueError):
        lists.read_list_lines(spark, "x", on_bad="keep")


def test_waves_are_cut_by_spans_and_broken_ones_go(spark, tmp_path):
    x = _wave(tmp_path / "a.wav")
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    a = str(tmp_path / "a.wav")
    rows = [("whole", a, None), ("cut", a, [["0.25", "0.5"], ["0.75", "2.0"]]), ("none", a, []), ("bad", str(tmp_path / "bad.wav"), None), ("gone", str(tmp_path / "no.wav"), None), ("null", None, None), ("words", a, [["x", "1"]])]
    df = spark.createDataFrame(rows, "key string, wav string, vad array<array<string>>").withColumn("samples", F.lit("clash"))
    got = {r.key: r for r in lists.with_waves(df).collect()}
    assert set(got) == {"whole", "cut", "none"} and got["whole"].sample_rate == 16000
    assert got["whole"].samples == x.tolist() and got["none"].samples == []
    assert got["cut"].samples == np.concatenate([x[4000:8000], x[12000:]]).tolist()
    with pytest.raises(Exception):
        lists.with_waves(df, on_error="error").collect()
    assert lists.with_waves(df.limit(0)).count() == 0


def test_written_waves_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, -2.0, 40000.0]), ("b", []), ("c", None)], "utt string, samples array<double>")
    rows = spark.createDataFrame(lists.write_waves(df, str(tmp_path / "w")).collect(), "utt string, wav string")
    got = {r.utt: r.samples for r in lists.with_waves(rows, vad=None).collect()}
    assert got == {"a": [1.0, -2.0, 32767.0], "b": []}


def test_features_by_places(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i}", [[float(i), 1.0], [2.0, 3.0]]) for i in range(9)], "utt string, feat array<array<double>>")
    index = ranges.write_archives(df, str(tmp_path / "f"), "feat").collect()
    rows = [(r.key, f"{r.path}:{r.offset}") for r in index]
    listed = spark.createDataFrame([*rows, rows[0], ("none", None)], "key string, feat string")
    got = lists.with_features(listed).collect()
    assert len(got) == 10 and all(r.feat == [[float(r.key[1:]), 1.0], [2.0, 3.0]] for r in got)


def test_pieces_by_their_ids(spark, tmp_path):
    ids = ["a-b-00001000-00003000-00000000-00000150", "a-b-00001000-00003000-00000075-00000200", "plain", "z-0-100-0-10"]
    df = spark.createDataFrame([(k, [float(i)]) for i, k in enumerate(ids)], "utt string, emb array<double>").coalesce(1)
    ranges.write_archives(df, str(tmp_path / "p")).collect()
    got = lists.read_pieces(spark, str(tmp_path / "p"), ".ark").orderBy("path", "offset").collect()
    assert [(r.rec, r.begin, r.end, r.emb) for r in got] == [("a-b", 1.0, 2.5, [0.0]), ("a-b", 1.75, 3.0, [1.0]), ("z", 0.0, 0.1, [3.0])]


def test_header_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('spk\tutt\tnote\n1\ta\t"open\n2\tb\t\n')
    got = lists.read_tsv(spark, str(tmp_path / "t.tsv"), "spk > 1").collect()
    assert [tuple(r) for r in got] == [("2", "b", None)]
    assert lists.read_tsv(spark, str(tmp_path / "t.tsv")).first().note == '"open'


def test_factors_of_both_sides(spark):
    scores = spark.createDataFrame([("a", "b", 2.0, 4.0, 0.5, 0.0)], "enroll string, test string, enroll_mag double, test_mag double, enroll_mean double, test_mean double")
    durations = spark.createDataFrame([("a", 9.0), ("b", 0.5)], "utt string, dur double")
    r = scoring.calibration_factors(scores, durations).first()
    assert (r.dur_min, r.dur_max, r.dur_diff, r.dur_ratio) == (0.5, 2.0, 1.5, 4.0)
    assert (r.mag_min, r.mag_max, r.mag_diff, r.mag_ratio) == (2.0, 4.0, 2.0, 2.0)
    assert (r.mean_min, r.mean_max, r.mean_diff, r.mean_ratio) == (0.0, 0.5, 0.5, None)
    assert "dur_min" not in scoring.calibration_factors(scores).columns


def test_ball_holds_every_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.1, 0.0],), ([0.0, 0.0],)], "v array<double>")
    a, b, c = (r[0] for r in df.select(vec.to_ball(F.col("v"))).collect())
    np.testing.assert_allclose(a, np.array([0.6, 0.8]) * (1 - 1e-5))
    assert b == [0.1, 0.0] and c == [0.0, 0.0]


def test_directories_are_cut_on_all_levels(spark):
    utts = spark.createDataFrame([("u1", "s1"), ("u2", "s1"), ("u3", "s2")], "utt string, spk string")
    segments = spark.createDataFrame([("u1", "r1"), ("u3", "r1"), ("u9", "r2")], "utt string, rec string")
    out = datadir.cut_to({"utts": utts, "segments": segments}, spark.createDataFrame([("s1",), ("s1",), (None,)], "spk string"))
    assert [tuple(r) for r in out["utts"].collect()] == [("u1", "s1")] and [tuple(r) for r in out["segments"].collect()] == [("u1", "r1")]
    with pytest.raises(ValueError):
        datadir.cut_to({"utts": utts}, segments.select("rec"))


def test_samples_at_one_rate(spark):
    df = spark.createDataFrame([(8000, [1.0, 2.0] * 400), (16000, [5.0, 6.0]), (8000, None)], "sample_rate int, samples array<double>")
    a, b, c = signal.at_rate(df, 16000).collect()
    assert len(a.samples) == 1600 and b.samples == [5.0, 6.0] and c.samples is None and {a.sample_rate, b.sample_rate, c.sample_rate} == {16000}


def test_tasks_from_files_to_files(spark, tmp_path, monkeypatch):
    for i, tone in enumerate((200.0, 210.0, 3000.0)):
        _wave(tmp_path / f"{i}.wav", 3.0, tone=tone)
    (tmp_path / "waves").write_text("".join(f"u{i} {tmp_path}/{i}.wav\n" for i in range(3)))
    (tmp_path / "trials").write_text("u0 u1\nu0 u2\nu0 gone\n")
    (tmp_path / "segments").write_text("u0-1 u0 0.0 2.9\nu2-1 u2 0.5 2.5\n")
    shared = ["--waves", str(tmp_path / "waves"), "--model", "test_lists:mean_model"]
    monkeypatch.syspath_prepend(str(pathlib.Path(__file__).parent))
    spark.sparkContext.addPyFile(__file__)
    cli.main(["embed", *shared, "--out", str(tmp_path / "emb")])
    index = [line.split() for f in (tmp_path / "emb" / "index").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted(k for k, _ in index) == ["u0", "u1", "u2"]
    back = ranges.read_archives(spark, str(tmp_path / "emb"), ending=".ark").collect()
    assert len(back) == 3 and len(back[0].emb) == 160
    cli.main(["similarity", *shared, "--trials", str(tmp_path / "trials"), "--out", str(tmp_path / "sim")])
    scores = {tuple(line.split()[:2]): float(line.split()[2]) for f in (tmp_path / "sim").glob("part-*") for line in f.read_text().splitlines()}
    assert scores["u0", "u1"] > scores["u0", "u2"] and scores["u0", "gone"] == 0
    cli.main(["diarize", *shared, "--segments", str(tmp_path / "segments"), "--out", str(tmp_path / "rttm")])
    lines = [line.split() for f in (tmp_path / "rttm").glob("part-*") for line in f.read_text().splitlines()]
    assert {f[1] for f in lines} == {"u0", "u2"} and all(f[0] == "SPEAKER" and float(f[4]) > 0 for f in lines)


def test_normalised_scores_have_eight_columns(spark, tmp_path):
    spark.createDataFrame([(u, v) for u, v in (("a", [3.0, 4.0]), ("b", [0.0, 2.0]))], "utt string, emb array<double>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(f"c{i}", [1.0, float(i)]) for i in range(4)], "utt string, emb array<double>").write.parquet(str(tmp_path / "c"))
    (tmp_path / "scores").write_text("a b 0.8 target\n")
    cli.main(["norm", "--scores", str(tmp_path / "scores"), "--embeddings", str(tmp_path / "v"), "--cohort", str(tmp_path / "c"), "--out", str(tmp_path / "n")])
    (line,) = [line for f in (tmp_path / "n").glob("part-*") for line in f.read_text().splitlines()]
    f = line.split()
    assert len(f) == 8 and f[:2] == ["a", "b"] and f[3] == "target" and f[4:6] == ["5.0000", "2.0000"]
    assert json.dumps([len(x.split(".")[1]) for x in f[4:]]) == "[4, 4, 4, 4]"
