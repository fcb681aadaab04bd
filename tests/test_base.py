"""The base library against plain Python and numpy on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from timbral.functions import vec
from timbral.operators import backend, clustering, datadir, intervals, metrics, scoring, signal
from timbral.plans import catalogue
from timbral.sources import binary, text_tables
from timbral.streaming import windows


def test_entry_and_catalogue_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("least, durations, ranges", [
    (0.1, [5.0, 6.0, 7.0], [(0, 1), (1, 2), (2, 3)]), (0.5, [0.1, 6.0, 7.0], [(0, 2), (2, 3)]), (0.5, [6.0, 7.0, 0.1], [(0, 1), (1, 3)]),
    (0.5, [6.0, 0.1, 7.0], [(0, 2), (2, 3)]), (0.5, [7.0, 0.1, 6.0], [(0, 2), (2, 3)]), (1.0, [1.0, 0.5, 0.1, 6.0], [(0, 3), (3, 4)]),
])
def test_combine_short_examples(least, durations, ranges):
    assert clustering.combine_short(least, durations) == ranges


def test_combine_short_invariants():
    rng = random.Random(3)
    for _ in range(200):
        d = [rng.uniform(0.01, 2) for _ in range(rng.randrange(1, 12))]
        got = clustering.combine_short(1.0, d)
        assert [a for a, _ in got] == [0, *(b for _, b in got[:-1])] and got[-1][1] == len(d)
        assert len(got) == 1 or all(sum(d[a:b]) >= 1.0 - 1e-4 for a, b in got)


def test_eer_matches_a_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(float(np.round(s, 1)), int(t), i) for i, (s, t) in enumerate(zip(rng.normal(size=400), rng.integers(0, 2, 400)))]
    df = spark.createDataFrame(rows, "score double, target int, k int")
    curve = metrics.det_curve(df, ties=("k",))
    got = metrics.equal_error_rate(curve).first()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    t = np.array([r[1] for r in rows], float)
    fnr, fpr = np.cumsum(t) / t.sum(), 1 - np.cumsum(1 - t) / (1 - t).sum()
    x, y = np.flatnonzero(fnr - fpr >= 0)[0], np.flatnonzero(fnr - fpr < 0)[-1]
    a = (fnr[x] - fpr[x]) / ((fnr[x] - fpr[x]) - (fnr[y] - fpr[y]))
    assert got.eer == pytest.approx(fnr[x] + a * (fnr[y] - fnr[x])) and got.threshold == rows[x][0]
    assert metrics.min_cost(curve).first()[0] == pytest.approx(np.min(fnr * 0.01 + fpr * 0.99) / 0.01)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(vec.dot(F.col("a"), F.col("b")), vec.norm(F.col("a")), vec.cosine(F.col("a"), F.col("b"), "unit"), vec.length_norm(F.col("a"), "dimension")).first()
    assert got[0] == 4 and got[1] == 3 and got[2] == pytest.approx((4 / (3 * 5**0.5) + 1) / 2)
    assert np.linalg.norm(got[3]) == pytest.approx(3**0.5)


def test_backend_invariants(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i * 50 + j), f"s{i}", (rng.normal(size=6) * 3 + c).tolist()) for i, c in enumerate(rng.normal(size=(8, 6)) * 4) for j in range(3 + i)]
    df = spark.createDataFrame(rows, "utt long, spk string, emb array<double>")
    x, spk = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    stats = backend.class_stats(df)
    within = sum((x[spk == s] - x[spk == s].mean(0)).T @ (x[spk == s] - x[spk == s].mean(0)) for s in set(spk))
    assert np.allclose(stats.mean, x.mean(0)) and np.allclose(stats.within, within)
    lda = backend.fit_lda(stats, 3)
    assert np.allclose(lda.T @ (within / len(x)) @ lda, np.eye(3), atol=1e-6)
    plda = backend.fit_plda(stats, 5)
    assert (np.diff(plda.psi) <= 1e-9).all() and (plda.psi >= 0).all()
    back = backend.Plda.from_row(plda.to_row(spark))
    assert np.allclose(back.transform, plda.transform)
    adapted = backend.adapt_plda(plda, df.select("utt", vec.times(F.col("emb"), 2.0).alias("emb")))
    assert adapted.psi.shape == plda.psi.shape
    chain = backend.fit_chain("mean-subtract | whitening | length-norm", df)
    y = np.array([r[0] for r in df.select(backend.apply_chain(chain, F.col("emb"))).collect()])
    assert np.allclose(np.linalg.norm(y, axis=1), 1)


def test_calibration_separates(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal(2 if t else -2)), float(rng.normal()), t) for t in rng.integers(0, 2, 300).tolist()]
    df = spark.createDataFrame(rows, "score double, q double, target int")
    weights, bias = scoring.train_calibration(df, ["score", "q"])
    after = scoring.linear_calibration(df, weights, bias)
    assert metrics.cllr(after, "calibrated").first()[0] < metrics.cllr(df).first()[0]


def test_spectral_finds_clusters(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(8)[:3]
    rows = [(0, i * 20 + j, (c + rng.normal(size=8) * 0.05).tolist()) for i, c in enumerate(centres) for j in range(20)]
    df = spark.createDataFrame(rows, "utt long, ord long, emb array<double>")
    for method in ("spectral", "merge"):
        labels = [r.label for r in clustering.cluster(df, method=method).orderBy("ord").collect()]
        assert len(set(labels)) == 3 and all(len(set(labels[k : k + 20])) == 1 for k in (0, 20, 40))


def test_intervals(spark):
    ref = spark.createDataFrame([("r", 0.0, 4.0, "A"), ("r", 4.0, 8.0, "B")], "utt string, begin double, end double, label string")
    hyp = spark.createDataFrame([("r", 0.0, 5.0, "x"), ("r", 5.0, 8.0, "y")], "utt string, begin double, end double, label string")
    got = intervals.diarization_error(ref, hyp, collar=0.0).first()
    assert (got.scored, got.miss, got.false_alarm) == (8.0, 0.0, 0.0) and got.confusion == pytest.approx(1.0)
    assert intervals.diarization_error(ref, hyp, collar=0.25).first().confusion == pytest.approx(0.75)
    same = intervals.diarization_error(ref, ref.withColumn("label", F.lower("label"))).first()
    assert same.der == 0
    merged = intervals.merge_overlaps(ref.union(hyp)).collect()
    assert [(r.begin, r.end) for r in merged] == [(0.0, 8.0)]
    assert intervals.hysteresis([0.1] * 3 + [0.9] * 10 + [0.1] * 10) == [(pytest.approx(3 * 0.096 - 0.03), pytest.approx(13 * 0.096 + 0.03))]


def test_speech_by_windows_equals_arrays(spark):
    """The array form against a plain state machine written from the rule, and the window form against the array form."""
    rng = random.Random(7)

    def plain(p, threshold=0.5, frame=0.096, least_silence=0.1):
        raw, i = [], 0
        while i < len(p):
            if p[i] < threshold:
                i += 1
                continue
            start, j, end = i, i, None
            while end is None and j < len(p):
                nxt = next((k for k in range(j + 1, len(p)) if p[k] >= threshold), len(p))
                low = [k for k in range(j, nxt) if p[k] < threshold - 0.15]
                if low and (low[-1] - low[0]) * frame >= least_silence:
                    end = low[0]
                j = nxt
            raw.append((start, len(p) if end is None else end, end is not None))
            i = j
        return raw

    rows = []
    for u in range(12):
        level, p = rng.random(), []
        for _ in range(rng.randrange(1, 120)):
            level = rng.random() if rng.random() < 0.3 else level
            p.append(round(min(1.0, max(0.0, level + rng.uniform(-0.2, 0.2))), 3))
        first, stop, closed = intervals.raw_speech(np.array(p))
        assert list(zip(first.tolist(), stop.tolist(), closed.tolist())) == plain(p)
        rows += [(u, i, x) for i, x in enumerate(p)]
    got = {}
    for r in intervals.voice_activity(spark.createDataFrame(rows, "utt long, frame long, p double")).collect():
        got.setdefault(r.utt, []).append((r.begin, r.end))
    for u in range(12):
        assert np.allclose(sorted(got.get(u, [])), intervals.hysteresis([x for k, _, x in rows if k == u]))


def test_missing_vectors_and_broken_waves(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "utt long, emb array<double>")
    trials = spark.createDataFrame([(1, 2), (1, 3)], "enroll long, test long")
    assert scoring.attach(trials, vectors, on_missing="drop").count() == 1
    with pytest.raises(Exception, match="no vector of test 3"):
        scoring.attach(trials, vectors).collect()
    broken = spark.createDataFrame([(1, bytearray(b"junk"))], "utt long, content binary")
    assert binary.decode_waves(broken).count() == 0


def test_datadir(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "utt long, spk string")
    assert {r.utt for r in datadir.filter_ids(df, spark.createDataFrame([(1,)], "x long"), "utt", exclude=True).collect()} == {2, 3}
    with pytest.raises(Exception, match="missing"):
        datadir.lookup(df, spark.createDataFrame([(1, 5)], "utt long, v long"), "utt").collect()
    assert datadir.invert(df, "utt", "spk", "utt", "utts").orderBy("spk").collect()[0].utts == [1, 2]
    assert [r.id for r in datadir.dense_ids(df, "spk").orderBy("id").collect()] == [0, 1]


def test_signal(spark):
    x = np.sin(np.arange(1600) * 0.3) * 1000
    f = signal.fbank(x, bins=40)
    assert f.shape == (8, 40) and np.isfinite(f).all()
    assert len(signal.resample(x, 16000, 8000)) == 800
    noisy = signal.with_noise(x, np.ones(10), 10)
    assert noisy.shape == x.shape
    df = spark.createDataFrame([(1, x.tolist())], "utt long, samples array<double>")
    done = signal.embed(signal.fbank_features(df, bins=40), lambda: lambda m: m.mean(0)).first()
    assert np.allclose(done.emb, f.mean(0))
    feat = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "feat array<array<double>>")
    assert feat.select(signal.mean_normalised(F.col("feat"))).first()[0] == [[-1.0, -2.0], [1.0, 2.0]]


def test_binary_round_trips(spark, tmp_path):
    v = np.arange(5, dtype=float)
    m = np.arange(6, dtype=float).reshape(2, 3)
    data = binary.archive_record("a", v) + binary.archive_record("b", m)
    got = dict(binary.parse_archive(data))
    assert np.allclose(got["a"], v) and np.allclose(got["b"], m)
    (tmp_path / "x.ark").write_bytes(binary.archive_record("a", v))
    assert binary.read_archives(spark, str(tmp_path / "x.ark")).first().emb == v.tolist()
    rate, x = binary.parse_wav(binary.wav_bytes(v, 8000))
    assert rate == 8000 and np.allclose(x[0], v)
    waves = spark.createDataFrame([(1, bytearray(binary.wav_bytes(v, 8000))), (2, bytearray(b"junk"))], "utt long, content binary")
    assert [r.utt for r in binary.decode_waves(waves).collect()] == [1]
    packed = binary.pack_shards(spark.createDataFrame([("k1", {"txt": bytearray(b"hi")}), ("k2", {"txt": bytearray(b"yo")})], "key string, members map<string, binary>"), 10).collect()
    for i, r in enumerate(packed):
        (tmp_path / f"s{i}.tar").write_bytes(r.content)
    found = {r.key: bytes(r.members["txt"]) for r in binary.read_shards(spark, str(tmp_path / "*.tar")).collect()}
    assert found == {"k1": b"hi", "k2": b"yo"}


def test_text_tables(spark, tmp_path):
    (tmp_path / "wav.scp").write_text("u1 a  b\n\nu2 cat x |\n")
    assert [tuple(r) for r in text_tables.read_scp(spark, str(tmp_path / "wav.scp"), "drop").collect()] == [("u1", "a b")]
    with pytest.raises(Exception, match="command"):
        text_tables.read_scp(spark, str(tmp_path / "wav.scp")).collect()
    (tmp_path / "l.txt").write_text("a-b-00001000-00003000-00000000-00000150 7\n")
    assert tuple(text_tables.read_labels(spark, str(tmp_path / "l.txt")).first()) == ("a-b", 1.0, 2.5, "7")


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(4)
    frames = [("u", i, rng.random(), i == 59) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(frames[20 * k : 20 * k + 20], "utt string, frame long, p double, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("utt string, frame long, p double, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows.use_timers(spark)
    q = windows.speech_stream(stream).writeStream.format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = intervals.hysteresis([p for _, _, p, _ in frames])
    assert sorted((r.begin, r.end) for r in spark.table("spans").collect()) == sorted(batch)
    pieces = [("u", i, [float(i)] * 3, i == 4) for i in range(5)]
    for p in pieces:
        spark.createDataFrame([p], "utt string, at long, samples array<double>, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema("utt string, at long, samples array<double>, last boolean").parquet(str(tmp_path / "in2"))
    q = windows.chunk_stream(stream, 4).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    got = [x for r in sorted(spark.table("chunks").collect(), key=lambda r: r.chunk) for x in r.samples]
    assert got == [float(i) for i in range(5) for _ in range(3)] + [0.0]


def test_speakers_and_cli(spark, tmp_path, capsys):
    from timbral import cli
    from timbral.speakers import Speakers

    t = np.arange(16000 * 4) / 16000
    two = np.where(t < 2, np.sin(2 * np.pi * 300 * t), np.sin(2 * np.pi * 2500 * t)) * 1000
    s = Speakers(lambda: lambda m: np.concatenate([m[:, :40].mean(0), m[:, 40:].mean(0)]) if len(m) else np.zeros(80))
    recordings = spark.createDataFrame([("a", two.tolist()), ("b", two[::-1].tolist())], "utt string, samples array<double>")
    emb = s.embeddings(recordings)
    assert emb.count() == 2
    vectors = spark.createDataFrame([("u", [1.0, 0.0]), ("v", [0.9, 0.1])], "utt string, emb array<double>")
    s.register(vectors.select(F.col("utt").alias("name"), "emb").where("utt = 'u'"))
    s.register(spark.createDataFrame([("w", [-1.0, 0.0])], "name string, emb array<double>"))
    assert {r.name for r in s.recognize(vectors).collect()} == {"u"}
    trials = spark.createDataFrame([("u", "v"), ("u", "x")], "enroll string, test string")
    assert {r.test: r.score > 0.9 for r in s.similarity(trials, vectors).collect()} == {"v": True, "x": False}
    turns = s.diarize(spark.createDataFrame([("a", 0.0, 4.0)], "utt string, begin double, end double"), recordings)
    assert turns.count() >= 1
    vectors.write.parquet(str(tmp_path / "emb"))
    (tmp_path / "trials").write_text("u v target\nv u nontarget\nu u target\n")
    cli.main(["score", "--trials", str(tmp_path / "trials"), "--embeddings", str(tmp_path / "emb"), "--out", str(tmp_path / "scores")])
    cli.main(["measure", "--scores", str(tmp_path / "scores")])
    assert "eer_percent" in capsys.readouterr().out


def test_small_helpers(spark):
    df = spark.createDataFrame([(i, f"/old/{i}.wav") for i in range(20)], "utt long, path string")
    assert datadir.shuffled(df, "utt", "1").count() == 20 and sum(datadir.share_of(df, "utt", k, 3).count() for k in range(3)) == 20
    moved = datadir.copied({"wav": df}, "utt", df.where("utt < 5").select("utt"), old="/old", new="/new")["wav"]
    assert moved.count() == 5 and moved.first().path.startswith("/new/") and datadir.same_rows(df, df) and not datadir.same_rows(df, moved)
    x = spark.createDataFrame([(1, [1.0] * 10), (2, [1.0] * 2)], "utt long, samples array<double>")
    assert [len(r.samples) for r in signal.length_between(x, 3, 6).collect()] == [6]
    feat = spark.createDataFrame([([[1.0], [2.0], [3.0]],)], "feat array<array<double>>")
    assert feat.select(signal.feature_chunks(F.col("feat"), 2)).first()[0] == [[[1.0], [2.0]], [[3.0], [1.0]]]
    assert len(signal.speed_perturbed(np.ones(900), 0.9)) == 1000
