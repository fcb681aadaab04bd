"""Draws, margins, frames of sub-segments and model files: edge rows, brute force, independence of the partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import draws
from timbral.operators import augment, backend, frames, margins
from timbral.sources import models


def test_draws_keep_their_shares_and_do_not_see_partitions(spark):
    df = spark.range(20000).withColumn("class", draws.whole(F.col("id"), "s", 0, 4)).withColumn("u", draws.unit(F.col("id"), "s", 1))
    shares = [r["count"] / 20000 for r in df.groupBy("class").count().orderBy("class").collect()]
    assert len(shares) == 4 and max(abs(s - 0.25) for s in shares) < 0.015
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.01
    again = spark.range(20000).repartition(7).withColumn("u2", draws.unit(F.col("id"), "s", 1))
    assert df.join(again, "id").where("u != u2").count() == 0
    nulls = spark.sql("SELECT CAST(NULL AS STRING) AS k, 0 AS n").select(draws.unit(F.col("k"), "s", 0).alias("u"), draws.whole(F.col("k"), "s", 0, F.col("n")).alias("w")).first()
    assert 0 <= nulls.u < 1 and nulls.w is None


def test_noises_of_each_class_are_in_their_range(spark):
    noises = spark.createDataFrame([(f"{c}-{i}",) for c in ("noise", "speech", "music", "babble") for i in range(5)], "name string")
    rooms = spark.createDataFrame([("a",), ("b",)], "name string")
    got = augment.drawn_noise(spark.range(4000).withColumnRenamed("id", "utt"), noises, rooms, "utt", "e1").toPandas()
    assert len(got) == 4000
    share = got["augment"].value_counts(normalize=True)
    assert abs(share["none"] - 0.4) < 0.03 and abs(share["reverb"] - 0.3) < 0.03
    loud = got[got["augment"] == "noise"]
    assert loud["source"].nunique() == 20
    for cls, (low, high) in {**augment.NOISE_LEVELS, "babble": augment.OTHER_LEVEL}.items():
        snr = loud[loud["source"].str.startswith(cls)]["snr_db"]
        assert low <= snr.min() < low + 1 and high - 1 < snr.max() <= high
    assert got[got["augment"] != "noise"]["snr_db"].isna().all()


def test_no_noises_leave_rows_as_they_are(spark):
    none = spark.createDataFrame([], "name string")
    got = augment.drawn_noise(spark.range(50).withColumnRenamed("id", "utt"), none, none, "utt", "e1")
    assert got.count() == 50 and got.where("augment != 'none' OR source IS NOT NULL").count() == 0
    assert augment.drawn_noise(spark.createDataFrame([], "utt long"), none, none, "utt", "e1").count() == 0


def test_masks_of_null_empty_and_small_matrices(spark):
    df = spark.createDataFrame([(0, None), (1, []), *((i, [[1.0, 1.0, 1.0]] * 4) for i in range(2, 200))], "utt long, feat array<array<double>>")
    got = {r.utt: r for r in augment.masked(df, "utt", "s", most_frames=2, most_bins=1).collect()}
    assert len(got) == 200 and got[0].feat is None and got[1].feat == []
    for r in list(got.values()):
        if r.utt < 2:
            continue
        x = np.array(r.feat)
        want = np.ones((4, 3))
        if r.masked:
            for a, z in r.time_spans:
                want[a:z] = 0
            for a, z in r.bin_spans:
                want[:, a:z] = 0
            assert 1 <= r.time_spans[0].end - r.time_spans[0].first <= 2
        assert (x == want).all()


def test_mixed_noise_is_fitted_and_scaled(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.0, -1.0], [0.5, -0.5, 0.5], 0.0), ([1.0, 2.0], [], 3.0), ([1.0, 2.0], [1.0], None)], "samples array<double>, noise array<double>, snr_db double")
    a, b, c = (r.samples for r in augment.mixed(df).collect())
    assert max(map(abs, a)) == pytest.approx(1.0, abs=1e-3) and len(a) == 4
    assert b == [1.0, 2.0] and c == [1.0, 2.0]


def brute(x, labels, centres, top, margin=0.2, scale=32.0, low=0.06):
    classes = sorted({c for c, _ in centres})
    unit = lambda v: np.asarray(v) / max(np.linalg.norm(v), 1e-12)
    out = []
    for v, label in zip(x, labels):
        cos = {c: max(float(np.clip(unit(v) @ unit(w), -1, 1)) for k, w in centres if k == c) for c in classes}
        hard = sorted((c for c in classes if c != label), key=lambda c: (-cos[c], c))[:top]
        angle = {c: math.acos(cos[c]) for c in classes}
        logit = {c: scale * (math.cos(angle[c] - low) if c in hard else cos[c]) for c in classes}
        if label in cos:
            turn = math.cos(math.pi - margin)
            logit[label] = scale * (math.cos(angle[label] + margin) if cos[label] > turn else cos[label] - 1 - turn)
        peak = max(logit.values())
        loss = peak + math.log(sum(math.exp(z - peak) for z in logit.values())) - logit[label] if label in logit else None
        out.append((logit.get(label), hard, loss))
    return out


@pytest.mark.parametrize(("slab", "block"), [(512, 1024), (3, 2)])
def test_hardest_margin_by_brute_force_in_any_blocks(spark, slab, block):
    rng = np.random.default_rng(5)
    centres = [(c, rng.normal(size=6).tolist()) for c in range(9) for _ in range(1 + c % 3)]
    x = rng.normal(size=(25, 6))
    x[3], x[4] = 0.0, -np.array(centres[0][1])  # no direction; opposite to a centre of its class
    labels = [0 if i == 4 else 77 if i == 6 else int(rng.integers(9)) for i in range(25)]
    rows = [(f"u{i}", labels[i], x[i].tolist()) for i in range(25)] + [("none", 1, None), ("free", None, x[0].tolist())]
    samples = spark.createDataFrame(rows, "utt string, cls long, emb array<double>").repartition(3)
    table = spark.createDataFrame([*centres, (None, x[0].tolist()), (5, None)], "cls long, emb array<double>")
    got = {r.utt: r for r in margins.hardest_margin(samples, table, top=3, slab=slab, block=block).collect()}
    assert set(got) == {f"u{i}" for i in range(25)} | {"free"}
    for i, (own, hard, loss) in enumerate(brute(x, labels, centres, 3)):
        r = got[f"u{i}"]
        assert [h.cls for h in r.hard] == hard and r.n_classes == 9
        assert r.own_logit == (None if own is None else pytest.approx(own, abs=1e-6))
        assert r.loss == (None if loss is None else pytest.approx(loss, abs=1e-6))
    assert got["free"].loss is None and len(got["free"].hard) == 3


def test_margins_of_repeated_rows_and_empty_tables(spark):
    kinds = "utt string, cls long, emb array<double>"
    samples = spark.createDataFrame([("a", 0, [1.0, 0.0])] * 3, kinds)
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cls long, emb array<double>")
    got = margins.hardest_margin(samples, centres).collect()
    assert len(got) == 3 and len({(r.own, r.loss) for r in got}) == 1 and len(got[0].hard) == 1
    assert margins.hardest_margin(spark.createDataFrame([], kinds), centres).count() == 0
    angle = margins.pairwise_binary(samples, centres, kind="angle").first()
    g = lambda c: 2 * ((c + 1) / 2) ** 3 - 1
    want = 0.7 * math.log1p(math.exp(-32 * g(math.cos(0.2)))) + 0.3 * math.log1p(math.exp(32 * g(math.sin(0.2))))
    assert angle.loss == pytest.approx(want, abs=1e-9)


def test_multiplied_angle_falls_with_the_angle(spark):
    df = spark.range(201).select((F.col("id") / 100 - 1).alias("c"))
    for m in range(1, 6):
        got = [r[0] for r in df.select(margins.multiplied_angle(F.col("c"), F.lit(True), F.lit(1.0), margin=m, step=10**6)).collect()]
        assert all(a <= b + 1e-9 for a, b in zip(got, got[1:]))
        theta = math.acos(0.9)
        one = spark.range(1).select(margins.multiplied_angle(F.lit(0.9), F.lit(True), F.lit(2.0), margin=m, least=0.0, step=10**9, power=9.0)).first()[0]
        k = math.floor(m * theta / math.pi)
        assert one == pytest.approx(2 * ((-1) ** k * math.cos(m * theta) - 2 * k), abs=1e-6)


def filled(x, window):
    return np.resize(x, (window, x.shape[1]))


@pytest.mark.parametrize("normalise", ["piece", "segment", None])
def test_pieces_by_brute_force(spark, normalise):
    rng = np.random.default_rng(3)
    feats = {"a": rng.normal(size=(400, 3)), "b": rng.normal(size=(37, 3))}
    matrices = spark.createDataFrame([(k, v.tolist()) for k, v in feats.items()], "utt string, feat array<array<double>>")
    segments = [("s0", "a", 0, 400), ("s1", "a", 250, 20), ("s2", "b", 0, 39), ("s3", "b", 30, 90), ("s4", "b", 37, 4), ("s5", "gone", 0, 5), ("s1", "a", 250, 20)]
    df = spark.createDataFrame([*segments, (None, "a", 0, 9), ("s9", "a", 0, 0)], "seg string, rec string, first long, n_frames long")
    got = frames.piece_frames(df, frames.blocks_of_matrices(matrices, size=16), 60, 30, normalise, size=16).collect()
    want = {}
    for seg, rec, first, n in segments:
        whole = feats.get(rec, np.empty((0, 3)))[first : first + n]
        begins = [0] if n <= 60 else range(0, n - 60 + 30, 30)
        for b in begins:
            z = min(b + 60, n)
            x = whole[b:z]
            if len(x):
                x = filled(x, 60)
                x = x - x.mean(0) if normalise == "piece" else x - whole.mean(0) if normalise == "segment" else x
            want[seg, b, z] = x
    assert len(got) == len(want)
    for r in got:
        x = want[r.seg, r.begin, r.end]
        assert (r.feat is None) == (len(x) == 0)
        if len(x):
            np.testing.assert_allclose(np.array(r.feat), x, atol=1e-9)


def test_blocks_of_rows_and_piece_ids(spark):
    rows = [("a", i, [float(i)]) for i in range(10)] + [("a", 3, [3.0]), (None, 0, [1.0]), ("a", None, [1.0]), ("b", 0, None)]
    got = frames.blocks_of_rows(spark.createDataFrame(rows, "rec string, frame long, cells array<double>"), size=4).collect()
    assert {(r.rec, r.block): [f[0] for f in r.feats] for r in got} == {("a", 0): [0, 1, 2, 3], ("a", 1): [4, 5, 6, 7], ("a", 2): [8, 9]}
    one = spark.sql("SELECT 'x' AS seg, 75L AS begin, 225L AS end").select(frames.piece_id()).first()[0]
    assert one == "x-00000075-00000225"


def _plda(d=4):
    rng = np.random.default_rng(1)
    return backend.Plda(rng.normal(size=d), rng.normal(size=(d, d)), rng.random(d))


@pytest.mark.parametrize("binary", [True, False])
def test_model_files_come_back_equal(spark, tmp_path, binary):
    plda = _plda()
    models.write_plda(plda, str(tmp_path / "m" / "plda"), binary)
    back = models.read_plda(spark, str(tmp_path / "m" / "plda"))
    for a, b in ((plda.mean, back.mean), (plda.transform, back.transform), (plda.psi, back.psi)):
        assert (a == b).all()


def test_single_precision_and_broken_models():
    plda = _plda(3)
    line = lambda v: b"FV \4" + len(v).to_bytes(4, "little") + np.asarray(v, "<f4").tobytes()
    size = (3).to_bytes(4, "little")
    data = b"\0B<Plda> " + line(plda.mean) + b"FM \4" + size + b"\4" + size + np.asarray(plda.transform, "<f4").tobytes() + line(plda.psi) + b"</Plda> "
    np.testing.assert_allclose(models.parse_plda(data).transform, plda.transform, rtol=1e-6)
    for bad in (data[:-20], data.replace(b"</Plda>", b"</Plde>"), b"\0B<Other> ", b"", b"<Plda> [ 1 2 ]\n </Plda>", b"<Plda> [ 1 2 ]\n [\n 1 2 ]\n [ 1 2 ]\n</Plda>"):
        with pytest.raises((ValueError, EOFError)):
            models.parse_plda(bad)


def test_chains_are_saved_and_links_replaced(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [1, 2, 3, 4] + 1
    df = spark.createDataFrame([(i % 6, v.tolist()) for i, v in enumerate(x)], "spk long, emb array<double>").repartition(3)
    links = backend.fit_chain("mean-subtract | whitening | lda --dim=2 | length-norm", df)
    models.save_chain(spark, links, str(tmp_path / "chain"))
    back = models.load_chain(spark, str(tmp_path / "chain"))
    assert [(a.method, a.options, a.values) for a in links] == [(b.method, b.options, b.values) for b in back]
    new = models.replaced_link(back, 2, "lda --dim 3", df)
    assert len(new[2].values["columns"]) == 3 and new[1].values == links[1].values and len(back[2].values["columns"]) == 2
    with pytest.raises(ValueError):
        models.replaced_link(back, 2, "length-norm | length-norm", df)
    with pytest.raises(IndexError):
        models.replaced_link(back, 9, "length-norm", df)


def test_expressions_and_batches_of_vectors_agree(spark):
    plda = _plda()
    df = spark.createDataFrame([(1 << 60, [1.0, 2.0, 3.0, 4.0], "x"), (None, None, None), (3, [0.5, -1.0, 0.0, 2.0], "y")], "utt long, emb array<double>, clash string").coalesce(1)
    a = df.withColumn("emb", plda.transformed(F.col("emb"))).collect()
    b = backend.mapped(df, plda.transformed_rows).collect()
    assert [(r.utt, r.clash) for r in a] == [(r.utt, r.clash) for r in b] and b[1].emb is None
    for r, s in zip(a, b):
        if s.emb is not None:
            np.testing.assert_allclose(r.emb, s.emb)
    assert backend.mapped(df.limit(0), plda.transformed_rows).count() == 0
