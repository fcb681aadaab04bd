"""Blocked products against plain numpy: many blocks, merges over several rounds, ties, nulls, repeated rows, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import vec
from timbral.operators import backend, products, scoring


def frame(spark, rows, name):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in rows], f"{name} string, emb array<double>")


def cosines(x, w):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (w / np.linalg.norm(w, axis=1, keepdims=True)).T


@pytest.fixture(scope="module")
def sides():
    draw = np.random.default_rng(3)
    return draw.normal(size=(70, 6)), draw.normal(size=(90, 6))


def test_largest_and_spread_over_many_blocks(spark, sides, monkeypatch):
    x, w = sides
    monkeypatch.setattr(products, "TOGETHER", 2)
    monkeypatch.setattr(products, "MERGED", 3)
    left = products.slabs(frame(spark, [*((f"u{i}", v) for i, v in enumerate(x)), ("none", None)], "utt"), size=24)
    names = frame(spark, [*((f"c{i}", v) for i, v in enumerate(w)), ("none", None), ("flat", [0] * 6)], "name")
    cos = cosines(x, w)
    best = {r.key: r.best for r in products.largest(left, names, 7, block=8).collect()}
    spread = {r.key: (r.mean, r.std) for r in products.spread_of(left, names, block=8).collect()}
    assert set(best) == set(spread) == {f"u{i}" for i in range(70)}
    for i in range(70):
        assert np.allclose(best[f"u{i}"], np.sort(cos[i])[::-1][:7])
        assert np.allclose(spread[f"u{i}"], (cos[i].mean(), cos[i].std()))


def test_cohort_smaller_than_top_and_empty(spark, sides):
    x, w = sides
    vectors, names = frame(spark, [("a", x[0])], "utt"), frame(spark, [(str(i), v) for i, v in enumerate(w[:3])], "name")
    row = scoring.cohort_stats(vectors, names, 300).first()
    cos = cosines(x[:1], w[:3])[0]
    assert np.allclose((row["mean"], row["std"]), (cos.mean(), cos.std()))
    for top in (None, 5):
        assert scoring.cohort_stats(vectors, names.limit(0), top).count() == 0
        assert scoring.cohort_stats(vectors.limit(0), names, top).count() == 0


def test_nearest_breaks_ties_by_name_in_any_block(spark, sides):
    x, w = sides
    twins = [(f"z{i:02}", 3 * w[4]) for i in range(20)] + [("b", w[4]), ("far", -w[4])]
    names = frame(spark, [(f"m{i}", v) for i, v in enumerate(w)] + twins, "name")
    queries = frame(spark, [(f"u{i}", v) for i, v in enumerate(x)] + [("twin", w[4]), ("twin", w[4]), ("zero", 0 * w[4])], "utt")
    out = products.nearest(products.slabs(queries, size=24), names, block=12).collect()
    got = {r.key: (r.name, r.score) for r in out}
    assert got["twin"][0] == "b" and sum(r.key == "twin" for r in out) == 2 and "zero" not in got
    cos = cosines(x, w)
    for i in range(70):
        j = int(cos[i].argmax())
        assert np.isclose(got[f"u{i}"][1], cos[i, j]) and (j == 4 or got[f"u{i}"][0] == f"m{j}")
    assert scoring.identify(queries, names, least=1.5).count() == 0


def test_held_values_are_those_of_plain_lambdas(spark):
    df = spark.createDataFrame([([3.0, 4.0],), (None,), ([],)], "v array<double>")
    rows = df.select(vec.length_norm(F.col("v")).alias("u"), vec.held(F.size("v"), lambda n: n + 1).alias("n")).collect()
    assert np.allclose(rows[0].u, [0.6, 0.8]) and rows[0].n == 3 and rows[1].u is None and rows[2].u == []


def test_class_sums_travel_in_pieces(spark, sides, monkeypatch):
    x, _ = sides
    monkeypatch.setattr(backend, "PIECE", 5)
    labels = [i // 3 if i < 30 else 10 + i // 5 for i in range(70)]
    rows = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in zip(labels, x)], "spk int, emb array<double>").repartition(7)
    stats = backend.class_stats(rows)
    assert stats.n == 70 and np.allclose(stats.mean, x.mean(0))
    means = {k: x[[i for i, l in enumerate(labels) if l == k]].mean(0) - x.mean(0) for k in set(labels)}
    for size, (k, s, ss) in stats.by_size.items():
        own = np.array([m for c, m in means.items() if labels.count(c) == size])
        assert k == len(own) and np.allclose(s, own.sum(0)) and np.allclose(ss, own.T @ own)
