"""Clusters of long recordings: what is held doesn't grow with the pairs of points."""

import itertools
import tracemalloc

import numpy as np

from timbral.operators import clustering, intervals


def _points(m, kinds, seed, noise=0.4, width=16):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(m, width)) * noise + rng.normal(size=(kinds, width))[rng.integers(0, kinds, m)]


def _peak_mb(call):
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def _greedy(x, labels, merge_from):
    """Groups after merges of the best pair, one at a time."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    groups = [(list(np.flatnonzero(labels == k)), True) for k in sorted(set(labels.tolist()) - {-1})] + [([i], False) for i in np.flatnonzero(labels == -1)]
    cost = lambda a, b: -np.inf if a[1] and b[1] else float(unit[a[0]].sum(0) @ unit[b[0]].sum(0)) / (len(a[0]) * len(b[0]))
    while len(groups) > 1:
        best, i, j = max((cost(groups[i], groups[j]), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
        if best < merge_from:
            break
        joined = (groups[i][0] + groups[j][0], groups[i][1] or groups[j][1])
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [joined]
    return {frozenset(int(p) for p in g) for g, _ in groups}


def test_merges_are_those_of_the_best_pair_each():
    rng = np.random.default_rng(3)
    for t in range(12):
        x = _points(30, 4, t, noise=float(rng.choice([0.5, 2.0])), width=5)
        if t % 3 == 0:
            x[:8] = x[0]
        labels = rng.integers(-1, 3, 30) if t % 2 else np.full(30, -1)
        got = clustering.merge_by_cost(x, labels, 0.5, small=1)
        assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got.tolist())} == _greedy(x, labels, 0.5)


def test_merging_holds_no_pairs():
    found, peak = _peak_mb(lambda: clustering.merge_by_cost(_points(1200, 6, 1, noise=0.1), np.full(1200, -1)))
    assert len(found) == 1200 and peak < 80


def test_spectral_by_lists_of_neighbours_equals_the_matrix():
    for m, kinds in ((1100, 4), (1500, 6)):
        x = _points(m, kinds, m)
        a, b = clustering.spectral(x, dense=m), clustering.spectral(x, dense=0)
        assert len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))
    apart = np.repeat(np.eye(30), 40, axis=0)  # zero is an eigenvalue many times
    values, _ = clustering.smallest(clustering._laplacian(clustering.strongest(apart, len(apart) - 12)), len(apart), 21)
    assert np.abs(values).max() < 1e-6


def test_spectral_holds_no_pairs():
    found, peak = _peak_mb(lambda: clustering.spectral(_points(3000, 5, 1)))
    assert len(set(found.tolist())) == 5 and peak < 200


def test_error_of_a_diarization_reads_its_spans_from_a_table(spark):
    turns = spark.createDataFrame([("u", float(i), float(i + 1), f"s{i % 3}") for i in range(9)], "utt string, begin double, end double, label string")
    out = intervals.diarization_error(intervals.merge_turns(turns).selectExpr("utt", "turn_begin AS begin", "turn_end AS end", "label"), turns, collar=0.0)
    assert out.first()["der"] == 0.0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_set" not in plan
