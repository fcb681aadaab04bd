"""Clustering within a recording, as grouped maps: a recording is one group, recordings are spread."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    """Labels by k-means with seeded, distance-weighted starts; the best of four runs."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(4):
        centres = [x[rng.integers(len(x))]]
        for _ in range(k - 1):
            d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        centres = np.array(centres)
        for _ in range(rounds):
            label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            after = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
            if np.allclose(after, centres):
                break
            centres = after
        loss = ((x - centres[label]) ** 2).sum()
        if best is None or loss < best[0]:
            best = (loss, label)
    return best[1]


#: Points up to which a graph is held as a matrix; numbers of one block of products.
DENSE, BLOCK = 2000, 1 << 21


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def strongest(unit: np.ndarray, weakest: int) -> np.ndarray:
    """The neighbours of each point, itself included, that are left without its weakest; of equal ones the later stay. Made by blocks of rows."""
    m, found = len(unit), []
    for at in range(0, m, step := max(1, BLOCK // m)):
        affinity = 0.5 * (1 + unit[at : at + step] @ unit.T)
        least = np.partition(affinity, weakest, axis=1)[:, weakest, None]
        kept, tied = affinity > least, affinity == least
        spare = (m - weakest) - kept.sum(1, keepdims=True)
        kept |= tied & (np.cumsum(tied[:, ::-1], axis=1)[:, ::-1] <= spare)
        found.append(np.nonzero(kept)[1].astype(np.int32).reshape(-1, m - weakest))
    return np.concatenate(found)


def _laplacian(near: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The product of a block of vectors with the Laplacian of the graph ``(A + A') / 2`` without loops; only lists of neighbours are held."""
    m, width = near.shape
    order = np.argsort(near, axis=None, kind="stable")
    source = (order // width).astype(np.int32)
    del order
    ends = np.concatenate([[0], np.cumsum(np.bincount(near.ravel(), minlength=m))])
    loops = np.array([np.count_nonzero(near[i] == i) for i in range(m)], float)
    degree = 0.5 * (width + np.diff(ends)) - loops

    def product(v: np.ndarray) -> np.ndarray:
        out = (degree + loops)[:, None] * v
        for at in range(0, m, step := max(1, BLOCK // (width * v.shape[1]))):
            out[at : at + step] -= 0.5 * v[near[at : at + step]].sum(1)
            first = ends[at : at + step + 1]
            own = v[source[first[0] : first[-1]]]
            some = np.diff(first) > 0
            if some.any():
                out[at : at + step][some] -= 0.5 * np.add.reduceat(own, (first[:-1] - first[0])[some], axis=0)
        return out

    return product


def smallest(product: Callable[[np.ndarray], np.ndarray], m: int, n: int, seed: int = 0, tolerance: float = 1e-7, steps: int = 12, restarts: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The n smallest eigenvalues and their vectors of a symmetric matrix known by its products: a Krylov space of blocks, wider than n,
    as eigenvalues may repeat, begun again from its best vectors until the residuals are small. Raises where they don't become so."""
    width = n + 11
    held = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, width)))[0]
    for _ in range(restarts):
        basis, images, block = held, product(held), None
        for _ in range(steps):
            rest = (images if block is None else images[:, -width:]) - basis @ (basis.T @ (images if block is None else images[:, -width:]))
            rest -= basis @ (basis.T @ rest)
            block = np.linalg.qr(rest[:, :width])[0]
            block -= basis @ (basis.T @ block)
            block = np.linalg.qr(block)[0]
            basis, images = np.hstack([basis, block]), np.hstack([images, product(block)])
        inner = basis.T @ images
        values, turn = np.linalg.eigh(0.5 * (inner + inner.T))
        held, moved = basis @ turn[:, :width], images @ turn[:, :width]
        left = np.linalg.norm(moved - held * values[:width], axis=0)[:n]
        if left.max() <= tolerance * max(1.0, values[-1]):
            return values[:n], held[:, :n]
        held = np.linalg.qr(held)[0]
    raise ValueError(f"eigenvectors are off by {left.max():.1e}")


def spectral(x: np.ndarray, least: int = 1, most: int = 20, count: int | None = None, seed: int = 0, dense: int = DENSE) -> np.ndarray:
    """Labels by eigenvectors of the Laplacian of a pruned cosine graph; the number of clusters is where the eigenvalues leap.

    Of more than ``dense`` points only the lists of neighbours and the smallest eigenvectors are held, not matrices of all pairs.
    """
    m = len(x)
    if m <= 2:
        return np.zeros(m, int)
    unit = _unit(x)
    weakest = max(m - 10, 2) if m < 1000 else int(0.99 * m)
    if m > max(dense, 20 * (most + 12)):
        values, vectors = smallest(_laplacian(strongest(unit, weakest)), m, max(most + 1, count or 0), seed)
    else:
        affinity = 0.5 * (1 + unit @ unit.T)
        graph = np.ones_like(affinity)
        np.put_along_axis(graph, np.argsort(affinity, axis=1, kind="stable")[:, :weakest], 0.0, axis=1)
        graph = 0.5 * (graph + graph.T)
        np.fill_diagonal(graph, 0.0)
        values, vectors = np.linalg.eigh(np.diag(np.abs(graph).sum(1)) - graph)
    if count is None:
        leaps = np.diff(values[: most + 1])
        count = max(least, int(np.argmax(leaps)) + 1 if len(leaps) else 1)
    return kmeans(vectors[:, :count], count, seed)


def merge_by_cost(x: np.ndarray, labels: np.ndarray, merge_from: float = 0.3, small: int = 3, absorb_from: float = 0.0) -> np.ndarray:
    """Labels after a noise-aware pass: points labelled -1 begin as clusters of one; clusters merge, best mean cosine first,
    from merge_from on (two that were labelled never do); small ones then join the best large one; labels are renumbered as they appear.

    A merged cluster is never nearer to a third than the nearer of its parts was. So two clusters that are nearest to each other can
    merge at any time with the same outcome, and only sums of clusters are held, never the costs of all pairs.
    """
    unit = _unit(x)
    named, own = np.unique(labels[labels != -1], return_inverse=True)
    free = np.flatnonzero(labels == -1)
    # equal directions merge first of all; zeros have none
    alike = np.arange(len(free))
    if merge_from <= 1 and len(free):
        _, first, back = np.unique(unit[free], axis=0, return_index=True, return_inverse=True)
        alike = np.where((unit[free] != 0).any(1), first[back.ravel()], alike)
    firsts, slot = np.unique(alike, return_inverse=True)
    start = np.empty(len(x), int)
    start[labels != -1], start[free] = own, len(named) + slot
    k = len(named) + len(firsts)
    sums, size, fixed, alive, into = np.zeros((k, x.shape[1])), np.bincount(start, minlength=k), np.arange(k) < len(named), np.ones(k, bool), np.arange(k)
    np.add.at(sums, start, unit)
    mean = sums / size[:, None]
    made = np.where(fixed | (size == 1), np.inf, 1.0)  # the cost of a cluster's last merge: the order in which clusters came about
    near, best, second = np.full(k, -1), np.full(k, -np.inf), np.full(k, -np.inf)

    def search(asked: np.ndarray) -> None:
        """The nearest cluster of each, its cost, and a bound for the costs of all others."""
        others = np.flatnonzero(alive)
        if len(others) < 2:
            near[asked], best[asked] = -1, -np.inf
            return
        there = mean[others].T.copy()
        for at in range(0, len(asked), step := max(1, BLOCK // len(others))):
            part = asked[at : at + step]
            cost = mean[part] @ there
            cost[np.arange(len(part)), np.searchsorted(others, part)] = -np.inf
            cost[np.ix_(fixed[part], fixed[others])] = -np.inf
            top = cost.argmax(1)
            near[part], best[part] = others[top], cost[np.arange(len(part)), top]
            cost[np.arange(len(part)), top] = -np.inf
            second[part] = cost.max(1)

    search(np.arange(k))
    while True:
        ready = np.flatnonzero(alive & (best >= merge_from))
        if not len(ready):
            break
        a = ready[(near[near[ready]] == ready) & (ready < near[ready])]
        if not len(a):  # equal costs up to their last digits in a circle
            a = ready[[best[ready].argmax()]]
        b = near[a]
        sums[a] += sums[b]
        made[a] = best[a]
        size[a] += size[b]
        fixed[a] |= fixed[b]
        mean[a] = sums[a] / size[a, None]
        alive[b], into[b] = False, a
        changed = np.zeros(k, bool)
        changed[a] = changed[b] = True
        touched = np.flatnonzero(alive & ~changed & changed[near] & (best >= merge_from))
        near[touched] = into[near[touched]]
        best[touched] = np.where(fixed[touched] & fixed[near[touched]], -np.inf, (mean[touched] * mean[near[touched]]).sum(1))
        search(np.concatenate([a, touched[best[touched] < second[touched]]]))
    while (into[into] != into).any():
        into = into[into]
    large, few = np.flatnonzero(alive & (size >= small)), np.flatnonzero(alive & (size < small))
    large = large[np.argsort(-made[large], kind="stable")]
    if len(large):
        for at in range(0, len(few), step := max(1, BLOCK // len(large))):
            part = few[at : at + step]
            cost = mean[part] @ mean[large].T
            top = cost.argmax(1)
            into[part] = np.where(cost[np.arange(len(part)), top] >= absorb_from, large[top], part)
    owner = into[into[start]]
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(o), len(seen)) for o in owner], int)


def cluster(df: DataFrame, key: str = "utt", order: str = "ord", emb: str = "emb", method: str = "spectral", **settings) -> DataFrame:
    """``(key, order, label)`` for each row. method: spectral, or merge (every point begins unlabelled)."""
    kinds = [df.schema[c].dataType.simpleString() for c in (key, order)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.stack(pdf[emb].to_numpy()).astype(float)
        label = spectral(x, **settings) if method == "spectral" else merge_by_cost(x, np.full(len(x), -1), **settings)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "label": label})

    return df.select(key, order, emb).groupBy(key).applyInPandas(run, f"{key} {kinds[0]}, {order} {kinds[1]}, label long")


EPSILON = 1e-5


def _goes_right(own: float, left: float, right: float, least: float) -> bool:
    """A neighbour on the right that is long enough is spared; else the side goes that lifts the sum over least; of two such, the shorter."""
    below = lambda x, y: x < y - EPSILON
    if below(least, right):
        return False
    if below(left + own, least):
        return True
    return not below(right + own, least) and not below(left, right)


def combine_short(least: float, durations: list[float]) -> list[tuple[int, int]]:
    """Neighbouring ranges [a, b) that reach the given total where they can; short ones are joined, the later ones first."""
    groups = [(i, i + 1, d) for i, d in enumerate(durations)]
    queue = [i for i, (_, _, d) in enumerate(groups) if d < least - EPSILON]
    spans = {i: g for i, g in enumerate(groups)}
    left = {i: i - 1 for i in spans}
    right = {i: i + 1 if i + 1 < len(groups) else -1 for i in spans}
    while queue:
        i = queue.pop()
        if i not in spans or spans[i][2] >= least - EPSILON:
            continue
        a, b = left[i], right[i]
        if a < 0 and b < 0:
            break
        to = b if a < 0 else a if b < 0 else (a, b)[_goes_right(spans[i][2], spans[a][2], spans[b][2], least)]
        first, second = (to, i) if to == a else (i, to)
        joined = (spans[first][0], spans[second][1], spans[first][2] + spans[second][2])
        new, l, r = max(spans) + 1 + len(groups), left[first], right[second]
        del spans[first], spans[second]
        spans[new], left[new], right[new] = joined, l, r
        if l >= 0:
            right[l] = new
        if r >= 0:
            left[r] = new
        if joined[2] < least - EPSILON:
            queue.append(new)
    return sorted((a, b) for a, b, _ in spans.values())


def combine_utterances(df: DataFrame, least: float, key: str = "spk", order: str = "utt", duration: str = "dur") -> DataFrame:
    """``(key, name, parts, dur)``: utterances of a speaker in order, short ones joined; a joined one is named after its first."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        utts, durations = pdf[order].astype(str).tolist(), pdf[duration].astype(float).tolist()
        rows = [(pdf[key].iloc[0], utts[a] if b - a == 1 else f"{utts[a]}-comb{b - a}", utts[a:b], sum(durations[a:b])) for a, b in combine_short(least, durations)]
        return pd.DataFrame(rows, columns=[key, "name", "parts", "dur"])

    return df.select(key, order, duration).groupBy(key).applyInPandas(run, f"{key} {kind}, name string, parts array<string>, dur double")
