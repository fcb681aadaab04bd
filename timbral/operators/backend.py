"""Scoring models: processing chains, discriminant projection, two-covariance likelihood ratios, adaptation.

Sums over vectors are Spark jobs, as flat arrays of partial sums of each task; what comes
to the driver is of the size of one D x D matrix (one per class size for the class means).
"""

from __future__ import annotations

import shlex
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from . import scoring

#: Numbers of a sum of outer products that travel as one row.
PIECE = 4096


def moments(df: DataFrame, emb: str = "emb") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of all vectors; each task adds up its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["emb"].to_numpy()).astype(float)
                n, s, ss = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if ss is None else ss + x.T @ x
        if n:
            yield pd.DataFrame({"pos": np.arange(-1, len(s) * (len(s) + 1)), "x": np.concatenate([[n], s, ss.ravel()])})

    parts = df.select(F.col(emb).alias("emb")).mapInPandas(run, "pos int, x double").groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").toPandas()["x"].to_numpy()
    d = int((np.sqrt(4 * (len(parts) - 1) + 1) - 1) / 2)
    return int(parts[0]) if len(parts) else 0, parts[1 : d + 1], parts[d + 1 :].reshape(d, d)


def mapped(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], column: str = "emb") -> DataFrame:
    """df with the vectors of a column replaced by f of a batch of them, a matrix; a null vector stays. What f holds goes to all tasks: the size of a model."""
    others = [F.col(c) if c != column else vec.as_double(F.col(c)).alias(c) for c in df.columns]
    rows = df.select(*others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            known = batch.column(i).is_valid().to_numpy(zero_copy_only=False)
            n = int(known.sum())
            if n:
                x = batch.column(i).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                out = np.ascontiguousarray(f(x), dtype=float)
                starts = np.append(np.cumsum(known) - known, n) * out.shape[1]
                offsets = pa.array(starts.astype(np.int32), mask=np.append(~known, False))
                batch = batch.set_column(i, column, pa.ListArray.from_arrays(offsets, pa.array(out.ravel())))
            yield batch

    return rows.mapInArrow(run, rows.schema)


@dataclass
class ClassStats:
    """total: within plus between scatter; for each class size, the number of classes, the sum and the scatter of their means."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    by_size: dict[int, tuple[int, np.ndarray, np.ndarray]]

    @property
    def within(self) -> np.ndarray:
        """The scatter around the class means, summed over classes."""
        return self.scatter - sum(size * ss for size, (_, _, ss) in self.by_size.items())


def class_stats(df: DataFrame, label: str = "spk", emb: str = "emb") -> ClassStats:
    """One job for the means of all class sizes: each task adds up its own, by size; there are at most sqrt(2 n) sizes."""
    labelled = df.where(F.col(label).isNotNull())
    n, total, _ = moments(df, emb)
    mean = total / n  # over all vectors, labelled or not
    centred = labelled.select(label, vec.minus(F.col(emb), vec.lit_vector(mean)).alias("emb"))
    _, _, scatter = moments(centred, "emb")
    sizes = centred.groupBy(label).agg(F.count(F.lit(1)).cast("int").alias("n"))
    means = scoring.mean_vector(centred, "emb", label).join(sizes, label).select("n", "mean")
    d = len(mean)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for size, part in pdf.groupby("n"):
                x = np.stack(part["mean"].to_numpy()).astype(float)
                k, s, ss = sums.get(size, (0, 0.0, 0.0))
                sums[size] = (k + len(x), s + x.sum(0), ss + x.T @ x)
        salt = TaskContext.get().partitionId() % 256
        for size, (k, s, ss) in sums.items():
            whole = np.concatenate([[k], s, np.ravel(ss)])
            for part in range(0, len(whole), PIECE):
                yield pd.DataFrame([(size, part, salt, whole[part : part + PIECE].tobytes())], columns=["n", "part", "salt", "sums"])

    def total_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1).assign(sums=[sum(np.frombuffer(x) for x in pdf["sums"]).tobytes()])

    schema = "n int, part int, salt int, sums binary"
    parts = means.mapInPandas(add_up, schema)
    for group in (("n", "part", "salt"), ("n", "part")):  # pieces of the sums of some tasks, then of all: no task holds those of all tasks
        parts = parts.groupBy(*group).applyInPandas(total_of, schema)
    pieces: dict[int, dict[int, bytes]] = {}
    for row in parts.toLocalIterator():
        pieces.setdefault(row.n, {})[row.part] = bytes(row.sums)
    by_size = {}
    for size, found in pieces.items():
        v = np.frombuffer(b"".join(found[p] for p in sorted(found)))
        by_size[size] = (int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return ClassStats(n, mean, scatter, by_size)


def floored_eigh(m: np.ndarray, ratio: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(0.5 * (m + m.T))
    return np.maximum(values, max(values.max(), 1e-300) * ratio), vectors


def fit_lda(stats: ClassStats, dim: int) -> np.ndarray:
    """A D x dim projection: whitened within-class, then the leading between-class directions. Classes of one vector don't count."""
    d = len(stats.mean)
    used = {n: v for n, v in stats.by_size.items() if n > 1}
    count = sum(n * k for n, (k, _, _) in used.items())
    ones = sum(n * ss for n, (_, _, ss) in stats.by_size.items() if n == 1) if 1 in stats.by_size else np.zeros((d, d))
    within = (stats.scatter - ones - sum(n * ss for n, (_, _, ss) in used.items())) / count
    mean = sum(n * s for n, (_, s, _) in used.items()) / count
    between = sum(n * ss for n, (_, _, ss) in used.items()) / count - np.outer(mean, mean)
    return _lda(within, between, dim)


def _lda(within: np.ndarray, between: np.ndarray, dim: int) -> np.ndarray:
    values, vectors = floored_eigh(within)
    white = vectors / np.sqrt(values)
    _, turn = np.linalg.eigh(white.T @ between @ white)
    return white @ turn[:, ::-1][:, :dim]


@dataclass
class Plda:
    mean: np.ndarray
    transform: np.ndarray
    psi: np.ndarray
    normalise_length: bool = True

    @property
    def offset(self) -> np.ndarray:
        return -self.transform @ self.mean

    def transformed(self, v: Column, n: int = 1) -> Column:
        """The vector in the space where within-class variance is one; with length normalisation, scaled to its expected norm."""
        out = vec.plus(vec.project(v, self.transform.tolist()), vec.lit_vector(self.offset))
        if not self.normalise_length:
            return out
        weights = vec.lit_vector(1 / (self.psi + 1 / n))
        square = F.aggregate(F.zip_with(out, weights, lambda x, w: x * x * w), F.lit(0.0), lambda s, x: s + x)
        return vec.times(out, F.sqrt(F.lit(float(len(self.psi))) / square))

    def transformed_rows(self, x: np.ndarray) -> np.ndarray:
        """As :meth:`transformed`, for the rows of a matrix."""
        out = x @ self.transform.T + self.offset
        return out * np.sqrt(len(self.psi) / (out * out / (self.psi + 1)).sum(1, keepdims=True)) if self.normalise_length else out

    def to_row(self, spark) -> DataFrame:
        """The model as a table of one row."""
        row = (self.mean.tolist(), self.transform.tolist(), self.psi.tolist(), self.normalise_length)
        return spark.createDataFrame([row], "mean array<double>, transform array<array<double>>, psi array<double>, normalise_length boolean")

    @staticmethod
    def from_row(df: DataFrame) -> Plda:
        r = df.first()
        return Plda(np.array(r.mean), np.array(r.transform), np.array(r.psi), r.normalise_length)


def fit_plda(stats: ClassStats, rounds: int = 10) -> Plda:
    """Expectation and maximisation of the two covariances; a round costs one inversion for each class size."""
    d = len(stats.mean)
    within, between = np.eye(d), np.eye(d)
    classes = sum(k for k, _, _ in stats.by_size.values())
    inner = stats.within
    for _ in range(rounds):
        inv_w, inv_b = np.linalg.inv(within), np.linalg.inv(between)
        sum_w, sum_b = inner.copy(), np.zeros((d, d))
        for n, (k, _, ss) in stats.by_size.items():
            posterior = np.linalg.inv(inv_b + n * inv_w)
            gain = n * posterior @ inv_w
            sum_b += k * posterior + gain @ ss @ gain.T
            rest = np.eye(d) - gain
            sum_w += n * (k * posterior + rest @ ss @ rest.T)
        within, between = sum_w / sum(n * k for n, (k, _, _) in stats.by_size.items()), sum_b / classes
    return _diagonal(stats.mean, within, between)


def _diagonal(mean: np.ndarray, within: np.ndarray, between: np.ndarray) -> Plda:
    values, vectors = floored_eigh(within, 1e-12)
    white = (vectors / np.sqrt(values)).T
    psi, turn = np.linalg.eigh(white @ between @ white.T)
    return Plda(mean, turn[:, ::-1].T @ white, np.maximum(psi[::-1], 0.0))


def adapt_plda(plda: Plda, df: DataFrame, emb: str = "emb", between_scale: float = 0.5, within_scale: float = 0.5) -> Plda:
    """Where unlabelled vectors vary more than the model says, the excess is shared out to both covariances. Flags are kept."""
    n, total, square = moments(df, emb)
    mean = total / n
    covariance = (square - n * np.outer(mean, mean)) / (n - 1)
    inverse = np.linalg.inv(plda.transform)
    within = inverse @ inverse.T
    between = inverse @ np.diag(plda.psi) @ inverse.T
    root = np.linalg.cholesky(within + between)
    inv_root = np.linalg.inv(root)
    values, vectors = np.linalg.eigh(inv_root @ covariance @ inv_root.T)
    back = root @ vectors
    excess = back @ np.diag(np.maximum(values - 1, 0)) @ back.T
    out = _diagonal(mean, within + within_scale * excess, between + between_scale * excess)
    out.normalise_length = plda.normalise_length
    return out


def plda_scores(plda: Plda, trials: DataFrame, enroll: DataFrame, test: DataFrame, multisession: bool = True) -> DataFrame:
    """Log-likelihood ratios of trials; enroll ``(utt, emb, n)`` holds means over n utterances (n counts as 1 unless multisession)."""
    e = mapped(enroll.select(F.col("utt").alias("enroll"), F.col("emb").alias("e"), (F.col("n") if multisession else F.lit(1)).alias("n")), plda.transformed_rows, "e")
    t = mapped(test.select(F.col("utt").alias("test"), F.col("emb").alias("t")), plda.transformed_rows, "t")
    return trials.join(e, "enroll").join(t, "test").withColumn("score", scoring.plda_llr(F.col("e"), F.col("t"), plda.psi.tolist(), F.col("n"))).drop("e", "t", "n")


@dataclass
class Link:
    method: str
    options: dict[str, str]
    values: dict[str, list] = field(default_factory=dict)


def parse_chain(text: str) -> list[Link]:
    """Links of ``"mean-subtract --scp x | length-norm | lda --dim=64"``."""
    links = []
    for part in text.split("|"):
        words = shlex.split(part)
        if words:
            spread = [x for w in words[1:] for x in (w.split("=", 1) if w.startswith("--") else [w])]
            options = {spread[i].lstrip("-"): spread[i + 1] for i in range(0, len(spread) - 1, 2)}
            links.append(Link(words[0], options))
    return links


def fit_link(link: Link, rows: DataFrame, label: str = "spk") -> Link:
    """The link with values fitted on rows ``(label, emb)``."""
    if link.method == "mean-subtract":
        n, total, _ = moments(rows)
        link.values["mean"] = (total / n).tolist()
    elif link.method == "whitening":
        n, total, square = moments(rows)
        values, vectors = floored_eigh(square / n - np.outer(total / n, total / n))
        link.values |= {"mean": (total / n).tolist(), "columns": (vectors / np.sqrt(values)).T.tolist()}
    elif link.method == "lda":
        stats = class_stats(rows, label)
        link.values |= {"mean": stats.mean.tolist(), "columns": fit_lda(stats, int(link.options["dim"])).T.tolist()}
    elif link.method != "length-norm":
        raise ValueError(f"no link is called {link.method}")
    return link


def through(links: list[Link], df: DataFrame, label: str = "spk", emb: str = "emb") -> DataFrame:
    """``(label, emb)`` of df behind the links."""
    return chained(df.select(label, F.col(emb).alias("emb")), links)


def fit_chain(text: str, df: DataFrame, label: str = "spk", emb: str = "emb") -> list[Link]:
    """Each link is fitted on vectors that went through the links before it."""
    links = parse_chain(text)
    for i, link in enumerate(links):
        fit_link(link, through(links[:i], df, label, emb), label)
    return links


def apply_link(link: Link, v: Column) -> Column:
    if link.method == "length-norm":
        return vec.length_norm(v)
    v = vec.minus(v, vec.lit_vector(link.values["mean"]))
    return vec.project(v, link.values["columns"]) if "columns" in link.values else v


def apply_chain(links: list[Link], v: Column) -> Column:
    for link in links:
        v = apply_link(link, v)
    return v


def chained(df: DataFrame, links: list[Link], column: str = "emb") -> DataFrame:
    """df with the vectors of a column behind the links, batch by batch; for matrices that are too large to be written as expressions."""

    def run(x: np.ndarray) -> np.ndarray:
        for link in links:
            if link.method == "length-norm":
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            else:
                x = x - np.asarray(link.values["mean"])
                x = x @ np.asarray(link.values["columns"]).T if "columns" in link.values else x
        return x

    return mapped(df, run, column) if links else df
