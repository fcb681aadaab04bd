"""Trial scoring: means, cosine, cohort normalisation, calibration, identification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from . import products


def mean_vector(df: DataFrame, emb: str, *keys: str) -> DataFrame:
    """The mean of the vectors (of each key); sums are partial on the map side, by position."""
    long = df.select(*keys, F.posexplode(vec.as_double(F.col(emb))).alias("pos", "x"))
    means = long.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    listed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m"))
    return listed.select(*keys, F.transform("m", lambda e: e["x"]).alias("mean"))


def attach(trials: DataFrame, vectors: DataFrame, emb: str = "emb", on_missing: str = "error") -> DataFrame:
    """Trials ``(enroll, test)`` with both vectors, of ``(utt, emb)``. A trial without a vector fails the job, or (drop) goes, or (keep) has a null."""
    how = "inner" if on_missing == "drop" else "left"
    left = vectors.select(F.col("utt").alias("enroll"), F.col(emb).alias("enroll_emb"))
    right = vectors.select(F.col("utt").alias("test"), F.col(emb).alias("test_emb"))
    joined = trials.join(left, "enroll", how).join(right, "test", how)
    if on_missing in ("drop", "keep"):
        return joined
    for side in ("enroll", "test"):
        lacks = F.raise_error(F.concat(F.lit(f"no vector of {side} "), F.coalesce(F.col(side).cast("string"), F.lit("null"))))
        joined = joined.withColumn(f"{side}_emb", F.coalesce(f"{side}_emb", lacks.cast(joined.schema[f"{side}_emb"].dataType)))
    return joined


def cosine_scores(trials: DataFrame, vectors: DataFrame, mean: DataFrame | None = None, scale: str = "raw", on_missing: str = "error") -> DataFrame:
    """Trials with ``score``, after subtraction of the one mean if it is given; on_missing as in :func:`attach`."""
    if mean is not None:
        vectors = vectors.crossJoin(F.broadcast(mean)).select("utt", vec.minus(F.col("emb"), F.col("mean")).alias("emb"))  # one row
    joined = attach(trials, vectors.select("utt", vec.length_norm(F.col("emb")).alias("emb")), on_missing=on_missing)  # each vector is scaled once
    cosine = vec.dot(F.col("enroll_emb"), F.col("test_emb"))
    return joined.withColumn("score", (cosine + 1) / 2 if scale == "unit" else cosine).drop("enroll_emb", "test_emb")


def cohort_stats(vectors: DataFrame, cohort: DataFrame, top_n: int | None) -> DataFrame:
    """``(utt, mean, std)`` of the top_n largest cosines of each vector to the cohort ``(name, emb)`` (all of them for None).

    Products of blocks (:mod:`products`): a task hands on the best top_n of a vector in a block, or sums. Rows without a vector go;
    a repeated row of vectors stays, and so its trials would: vectors have one row a name.
    """
    left = products.slabs(vectors)
    if not top_n:
        return products.spread_of(left, cohort).withColumnRenamed("key", "utt")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    mean = total(F.col("best")) / F.size("best")
    best = products.largest(left, cohort, top_n).withColumn("mean", mean)
    dev = F.sqrt(total(F.transform("best", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / F.size("best"))
    return best.select(F.col("key").alias("utt"), "mean", dev.alias("std"))


def normalised(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """0.5 ((s - mean_e) / std_e + (s - mean_t) / std_t) as ``norm_score``."""
    e = stats.select(F.col("utt").alias("enroll"), F.col("mean").alias("enroll_mean"), F.col("std").alias("enroll_std"))
    t = stats.select(F.col("utt").alias("test"), F.col("mean").alias("test_mean"), F.col("std").alias("test_std"))
    s = F.col("score")
    formula = 0.5 * ((s - F.col("enroll_mean")) / F.col("enroll_std") + (s - F.col("test_mean")) / F.col("test_std"))
    return scores.join(e, "enroll").join(t, "test").withColumn("norm_score", formula)


def with_magnitudes(scores: DataFrame, vectors: DataFrame) -> DataFrame:
    """Scores with ``enroll_mag`` and ``test_mag``, the norms of the vectors ``(utt, emb)`` that were compared."""
    mags = vectors.select("utt", vec.norm(F.col("emb")).alias("mag"))
    for side in ("enroll", "test"):
        scores = scores.join(mags.select(F.col("utt").alias(side), F.col("mag").alias(f"{side}_mag")), side)
    return scores


def calibration_factors(scores: DataFrame, durations: DataFrame | None = None, most: float = 2.0) -> DataFrame:
    """Trials with the smaller and larger value, the difference and the ratio of larger to smaller, of what is known of both sides.

    scores come from :func:`normalised` and :func:`with_magnitudes`; durations is ``(utt, dur)``, cut at most (None: no such
    factors). Columns: ``dur_min, dur_max, dur_diff, dur_ratio``, the same of ``mag`` and of ``mean``, the cohort mean. The ratio
    to 0 is null.
    """
    out = scores
    if durations is not None:
        for side in ("enroll", "test"):
            out = out.join(durations.select(F.col("utt").alias(side), F.least(F.col("dur").cast("double"), F.lit(float(most))).alias(f"{side}_dur")), side)
    for name in (["dur"] if durations is not None else []) + ["mag", "mean"]:
        low, high, gap, _ = vec.min_max_diff_ratio(F.col(f"enroll_{name}"), F.col(f"test_{name}"))
        out = out.withColumns({f"{name}_min": low, f"{name}_max": high, f"{name}_diff": gap, f"{name}_ratio": F.when(low != 0, high / low)})
    return out


def identify(queries: DataFrame, models: DataFrame, least: float = 0.0) -> DataFrame:
    """``(utt, score, name)``: the model ``(name, emb)`` of the largest cosine above least for each query, ties to the smallest name; a query without one has no row."""
    return products.nearest(products.slabs(queries), models, least).withColumnRenamed("key", "utt")


def plda_llr(enroll: Column, test: Column, psi: list[float], n: int | Column = 1) -> Column:
    """Log-likelihood ratio of two transformed vectors, for an enrolment of n utterances."""
    fold = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    times = lambda values, v: F.zip_with(vec.lit_vector(values), v, lambda a, x: a * x)
    if isinstance(n, int):  # all but the two vectors is known
        gain, var, total = [n * a / (n * a + 1) for a in psi], [1 + a / (n * a + 1) for a in psi], [1 + a for a in psi]
        test = vec.as_double(test)
        square = F.zip_with(test, times(gain, vec.as_double(enroll)), lambda t, m: (t - m) * (t - m))
        known = sum(math.log(b) - math.log(a) for a, b in zip(var, total))
        return 0.5 * (known - fold(times([1 / v for v in var], square)) + fold(times([1 / v for v in total], F.transform(test, lambda t: t * t))))
    k = n.cast("double")
    p = vec.lit_vector(psi)
    mean = F.zip_with(p, vec.as_double(enroll), lambda a, e: k * a / (k * a + 1) * e)
    var = F.transform(p, lambda a: 1 + a / (k * a + 1))
    total = F.transform(p, lambda a: 1 + a)
    square = F.zip_with(vec.as_double(test), mean, lambda t, m: (t - m) * (t - m))
    given = -0.5 * (fold(F.transform(var, lambda v: F.log(v))) + fold(F.zip_with(square, var, lambda s, v: s / v)))
    alone = -0.5 * (fold(F.transform(total, lambda v: F.log(v))) + fold(F.zip_with(F.transform(vec.as_double(test), lambda t: t * t), total, lambda s, v: s / v)))
    return given - alone


def linear_calibration(df: DataFrame, weights: dict[str, float], bias: float, out: str = "calibrated") -> DataFrame:
    total = F.lit(float(bias))
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.col(name)
    return df.withColumn(out, total)


def train_calibration(df: DataFrame, features: list[str], label: str = "target") -> tuple[dict[str, float], float]:
    """Weights and bias of class-balanced logistic regression, run to convergence (the minimum of Cllr)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    per_class = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.when(F.col(label) == 1, 0.5 / per_class[1]).otherwise(0.5 / per_class[0]) * sum(per_class.values())
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("weight", weight).withColumn("label", F.col(label).cast("double")))
    fit = LogisticRegression(weightCol="weight", regParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(rows)
    return dict(zip(features, map(float, fit.coefficients))), float(fit.intercept)
