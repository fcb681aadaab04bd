"""Verification metrics: operating points, equal error rate, detection cost, Cllr, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def det_curve(trials: DataFrame, score: str = "score", target: str = "target", ties: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Each trial in order of its score with ``i`` (from 0), ``fnr`` and ``fpr`` at the threshold behind it.

    Rows are dealt into slices of the score by approximate quantiles; running sums are
    taken inside a slice and raised by the totals of the slices before, so that no task
    sorts all trials. Equal scores are ordered by target, then by the tie columns.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = trials.withColumn("__t", F.when(F.col(target) == 1, w).otherwise(0.0)).withColumn("__n", F.when(F.col(target) == 1, 0.0).otherwise(w))
    bounds = trials.approxQuantile(score, [i / SLICES for i in range(1, SLICES)], 0.005)
    cuts = F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    rows = rows.withColumn("__slice", F.size(F.filter(cuts, lambda b: b < F.col(score))))
    totals = rows.groupBy("__slice").agg(F.sum("__t").alias("t"), F.sum("__n").alias("n"), F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    offsets = totals.select("__slice", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"__{x}0") for x in "tnc"))
    whole = totals.agg(F.sum("t").alias("__ta"), F.sum("n").alias("__na"))
    inside = Window.partitionBy("__slice").orderBy(score, target, *ties).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(F.broadcast(offsets), "__slice").crossJoin(F.broadcast(whole))  # SLICES rows and one row
    run = run.withColumn("i", F.col("__c0") + F.count(F.lit(1)).over(inside) - 1)
    run = run.withColumn("fnr", (F.col("__t0") + F.sum("__t").over(inside)) / F.col("__ta")).withColumn("fpr", 1 - (F.col("__n0") + F.sum("__n").over(inside)) / F.col("__na"))
    return run.drop(*(c for c in run.columns if c.startswith("__")))


def equal_error_rate(curve: DataFrame, score: str = "score") -> DataFrame:
    """One row ``(eer, threshold)``: linear interpolation where fnr - fpr changes its sign."""
    gap = F.col("fnr") - F.col("fpr")
    point = F.struct("i", "fnr", "fpr", F.col(score).alias("score"))
    ends = curve.agg(F.min(F.when(gap >= 0, point)).alias("x"), F.max(F.when(gap < 0, point)).alias("y"))
    a = (F.col("x.fnr") - F.col("x.fpr")) / ((F.col("x.fnr") - F.col("x.fpr")) - (F.col("y.fnr") - F.col("y.fpr")))
    return ends.select((F.col("x.fnr") + a * (F.col("y.fnr") - F.col("x.fnr"))).alias("eer"), F.col("x.score").alias("threshold"))


def min_cost(curve: DataFrame, p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0, normalised: bool = True) -> DataFrame:
    cost = F.min(c_miss * F.col("fnr") * p_target + c_fa * F.col("fpr") * (1 - p_target))
    return curve.agg((cost / min(c_miss * p_target, c_fa * (1 - p_target)) if normalised else cost).alias("min_dcf"))


def primary_cost(curve: DataFrame) -> DataFrame:
    """The mean of the normalised minimal costs at target rates of 0.01 and 0.005."""
    parts = [F.min(F.col("fnr") * p + F.col("fpr") * (1 - p)) / min(p, 1 - p) for p in (0.01, 0.005)]
    return curve.agg(((parts[0] + parts[1]) / 2).alias("c_primary"))


def cllr(trials: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    s = F.col(score)
    own = F.avg(F.when(F.col(target) == 1, F.log1p(F.exp(-s))))
    other = F.avg(F.when(F.col(target) == 0, F.log1p(F.exp(s))))
    return trials.agg((0.5 * (own + other) / F.log(F.lit(2.0))).alias("cllr"))


def equalised_weights(trials: DataFrame, partition: str, target: str = "target") -> DataFrame:
    """For each partition the weights that make its targets and nontargets count as those of the largest one."""
    counts = trials.groupBy(partition).agg(F.count_if(F.col(target) == 1).alias("n_target"), F.count_if(F.col(target) == 0).alias("n_other"))
    every = Window.partitionBy(F.lit(0))  # one row a partition
    weight = lambda c: F.when(F.col(c) > 0, F.max(c).over(every) / F.col(c)).otherwise(0.0)
    return counts.select(partition, "n_target", "n_other", weight("n_target").alias("target_weight"), weight("n_other").alias("other_weight"))


def histogram_cdf(trials: DataFrame, low: float, high: float, bins: int, score: str = "score", target: str = "target") -> DataFrame:
    """``(bin, p_miss, p_fa)`` at the upper edge of each bin of equal width; scores beyond the ends count in the end bins."""
    place = F.least(F.greatest(F.floor((F.col(score) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    counts = trials.groupBy(place.cast("long").alias("bin")).agg(F.count_if(F.col(target) == 1).alias("t"), F.count_if(F.col(target) == 0).alias("n"))
    filled = trials.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").fillna(0)
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    every = Window.partitionBy(F.lit(0))
    return filled.select("bin", (F.sum("t").over(run) / F.sum("t").over(every)).alias("p_miss"), (1 - F.sum("n").over(run) / F.sum("n").over(every)).alias("p_fa"))


def probit(p: Column) -> Column:
    """Inverse of the normal distribution (a rational approximation, error below 4.5e-4), for the axes of DET plots."""
    q = F.when(p < 0.5, p).otherwise(1 - p)
    t = F.sqrt(-2 * F.log(F.greatest(q, F.lit(1e-12))))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -x).otherwise(x)
