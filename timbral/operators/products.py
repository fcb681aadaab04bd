"""Cosines of many vectors to many others, as products of packed blocks; what leaves a task is a summary, never all pairs.

The vectors of one side are packed into slabs, scaled to norm 1 once and written; those of the other side, which have names, into
blocks. An equi-join on the number of the block brings each slab to each block. Summaries of a vector merge over blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..scratch import pinned

#: Rows of a slab, names of a block, slabs that meet a block under one key of the join, and blocks that merge at once.
SLAB, BLOCK, TOGETHER, MERGED = 512, 2048, 256, 16


def unit_rows(rows) -> np.ndarray:
    """A matrix of the rows at norm 1; a row of zeros has no direction and becomes NaN, as in a division by its norm."""
    x = np.stack(rows).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def slabs(df: DataFrame, key: str = "utt", emb: str = "emb", size: int = SLAB) -> DataFrame:
    """``(slab, key, x)``: up to size rows of a partition in one, written, so that a slab holds the same rows whoever reads it. Rows without a vector go."""
    rows = df.select(F.col(key).alias("key"), vec.as_double(F.col(emb)).alias("x")).where("x IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                yield pd.DataFrame({"slab": [number], "key": [part["key"].tolist()], "x": [unit_rows(part["x"]).tobytes()]})
                number += 1

    return pinned(rows.mapInPandas(run, f"slab long, key array<{kind}>, x binary"))


def met(left: DataFrame, names: DataFrame, summary: Callable[[np.ndarray, np.ndarray, list], dict], schema: str, name: str = "name", emb: str = "emb", block: int = BLOCK) -> tuple[DataFrame, int]:
    """``(slab, at, key, block, ...)`` and the number of blocks: summary(rows, vectors of the block, its names) gives a column of values
    for each field of schema, a value a row. left comes from :func:`slabs`; names are in their order, each row counts, but those without a vector or with zeros only."""
    known = pinned(names.select(F.col(name).alias("name"), vec.as_double(F.col(emb)).alias("emb")).where(vec.norm(F.col("emb")) > 0))
    n_blocks = max(1, math.ceil(known.count() / block))
    salts = max(1, math.ceil(left.count() / TOGETHER))
    number = F.pmod(F.xxhash64("name", "emb"), F.lit(n_blocks)).cast("int")
    packed = known.groupBy(number.alias("block")).agg(F.sort_array(F.collect_list(F.struct("name", "emb"))).alias("rows"))
    packed = packed.select("block", F.col("rows.name").alias("names"), F.col("rows.emb").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spread = left.withColumn("salt", F.pmod(F.xxhash64("slab"), F.lit(salts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    kind = left.schema["key"].dataType.elementType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.frombuffer(row.x).reshape(len(row.key), -1)
                made = summary(x, unit_rows(row.w), list(row.names))
                yield pd.DataFrame({"slab": row.slab, "at": np.arange(len(x)), "key": list(row.key), "block": row.block, **made})

    joined = spread.join(packed, ["block", "salt"]).select("slab", "key", "x", "block", "names", "w")
    return joined.mapInPandas(run, f"slab long, at int, key {kind}, block int, {schema}"), n_blocks


def largest(left: DataFrame, names: DataFrame, n: int, **columns) -> DataFrame:
    """``(key, best)`` of each row of left: its n largest cosines, downwards. Blocks merge a few at a time, so that no row holds more than some of their lists."""

    def summary(x: np.ndarray, w: np.ndarray, _: list) -> dict:
        cos = x @ w.T
        if cos.shape[1] > n:
            cos = -np.partition(-cos, n - 1, axis=1)[:, :n]
        return {"best": list(cos)}

    parts, n_blocks = met(left, names, summary, "best array<double>", **columns)
    while True:
        merged = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("best")))), 1, n)
        parts = parts.groupBy("slab", "at", F.floor(F.col("block") / MERGED).cast("int").alias("block")).agg(F.first("key").alias("key"), merged.alias("best"))
        n_blocks = math.ceil(n_blocks / MERGED)
        if n_blocks == 1:
            return parts.select("key", "best")


def spread_of(left: DataFrame, names: DataFrame, **columns) -> DataFrame:
    """``(key, mean, std)`` of all cosines of each row of left; blocks hand on their count, mean and squared deviations."""

    def summary(x: np.ndarray, w: np.ndarray, _: list) -> dict:
        cos = x @ w.T
        return {"n": cos.shape[1], "mean": cos.mean(1), "dev": ((cos - cos.mean(1, keepdims=True)) ** 2).sum(1)}

    parts, _ = met(left, names, summary, "n long, mean double, dev double", **columns)
    sums = parts.groupBy("slab", "at").agg(F.first("key").alias("key"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("dev") + F.col("n") * F.col("mean") * F.col("mean")).alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select("key", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def nearest(left: DataFrame, names: DataFrame, least: float = 0.0, **columns) -> DataFrame:
    """``(key, score, name)``: the name of the largest cosine above least, ties to the smallest name; rows without one go.

    Cosines near the best are taken anew by a sum that depends on the two vectors only, so that equal vectors tie wherever they are.
    """
    kind = names.schema[columns.get("name", "name")].dataType.simpleString()

    def summary(x: np.ndarray, w: np.ndarray, known: list) -> dict:
        cos = x @ w.T
        score, found = np.full(len(x), np.nan), [None] * len(x)
        top = np.where(np.isnan(cos), -np.inf, cos).max(1)
        for i in np.flatnonzero(top > least - 1e-9):
            near = np.flatnonzero(cos[i] >= top[i] - 1e-9)
            exact = (w[near] * x[i]).sum(1)
            j = int(exact.argmax())  # names come sorted: the first of equal ones
            if exact[j] > least:
                score[i], found[i] = exact[j], known[near[j]]
        return {"score": score, "name": found}

    parts, _ = met(left, names, summary, f"score double, name {kind}", **columns)
    hits = parts.where(~F.isnan("score") & F.col("score").isNotNull())
    best = hits.groupBy("slab", "at").agg(F.first("key").alias("key"), F.max("score").alias("score"), F.min_by("name", F.struct((-F.col("score")).alias("s"), "name")).alias("name"))
    return best.select("key", "score", "name")
