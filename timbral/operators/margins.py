"""Logits and losses over all classes, where classes have several centres and the hardest of the others are pushed further.

Nothing of the size rows x classes is kept. Samples are packed into slabs and classes into blocks; a task multiplies a slab by
a block, takes the maximum over the centres of a class, and hands on for each sample its own cosine, the sum of a term over
the other classes, and the hardest few of them. Blocks merge by sums and another choice of the hardest few.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..scratch import pinned

#: Rows of a slab, classes of a block, and slabs that meet a block under one key of the join.
SLAB, BLOCK, TOGETHER = 512, 1024, 256


def _unit(rows) -> np.ndarray:
    x = np.stack(rows).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _slabs(samples: DataFrame, key: str, cls: str, emb: str, slab: int) -> DataFrame:
    """``(slab, at, key, cls, x)``: up to slab rows of a partition packed into one, vectors scaled to norm 1."""
    rows = samples.select(F.col(key).alias("key"), F.col(cls).cast("long").alias("cls"), vec.as_double(F.col(emb)).alias("x")).where("x IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for i in range(0, len(pdf), slab):
                part = pdf.iloc[i : i + slab]
                labels = [None if pd.isna(c) else int(c) for c in part["cls"]]
                yield pd.DataFrame({"slab": [number], "key": [part["key"].tolist()], "cls": [labels], "x": [_unit(part["x"]).tobytes()]})
                number += 1

    return rows.mapInPandas(run, f"slab long, key array<{kind}>, cls array<long>, x binary")


def over_classes(samples: DataFrame, centres: DataFrame, term: Callable[[np.ndarray], np.ndarray], top: int, key: str = "utt", cls: str = "cls", emb: str = "emb", slab: int = SLAB, block: int = BLOCK) -> DataFrame:
    """``(key, cls, own, others, n_classes, hard)`` of each row of samples.

    samples ``(key, cls, emb)``, centres ``(cls, emb)`` with any number of rows a class (a class counts with its best centre).
    own: the cosine to the row's class, null where that has no centre. others: the sum of term(cosine) over all other classes.
    hard: ``(cos, cls)`` of the top other classes by cosine, ties to the smaller class. Samples and centres without a vector,
    and centres without a class, are left out; repeated rows stay. A block holds some 1,024 classes whatever their number;
    the rows of a class are taken to fit one task, as centres are parameters of a model.
    """
    known = centres.where(F.col(cls).isNotNull() & F.col(emb).isNotNull()).select(F.col(cls).cast("long").alias("c"), vec.as_double(F.col(emb)).alias("emb"))
    n_blocks = max(1, math.ceil(known.select("c").distinct().count() / block))
    slabs = pinned(_slabs(samples, key, cls, emb, slab))  # a task that runs again must find the same rows in a slab
    salts = max(1, math.ceil(slabs.count() / TOGETHER))
    packed = known.groupBy(F.pmod(F.xxhash64("c"), F.lit(n_blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("c", "emb"))).alias("rows"))
    packed = packed.select("block", F.col("rows.c").alias("c"), F.col("rows.emb").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    kind = slabs.schema["key"].dataType.elementType.simpleString()
    met = slabs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).withColumn("salt", F.pmod(F.xxhash64("slab"), F.lit(salts)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                labels = np.array([-1 if c is None or pd.isna(c) else int(c) for c in row.cls], dtype=np.int64)
                none = np.array([c is None or pd.isna(c) for c in row.cls])
                classes, first = np.unique(np.asarray(row.c, dtype=np.int64), return_index=True)  # rows come sorted by class
                x = np.frombuffer(row.x).reshape(len(labels), -1)
                cos = np.maximum.reduceat(x @ _unit(row.w).T, first, axis=1).clip(-1, 1)
                mine = (labels[:, None] == classes) & ~none[:, None]
                own = np.where(mine.any(1), np.where(mine, cos, -2).max(1), np.nan)
                others = np.where(mine, 0.0, term(cos)).sum(1)
                left = np.where(mine, -2.0, cos)
                best = np.argsort(-left, axis=1, kind="stable")[:, :top]
                hard = [[{"cos": float(left[i, j]), "cls": int(classes[j])} for j in best[i] if left[i, j] >= -1] for i in range(len(labels))]
                yield pd.DataFrame({"slab": row.slab, "at": np.arange(len(labels)), "key": list(row.key), "cls": [None if n else int(c) for n, c in zip(none, labels)], "own": own, "others": others, "n": len(classes), "hard": hard})

    schema = f"slab long, at int, key {kind}, cls long, own double, others double, n long, hard array<struct<cos:double,cls:bigint>>"
    parts = met.join(packed, ["block", "salt"]).select("slab", "key", "cls", "x", "c", "w").mapInPandas(run, schema)
    ranked = F.array_sort(F.flatten(F.collect_list("hard")), lambda a, b: F.when(a["cos"] != b["cos"], F.when(a["cos"] > b["cos"], -1).otherwise(1)).otherwise(F.when(a["cls"] < b["cls"], -1).otherwise(1)))
    real = F.when(~F.isnan("own"), F.col("own"))
    merged = parts.groupBy("slab", "at").agg(F.first("key").alias(key), F.first("cls").alias(cls), F.max(real).alias("own"), F.sum("others").alias("others"), F.sum("n").alias("n_classes"), ranked.alias("hard"))
    return merged.withColumn("hard", F.slice("hard", 1, top) if top else F.slice("hard", 1, 0)).drop("slab", "at")


def _raised(cos: Column, margin: float, easy: bool = False) -> Column:
    """The cosine of the angle plus the margin; past the point where that would turn back, a straight line that meets it."""
    sine = F.sqrt(F.greatest(1 - cos * cos, F.lit(0.0)))
    moved = cos * math.cos(margin) - sine * math.sin(margin)
    turn = math.cos(math.pi - margin)
    return F.when(cos > 0, moved).otherwise(cos) if easy else F.when(cos > turn, moved).otherwise(cos - (1 + turn))


def _lowered(cos: Column, margin: float) -> Column:
    return cos * math.cos(margin) + F.sqrt(F.greatest(1 - cos * cos, F.lit(0.0))) * math.sin(margin)


def hardest_margin(samples: DataFrame, centres: DataFrame, margin: float = 0.2, scale: float = 32.0, hard_margin: float = 0.06, top: int = 5, easy: bool = False, **names) -> DataFrame:
    """Sub-centre logits with a margin on the own class and another, towards the row, on the top hardest others.

    ``(key, cls, own, own_logit, hard, n_classes, loss)``: hard holds ``(cls, cos, logit)``, and the loss is the negative log
    probability of the own class under all logits (null where it has no centre). hard_margin grows with the margin (it is meant
    for 0.2); a logit of any other class is scale times its cosine. top = 0: plain additive angular margin.
    """
    low = hard_margin * margin / 0.2 if margin > 0.001 else 0.0
    out = over_classes(samples, centres, lambda c: np.exp(scale * (c - 1)), top, **names)
    weight = lambda c: F.exp(scale * (c - 1))
    own = _raised(F.col("own"), margin, easy)
    added = F.aggregate("hard", F.lit(0.0), lambda s, h: s + weight(_lowered(h["cos"], low)) - weight(h["cos"]))
    total = F.greatest(F.col("others") + added, F.lit(0.0)) + weight(own)
    hard = F.transform("hard", lambda h: F.struct(h["cls"].alias("cls"), h["cos"].alias("cos"), (scale * _lowered(h["cos"], low)).alias("logit")))
    return out.withColumns({"own_logit": scale * own, "loss": F.log(total) - scale * (own - 1), "hard": hard}).drop("others")


def pairwise_binary(samples: DataFrame, centres: DataFrame, margin: float = 0.2, scale: float = 32.0, share: float = 0.7, power: int = 3, bias: float = 0.0, kind: str = "cosine", **names) -> DataFrame:
    """``(key, cls, own, own_logit, n_classes, loss)`` of binary logistic losses, one for each class, with weight share for the own one.

    Cosines c become g(c) = 2 ((c + 1) / 2)^power - 1. kind cosine: the margin is taken from g of the own class and added to g
    of the others; kind angle: it moves the angle before g. bias is a parameter of the model. own_logit: scale (own - margin).
    """
    g = lambda c: 2 * ((c + 1) / 2) ** power - 1
    if kind == "angle":
        moved = lambda c: c * math.cos(margin) + np.sqrt(np.maximum(1 - c * c, 0.0)) * math.sin(margin)
        term = lambda c: (1 - share) * np.logaddexp(0, scale * g(moved(c)) + bias)
        held = _raised(F.col("own"), margin)
        positive = scale * (2 * F.pow((held + 1) / 2, F.lit(float(power))) - 1) + bias
    else:
        term = lambda c: (1 - share) * np.logaddexp(0, scale * (g(c) + margin) + bias)
        positive = scale * (2 * F.pow((F.col("own") + 1) / 2, F.lit(float(power))) - 1 - margin) + bias
    out = over_classes(samples, centres, term, 0, **names)
    softplus = F.greatest(-positive, F.lit(0.0)) + F.log1p(F.exp(-F.abs(positive)))
    return out.withColumns({"own_logit": scale * (F.col("own") - margin), "loss": share * softplus + F.col("others")}).drop("others", "hard")


def multiplied_angle(cos: Column, is_class: Column, norm: Column, margin: int = 2, step: int = 1, base: float = 1000.0, gamma: float = 0.12, power: float = 1.0, least: float = 5.0) -> Column:
    """Logits of a margin that multiplies the angle (1 to 5), weighed against the plain cosine by 1 / (1 + lambda), which falls with the step, times the vector's norm."""
    if not 1 <= margin <= 5:
        raise ValueError("the margin is a whole number from 1 to 5")
    c = F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))
    before, now = F.lit(1.0), c  # cos 0, cos theta; then cos (n + 1) theta = 2 cos theta cos n theta - cos (n - 1) theta
    for _ in range(margin - 1):
        before, now = now, 2 * c * now - before
    k = F.floor(margin * F.acos(c) / math.pi)
    falling = F.when(k % 2 == 0, now).otherwise(-now) - 2 * k
    weight = 1 / (1 + max(least, base * (1 + gamma * step) ** -power))
    return norm * (F.when(is_class, (falling - c) * weight).otherwise(0.0) + c)
