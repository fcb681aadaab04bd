"""Frames of sub-segments, cut from features that are computed once a recording.

Features are held as blocks ``(rec, block, feats)`` of consecutive frames, so that no row grows with a recording and a
sub-segment reads the blocks it touches, whichever recording it is from, by an equi-join on (rec, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .intervals import subsegments

#: Frames in a block.
BLOCK = 128


def blocks_of_rows(df: DataFrame, rec: str = "rec", frame: str = "frame", cells: str = "cells", size: int = BLOCK) -> DataFrame:
    """Blocks of single frames ``(rec, frame, cells)``, numbered from 0 without gaps in a recording; of frames given twice, one stays."""
    rows = df.select(F.col(rec).alias("rec"), F.col(frame).cast("long").alias("frame"), F.col(cells).cast("array<double>").alias("cells"))
    once = rows.where("rec IS NOT NULL AND frame >= 0 AND cells IS NOT NULL").groupBy("rec", "frame").agg(F.min("cells").alias("cells"))
    block = F.floor(F.col("frame") / size)
    return once.groupBy("rec", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "cells")))["cells"].alias("feats"))


def blocks_of_matrices(df: DataFrame, rec: str = "utt", feat: str = "feat", size: int = BLOCK) -> DataFrame:
    """Blocks of feature matrices ``(utt, feat)``; recordings must be unique."""
    n = F.size(feat)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    cut = F.transform(starts, lambda b: F.struct(b.cast("long").alias("block"), F.slice(F.col(feat).cast("array<array<double>>"), b * size + 1, size).alias("feats")))
    return df.where(n > 0).select(F.col(rec).alias("rec"), F.explode(cut).alias("b")).select("rec", "b.block", "b.feats")


def _touched(spans: DataFrame, blocks: DataFrame, begin: Column, end: Column, size: int) -> DataFrame:
    """spans with the part of each block between two frames: ``(block, part)``, one row for each block that has any."""
    named = spans.withColumns({"__begin": begin, "__end": end}).where("__end > __begin")
    spread = named.withColumn("block", F.explode(F.sequence(F.floor(F.col("__begin") / size), F.floor((F.col("__end") - 1) / size))))
    low = F.greatest(F.col("__begin") - F.col("block") * size, F.lit(0)).cast("int")
    high = F.least(F.col("__end") - F.col("block") * size, F.lit(size)).cast("int")
    return spread.join(blocks, ["rec", "block"]).withColumn("part", F.slice("feats", low + 1, high - low)).where(F.size("part") > 0).drop("feats", "__begin", "__end")


def segment_means(segments: DataFrame, blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(seg, mean)`` over the frames of each segment ``(seg, rec, first, n_frames)``, however long: sums by bin, added up before the shuffle."""
    parts = _touched(segments.select("seg", "rec", "first", "n_frames"), blocks, F.col("first"), F.col("first") + F.col("n_frames"), size)
    zero = F.transform(F.col("part")[0], lambda x: F.lit(0.0))
    added = F.aggregate("part", zero, lambda s, frame: F.zip_with(s, frame, lambda a, b: a + b))
    long = parts.select("seg", F.size("part").alias("n"), F.posexplode(added).alias("bin", "x"))
    means = long.groupBy("seg", "bin").agg((F.sum("x") / F.sum("n")).alias("m"))
    return means.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("bin", "m")))["m"].alias("mean"))


def filled(feat: Column, window: int) -> Column:
    """window frames: those of feat over and over, from its first one."""
    n = F.size(feat)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: F.get(feat, i % n)))


def column_means(feat: Column) -> Column:
    zero = F.transform(feat[0], lambda x: F.lit(0.0))
    return F.aggregate(feat, zero, lambda s, frame: F.zip_with(s, frame, lambda a, b: a + b), lambda s: F.transform(s, lambda x: x / F.size(feat)))


def piece_frames(segments: DataFrame, blocks: DataFrame, window: int = 150, period: int = 75, normalise: str | None = "piece", size: int = BLOCK) -> DataFrame:
    """``(seg, rec, begin, end, feat)``: the sub-segments of segments ``(seg, rec, first, n_frames)``, each of window frames.

    begin and end count from the start of the segment. Short pieces are filled by repetition. normalise: ``piece`` subtracts the
    mean of the filled piece, ``segment`` that of the whole segment before the cut, None nothing. A segment may say more frames
    than the recording has (features end some frames early): what is there is repeated; feat is null where nothing is.
    Of segments with the same id one stays; one without an id, a recording or frames is left out.
    """
    if normalise not in ("piece", "segment", None):
        raise ValueError("normalise is piece, segment or None")
    named = segments.select("seg", "rec", F.col("first").cast("long").alias("first"), F.col("n_frames").cast("long").alias("n_frames")).where("seg IS NOT NULL AND rec IS NOT NULL AND first >= 0 AND n_frames > 0")
    named = named.groupBy("seg").agg(F.min(F.struct("rec", "first", "n_frames")).alias("s")).select("seg", "s.*")
    pieces = subsegments(named.withColumnRenamed("first", "origin"), window, period).select("seg", "rec", "origin", F.col("first").alias("begin"), F.col("last").alias("end"))
    parts = _touched(pieces, blocks, F.col("origin") + F.col("begin"), F.col("origin") + F.col("end"), size)
    cut = parts.groupBy("seg", "begin").agg(F.flatten(F.array_sort(F.collect_list(F.struct("block", "part")))["part"]).alias("feat"))
    out = pieces.join(cut, ["seg", "begin"], "left").withColumn("feat", filled(F.col("feat"), window))
    less = lambda mean: F.transform("feat", lambda frame: F.zip_with(frame, mean, lambda x, m: x - m))
    if normalise == "segment":
        out = out.join(segment_means(named, blocks, size), "seg", "left").withColumn("feat", less(F.col("mean"))).drop("mean")
    elif normalise == "piece":
        out = out.withColumn("feat", vec.held(column_means(F.col("feat")), less))
    return out.select("seg", "rec", "begin", "end", "feat")


def piece_id(seg: str = "seg", begin: str = "begin", end: str = "end") -> Column:
    """``seg-00000075-00000225``."""
    return F.format_string("%s-%08d-%08d", F.col(seg).cast("string"), F.col(begin), F.col(end))
