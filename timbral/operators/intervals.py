"""Intervals and turns: merging, sub-segments, chunks, error of a diarization."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import pinned

def merge_overlaps(df: DataFrame, key: str = "utt", least: float = 0.0) -> DataFrame:
    """Unions of overlapping ``(key, begin, end)``, those of at least the given length."""
    w = Window.partitionBy(key).orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = df.withColumn("fresh", F.when(F.col("begin") <= reach, 0).otherwise(1))
    islands = fresh.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).where(F.col("end") - F.col("begin") >= least).drop("island")


def merge_turns(df: DataFrame, key: str = "utt", order: tuple[str, ...] = ()) -> DataFrame:
    """Turns of labelled pieces ``(key, begin, end, label)`` in order: a turn ends at a gap or another label; overlapping turns meet halfway."""
    w = Window.partitionBy(key).orderBy("begin", "end", "label", *order)
    last_end, last_label = F.lag("end").over(w), F.lag("label").over(w)
    next_begin, next_label = F.lead("begin").over(w), F.lead("label").over(w)
    first = last_end.isNull() | (F.col("begin") > last_end) | (F.col("label") != last_label)
    starts = F.when(last_end.isNull() | (F.col("begin") > last_end), F.col("begin")).otherwise((F.col("begin") + last_end) / 2)
    ends = F.when((next_begin <= F.col("end")) & (next_label != F.col("label")), (next_begin + F.col("end")) / 2).otherwise(F.col("end"))
    marked = df.select("*", F.when(first, 1).otherwise(0).alias("first"), starts.alias("own_begin"), ends.alias("own_end"))
    turns = marked.withColumn("turn", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("begin", "end", *order)
    return turns.groupBy(key, "turn").agg(F.min_by("own_begin", at).alias("turn_begin"), F.max_by("own_end", at).alias("turn_end"), F.min("label").alias("label"))


def subsegments(df: DataFrame, window: int, period: int, length: str = "n_frames") -> DataFrame:
    """Pieces ``[first, last)`` of window frames every period frames; a shorter row is one piece, the last piece ends with the row."""
    n = F.col(length)
    starts = F.when(n <= window, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n - window + period - 1, F.lit(period).cast("long")))
    return df.select("*", F.explode(starts).alias("first")).withColumn("last", F.least(F.col("first") + window, n))


def frame_chunks(v: Column, size: int) -> Column:
    """Chunks of equal size of an array of numbers, the last padded with zeros."""
    padded = F.concat(v, F.array_repeat(F.lit(0.0), F.pmod(-F.size(v), F.lit(size))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(padded) - 1) / size).cast("int")), lambda i: F.slice(padded, i * size + 1, size))


def raw_speech(p: np.ndarray, threshold: float = 0.5, frame: float = 0.096, least_silence: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First frames, end frames and whether a silence closed them, of the stretches of speech in an array of probabilities.

    Frames at the threshold cut the array into pieces, each from one of them to the next. The frames of a piece that are more
    than 0.15 below it are quiet; if the quiet ones of a piece span least_silence, speech ends at the first of them.
    """
    at = np.flatnonzero(p >= threshold)
    if not len(at):
        none = np.empty(0, int)
        return none, none, none.astype(bool)
    low = np.flatnonzero(p < threshold - 0.15)
    piece = np.searchsorted(at, low) - 1
    low, piece = low[piece >= 0], piece[piece >= 0]
    first, last = np.full(len(at), len(p)), np.full(len(at), -1)
    np.minimum.at(first, piece, low)
    np.maximum.at(last, piece, low)
    closed = (last >= 0) & ((last - first) * frame >= least_silence)
    ends = np.flatnonzero(closed)
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(at)]
    stop = np.append(first[ends], len(p))[: len(starts)]
    return at[starts], stop, np.append(closed[ends], False)[: len(starts)]


def padded(begin: np.ndarray, end: np.ndarray, total: float, pad: float = 0.03, least_span: float = 0.255) -> list[tuple[float, float]]:
    """Spans in order, widened by the pad, or by half of a silence that two pads would fill; of those, the ones of least_span or more."""
    if not len(begin):
        return []
    gap = begin[1:] - end[:-1]
    share = np.where(gap < 2 * pad, gap / 2, pad)
    b = np.concatenate([[max(0.0, begin[0] - pad)], begin[1:] - share])
    e = np.append(end[:-1] + share, min(total, end[-1] + pad))
    return [(x, y) for x, y in zip(b.tolist(), e.tolist()) if y - x >= least_span]


def hysteresis(probabilities: list[float], threshold: float = 0.5, frame: float = 0.096, least_silence: float = 0.1, least_speech: float = 0.25, pad: float = 0.03, least_span: float = 0.255) -> list[tuple[float, float]]:
    """Speech of one array of probabilities: stretches closed by a silence that are longer than least_speech, and an open last one, padded."""
    first, stop, closed = raw_speech(np.asarray(probabilities, float), threshold, frame, least_silence)
    kept = ~closed | ((stop - first) * frame > least_speech)
    return padded(first[kept] * frame, stop[kept] * frame, len(probabilities) * frame, pad, least_span)


def voice_activity(df: DataFrame, key: str = "utt", threshold: float = 0.5, frame: float = 0.096, least_silence: float = 0.1, least_speech: float = 0.25, pad: float = 0.03, least_span: float = 0.255) -> DataFrame:
    """``(key, begin, end)`` of frames ``(key, frame, p)``: :func:`hysteresis` of each key as pieces, islands and neighbours in windows."""
    order = Window.partitionBy(key).orderBy("frame")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    at = df.select(key, "frame", "p", (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"), F.sum((F.col("p") >= threshold).cast("int")).over(so_far).alias("piece"))
    low = F.when(F.col("p") < threshold - 0.15, F.col("i"))
    pieces = at.where("piece > 0").groupBy(key, "n", "piece").agg(F.min("i").alias("first"), F.min(low).alias("quiet"), F.max(low).alias("last"))
    pieces = pieces.withColumn("closes", F.coalesce((F.col("last") - F.col("quiet")) * frame >= least_silence, F.lit(False)))
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    islands = pieces.withColumn("island", F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0)))
    spans = islands.groupBy(key, "n", "island").agg(F.min("first").alias("first"), F.max(F.when(F.col("closes"), F.col("quiet"))).alias("quiet"))
    spans = spans.where(F.col("quiet").isNull() | ((F.col("quiet") - F.col("first")) * frame > least_speech))
    spans = spans.select(key, (F.col("n") * frame).alias("total"), (F.col("first") * frame).alias("begin"), (F.coalesce("quiet", "n") * frame).alias("end"))
    w = Window.partitionBy(key).orderBy("begin")
    share = lambda gap: F.when(gap < 2 * pad, gap / 2).when(gap >= 2 * pad, F.lit(pad))
    begin = F.coalesce(F.col("begin") - share(F.col("begin") - F.lag("end").over(w)), F.greatest(F.lit(0.0), F.col("begin") - pad))
    end = F.coalesce(F.col("end") + share(F.lead("begin").over(w) - F.col("end")), F.least("total", F.col("end") + pad))
    return spans.select(key, begin.alias("begin"), end.alias("end")).where(F.col("end") - F.col("begin") >= least_span)


def elementary(ref: DataFrame, hyp: DataFrame, key: str = "utt", collar: float = 0.25, slot: float = 10.0) -> DataFrame:
    """Spans between neighbouring boundaries with the sets of reference and system labels, outside the collar around reference boundaries."""
    points = lambda df, by=0.0: df.select(key, F.explode(F.array(F.col("begin") + by, F.col("end") + by)).alias("t"))
    marks = points(ref).union(points(hyp))
    if collar:
        marks = marks.union(points(ref, -collar)).union(points(ref, collar))
    marks = pinned(marks.distinct().withColumn("u", F.lead("t").over(Window.partitionBy(key).orderBy("t"))).where("u IS NOT NULL"))
    # spans and turns meet in slots of time, of so many seconds, so that the join is on equality

    def slots(df, a, b):
        return df.withColumn("slot", F.explode(F.sequence(F.floor(F.col(a) / slot), F.floor(F.col(b) / slot))))

    def labels(df, name):
        turns = slots(df.select(key, F.col("begin").alias("b"), F.col("end").alias("e"), "label"), "b", "e")
        spans = marks.withColumn("slot", F.floor((F.col("t") + F.col("u")) / 2 / slot))
        met = spans.join(turns, [key, "slot"]).where("b <= t AND u <= e")
        return met.groupBy(key, "t", "u").agg(F.collect_set("label").alias(name))

    none = F.array().cast("array<string>")
    out = marks.join(labels(ref, "ref"), [key, "t", "u"], "left").join(labels(hyp, "hyp"), [key, "t", "u"], "left")
    out = out.select(key, F.col("t").alias("begin"), F.col("u").alias("end"), F.coalesce("ref", none).alias("ref"), F.coalesce("hyp", none).alias("hyp"))
    if collar:
        edges = slots(points(ref).distinct().withColumn("lo", F.col("t") - collar).withColumn("hi", F.col("t") + collar), "lo", "hi").select(key, "slot", "lo", "hi")
        placed = out.withColumn("slot", F.floor((F.col("begin") + F.col("end")) / 2 / slot))
        out = placed.join(edges, [key, "slot"], "left").groupBy(key, "begin", "end", "ref", "hyp").agg(F.max(F.coalesce((F.col("lo") <= F.col("begin")) & (F.col("end") <= F.col("hi")), F.lit(False))).alias("near")).where("NOT near").drop("near")
    return out


def best_assignment(gain: np.ndarray) -> np.ndarray:
    """The column of each row, all different, with the largest sum; gain has at least as many columns as rows.

    Rows are placed one by one, each on the cheapest path of exchanges with those before it. Prices of rows and columns keep
    every step's cost from being negative, so that the cheapest path is found as in a graph of distances: n * n * m steps.
    """
    rows, columns = gain.shape
    cost = gain.max(initial=0.0) - gain
    row_price, column_price, owner = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for new in range(rows):
        reach, came, settled = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, column, so_far = new, -1, 0.0
        while True:
            step = so_far + cost[row] - row_price[row] - column_price
            nearer = ~settled & (step < reach)
            reach[nearer], came[nearer] = step[nearer], column
            column = int(np.argmin(np.where(settled, np.inf, reach)))
            so_far = reach[column]
            if owner[column] < 0:
                break
            settled[column] = True
            row = owner[column]
        slack = so_far - reach[settled]
        row_price[owner[settled]] += slack
        column_price[settled] -= slack
        row_price[new] += so_far
        while column >= 0:
            owner[column] = owner[came[column]] if came[column] >= 0 else new
            column = came[column]
    out = np.full(rows, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def best_mapping(weights: dict[tuple[str, str], float]) -> dict[str, str]:
    """System labels to reference labels, one to one, of the largest common time, for any number of labels. Weights aren't negative."""
    refs, hyps = sorted({r for r, _ in weights}), sorted({h for _, h in weights})
    gain = np.array([[weights.get((r, h), 0.0) for h in hyps] for r in refs], float).reshape(len(refs), len(hyps))
    if len(refs) <= len(hyps):
        return {hyps[c]: r for r, c in zip(refs, best_assignment(gain).tolist())}
    return {h: refs[c] for h, c in zip(hyps, best_assignment(gain.T).tolist())}


def diarization_error(ref: DataFrame, hyp: DataFrame, key: str = "utt", collar: float = 0.25, slot: float = 10.0) -> DataFrame:
    """``(key, scored, miss, false_alarm, confusion, der)`` with the best label mapping of each recording.

    Times are sums over spans. What one task sees of a recording is the common time of each pair of its labels, not its spans.
    """
    ref = pinned(ref)  # read many times; so are the spans. A task sorts for one step, not for the steps before it, too
    hyp = pinned(hyp)
    spans = pinned(elementary(ref, hyp, key, collar, slot)).withColumn("d", F.col("end") - F.col("begin"))
    kind = ref.schema[key].dataType.simpleString()
    r, h = F.size("ref"), F.size("hyp")
    times = spans.groupBy(key).agg(*(F.sum(F.col("d") * n).alias(name) for name, n in (("scored", r), ("miss", F.greatest(r - h, F.lit(0))), ("false_alarm", F.greatest(h - r, F.lit(0))), ("both", F.least(r, h)))))
    pairs = spans.select(key, "d", "hyp", F.explode("ref").alias("r")).select(key, "d", "r", F.explode("hyp").alias("h"))
    common = pairs.groupBy(key, "r", "h").agg(F.sum("d").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = dict(zip(zip(pdf["r"], pdf["h"]), pdf["w"]))
        return pd.DataFrame([(pdf[key].iloc[0], sum(weights.get((b, a), 0.0) for a, b in best_mapping(weights).items()))], columns=[key, "right"])

    right = common.groupBy(key).applyInPandas(run, f"{key} {kind}, right double")
    confusion = F.greatest(F.col("both") - F.coalesce("right", F.lit(0.0)), F.lit(0.0))
    out = times.join(right, key, "left").select(key, "scored", "miss", "false_alarm", confusion.alias("confusion"))
    return out.withColumn("der", F.when(F.col("scored") > 0, (F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.col("scored")).otherwise(0.0))


def rttm_line(key: str = "utt", begin: str = "begin", end: str = "end", label: str = "label") -> Column:
    return F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col(key).cast("string"), F.col(begin), F.col(end) - F.col(begin), F.col(label))


def segment_id(key: Column, begin: Column, end: Column) -> Column:
    """``key-bbbbbbbb-eeeeeeee`` with truncated milliseconds."""
    ms = lambda t: F.floor(t * 1000).cast("int")
    return F.format_string("%s-%08d-%08d", key.cast("string"), ms(begin), ms(end))


def concatenated(pieces: DataFrame, waves: DataFrame) -> DataFrame:
    """``(utt, samples)`` of lists ``(utt, parts)``: the samples of the parts in their order."""
    rows = pieces.select("utt", F.posexplode("parts").alias("at", "part")).join(waves.select(F.col("utt").alias("part"), "samples"), "part")
    listed = rows.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("at", "samples"))).alias("found"))
    return listed.select("utt", F.flatten(F.transform("found", lambda x: x["samples"])).alias("samples"))
