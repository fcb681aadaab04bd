"""Event-time windows and state machines over streams; each works on a batch DataFrame, too, where it has no state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle



def _timed(df: DataFrame, time: str, late: str | None) -> DataFrame:
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if late else df


def sliding(df: DataFrame, key: str, value: str, size: str, hop: str | None = None, time: str = "ts", late: str | None = None) -> DataFrame:
    """``(key, begin, n, total)`` of windows of the size, one each hop (without one, side by side)."""
    rows = _timed(df, time, late)
    window = F.window(time, size, hop) if hop else F.window(time, size)
    out = rows.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("begin"), "n", "total")


def sessions(df: DataFrame, key: str, gap: str, time: str = "ts", late: str | None = None) -> DataFrame:
    """``(key, begin, end, n)``: events with less than the gap between them."""
    out = _timed(df, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


#: The state store that typed state and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """Sets the state store of the session's streams to one that has timers. Streams that began with another one keep it.

    Asking for the session's streams starts what coordinates state stores, which a batch with state needs, too.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    _ = spark.streams.active


class _Closing(StatefulProcessor):
    """One typed value of state a key, which goes with the row marked last, or when event time has passed a key's newest row by the idle time.

    Each batch of a key puts its timer off. Subclasses take rows and end a key; both give rows of the output.
    """

    schema: str
    columns: list[str]

    whole = False  # whether each key has all its rows at once, as in a batch

    def __init__(self, order: str, idle_ms: int | None) -> None:
        self.order, self.idle_ms = order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def start(self) -> tuple:
        raise NotImplementedError

    def take(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def end(self, state: tuple) -> list[tuple]:
        raise NotImplementedError

    def _out(self, key: tuple, made: list[tuple]) -> Iterator[pd.DataFrame]:
        if made:
            yield pd.DataFrame([(key[0], *row) for row in made], columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order)
        state, made = self.take(self.state.get() if self.state.exists() else self.start(), batch)
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if self.whole or ("last" in batch and bool(batch["last"].any())):
            made = made + self.end(state)
            self.state.clear()
        else:
            self.state.update(state)
            if self.idle_ms is not None:
                self.handle.registerTimer(int(batch["ts"].max().timestamp() * 1000) + self.idle_ms)
        yield from self._out(key, made)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            made = self.end(self.state.get())
            self.state.clear()
            yield from self._out(key, made)

    def close(self) -> None:
        pass


def _with_state(df: DataFrame, key: str, processor: _Closing, output: str, late: str | None) -> DataFrame:
    if not df.isStreaming:
        processor.whole, processor.idle_ms = True, None
    timed = processor.idle_ms is not None
    rows = df.withColumn("ts", F.col("ts").cast("timestamp")) if timed else df
    if timed:
        rows = rows.withWatermark("ts", late or "0 seconds")
    return rows.groupBy(key).transformWithStateInPandas(processor, output, "append", "EventTime" if timed else "None")


class _Chunks(_Closing):
    schema = "number long, rest array<double>"

    def __init__(self, key: str, size: int, idle_ms: int | None) -> None:
        super().__init__("at", idle_ms)
        self.size, self.columns = size, [key, "chunk", "samples"]

    def start(self) -> tuple:
        return 0, []

    def take(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        number, buffer = state[0], list(state[1])
        for samples in rows["samples"]:
            buffer.extend(samples)
        whole = len(buffer) // self.size
        made = [(number + i, buffer[i * self.size : (i + 1) * self.size]) for i in range(whole)]
        return (number + whole, buffer[whole * self.size :]), made

    def end(self, state: tuple) -> list[tuple]:
        rest = list(state[1])
        return [(state[0], rest + [0.0] * (self.size - len(rest)))] if rest else []


def chunk_stream(df: DataFrame, size: int, key: str = "utt", idle_ms: int | None = None, late: str | None = None) -> DataFrame:
    """``(key, chunk, samples)`` of ``(key, at, samples[, last][, ts])``: chunks of equal size. What is left over, fewer samples than a
    chunk, waits in the state, and goes out, padded with zeros, with the piece marked last, or, with idle_ms, once the watermark of ``ts``
    is so far behind the key's newest piece. Pieces of a key must come in the order of ``at`` across batches. Chunks of a key that comes
    back after its end are numbered from 0 again."""
    kind = df.schema[key].dataType.simpleString()
    return _with_state(df, key, _Chunks(key, size, idle_ms), f"{key} {kind}, chunk long, samples array<double>", late)


@dataclass(frozen=True)
class Speech:
    """What :func:`operators.intervals.hysteresis` takes."""

    threshold: float = 0.5
    frame: float = 0.096
    least_silence: float = 0.1
    least_speech: float = 0.25
    pad: float = 0.03
    least_span: float = 0.255


class _Stretches(_Closing):
    """state: frames seen; first frame of the open stretch; first and last quiet frame since its newest frame at the threshold; padded
    begin and plain end, in frames, of the last finished stretch, which waits for its neighbour. -1 stands for none."""

    schema = "seen long, first long, quiet long, still long, held_begin double, held_end long"

    def __init__(self, key: str, speech: Speech, idle_ms: int | None) -> None:
        super().__init__("frame", idle_ms)
        self.speech, self.columns = speech, [key, "begin", "end"]

    def start(self) -> tuple:
        return 0, -1, -1, -1, -1.0, -1

    def _finished(self, held: tuple[float, int], first: int, stop: int) -> tuple[tuple[float, int], list[tuple]]:
        """The held stretch with its end, as its neighbour is known; the neighbour is held instead."""
        s, (held_begin, held_end), made = self.speech, held, []
        begin = first * s.frame
        if held_end < 0:
            return (max(0.0, begin - s.pad), stop), made
        gap = begin - held_end * s.frame
        share = gap / 2 if gap < 2 * s.pad else s.pad
        end = held_end * s.frame + share
        if end - held_begin >= s.least_span:
            made.append((held_begin, end))
        return (begin - share, stop), made

    def take(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        s, (seen, first, quiet, still, held_begin, held_end) = self.speech, state
        held, made = (held_begin, held_end), []
        marked = rows[(rows["p"] >= s.threshold) | (rows["p"] < s.threshold - 0.15)]
        for i, p in zip(marked["frame"].tolist(), marked["p"].tolist()):
            if p < s.threshold:
                if first >= 0:
                    quiet, still = (i if quiet < 0 else quiet), i
                continue
            if first >= 0 and quiet >= 0 and (still - quiet) * s.frame >= s.least_silence:
                if (quiet - first) * s.frame > s.least_speech:
                    held, done = self._finished(held, first, quiet)
                    made += done
                first = i
            first = i if first < 0 else first
            quiet = still = -1
        seen = max(seen, int(rows["frame"].max()) + 1) if len(rows) else seen
        return (seen, first, quiet, still, float(held[0]), int(held[1])), made

    def end(self, state: tuple) -> list[tuple]:
        s, (seen, first, quiet, still, held_begin, held_end) = self.speech, state
        held, made = (held_begin, held_end), []
        if first >= 0:
            closed = quiet >= 0 and (still - quiet) * s.frame >= s.least_silence
            if not closed or (quiet - first) * s.frame > s.least_speech:
                held, made = self._finished(held, first, quiet if closed else seen)
        if held[1] >= 0:
            end = min(seen * s.frame, held[1] * s.frame + s.pad)
            if end - held[0] >= s.least_span:
                made.append((held[0], end))
        return made


def speech_stream(df: DataFrame, key: str = "utt", idle_ms: int | None = None, late: str | None = None, **settings: float) -> DataFrame:
    """``(key, begin, end)`` of frames ``(key, frame, p[, last][, ts])``, numbered from 0; batches of a key come in the order of frames.

    Six numbers are kept a key, however long a stretch of speech or silence lasts. A key ends with the row marked last or, with
    idle_ms, once the watermark of ``ts`` is so far behind its newest frame. Spans are those of the batch form, whatever the batches
    were; settings are those of :class:`Speech`. On a batch DataFrame, where a key's rows come at once, each key ends with them.
    """
    kind = df.schema[key].dataType.simpleString()
    return _with_state(df, key, _Stretches(key, Speech(**settings), idle_ms), f"{key} {kind}, begin double, end double", late)
