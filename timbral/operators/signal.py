"""Features of waveforms, as Arrow maps over rows ``(utt, samples, ...)``, and of feature matrices, as columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec


def mel_banks(bins: int, fft: int, rate: int, low: float = 20.0, high: float = 0.0) -> np.ndarray:
    """Triangular filters, bins x (fft / 2 + 1), even on the mel scale."""
    mel = lambda f: 1127.0 * np.log(1 + f / 700.0)
    edges = np.linspace(mel(low), mel(high if high > 0 else rate / 2 + high), bins + 2)
    at = mel(np.arange(fft // 2 + 1) * rate / fft)
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0.0, np.minimum((at - left) / (centre - left), (right - at) / (right - centre)))


def fbank(samples: np.ndarray, rate: int = 16000, bins: int = 80, length_ms: float = 25, shift_ms: float = 10, preemphasis: float = 0.97) -> np.ndarray:
    """Log mel energies, frames x bins: mean removal, pre-emphasis, a Hamming window, power spectrum, filters, logarithm."""
    size, hop = int(rate * length_ms / 1000), int(rate * shift_ms / 1000)
    if len(samples) < size:
        return np.empty((0, bins))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, float), size)[::hop].copy()
    frames -= frames.mean(1, keepdims=True)
    frames[:, 1:] -= preemphasis * frames[:, :-1]
    frames[:, 0] *= 1 - preemphasis
    frames *= 0.54 - 0.46 * np.cos(2 * math.pi * np.arange(size) / (size - 1))
    fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames, fft)) ** 2
    banks = mel_banks(bins, fft, rate)
    banks[:, -1] = 0.0
    return np.log(np.maximum(power @ banks.T, np.finfo(np.float32).eps))


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """By the Fourier transform of the whole signal; frequencies above the lower half rate go."""
    if rate == to or not len(samples):
        return np.asarray(samples, float)
    n = max(1, round(len(samples) * to / rate))
    spectrum = np.fft.rfft(samples)
    kept = np.zeros(n // 2 + 1, complex)
    m = min(len(kept), len(spectrum))
    kept[:m] = spectrum[:m]
    return np.fft.irfft(kept, n) * (n / len(samples))


def at_rate(df: DataFrame, to: int, samples: str = "samples", rate: str = "sample_rate") -> DataFrame:
    """df with all samples at one rate, each row from its own; rows that have it already are left alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[samples] = [x if x is None or r == to else resample(np.asarray(x, float), int(r), to) for x, r in zip(pdf[samples], pdf[rate])]
            yield pdf.assign(**{rate: np.int32(to)})

    rows = df.withColumns({samples: F.col(samples).cast("array<double>"), rate: F.col(rate).cast("int")})
    return rows.mapInPandas(run, rows.schema)


def speed_perturbed(samples: np.ndarray, speed: float) -> np.ndarray:
    """The signal played at another speed: its length is divided by it, and pitch follows."""
    return resample(samples, 10_000, round(10_000 / speed))


def reverberated(samples: np.ndarray, impulse: np.ndarray) -> np.ndarray:
    """Convolution with the impulse response of unit energy, cut to the length of the signal."""
    h = np.asarray(impulse, float)
    h = h / max(np.sqrt((h**2).sum()), 1e-12)
    n = 1 << (len(samples) + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(samples, n) * np.fft.rfft(h, n), n)[: len(samples)]


def with_noise(samples: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """The noise, repeated or cut to the signal's length, is added at the ratio."""
    x, z = np.asarray(samples, float), np.resize(np.asarray(noise, float), len(samples))
    db = lambda v: 10 * np.log10((v**2).mean() + 1e-4)
    return x + z * np.sqrt(10 ** ((db(x) - db(z) - snr_db) / 10))


def map_samples(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], column: str = "samples", matrix: bool = False, out: str | None = None) -> DataFrame:
    """The rows with ``f`` applied to an array column; matrix: f returns a matrix."""
    out = out or column
    kind = "array<array<double>>" if matrix else "array<double>"
    rest = [c for c in df.schema if c.name not in (column, out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [f(np.asarray(x, float)) for x in pdf[column]]
            yield pdf[[c.name for c in rest]].assign(**{out: [m.tolist() for m in made]})

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in rest), f"`{out}` {kind}"])
    return df.mapInPandas(run, schema)


def fbank_features(df: DataFrame, **settings) -> DataFrame:
    return map_samples(df, lambda x: fbank(x, **settings), matrix=True, out="feat")


def speed_labels(df: DataFrame, n_speakers: int, speeds: tuple[float, ...] = (1.0, 0.9, 1.1), label: str = "label") -> DataFrame:
    """A row for each speed; a known label of speed i is raised by i times the number of speakers."""
    i = F.col("speed_index")
    rows = df.withColumn("speed_index", F.explode(F.sequence(F.lit(0), F.lit(len(speeds) - 1))))
    return rows.withColumn("speed", F.element_at(F.array(*map(F.lit, speeds)), i + 1)).withColumn(label, F.when(F.col(label) < 0, F.col(label)).otherwise(F.col(label) + n_speakers * i))


def mean_normalised(feat: Column, variance: bool = False) -> Column:
    """Frames minus the mean of each bin; with variance, divided by the deviation (of a sample, plus 1e-8)."""
    n = F.size(feat)
    dims = F.sequence(F.lit(0), F.size(feat[0]) - 1)
    column = lambda d: F.transform(feat, lambda frame: frame[d].cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    stats = F.transform(dims, lambda d: F.struct((total(column(d)) / n).alias("mean"), total(F.transform(column(d), lambda x: x * x)).alias("square")))

    def one(x, s):
        if not variance:
            return x.cast("double") - s["mean"]
        return (x.cast("double") - s["mean"]) / F.sqrt((s["square"] - n * s["mean"] * s["mean"]) / (n - 1) + 1e-8)

    return vec.held(stats, lambda known: F.transform(feat, lambda frame: F.zip_with(frame, known, one)))


def length_between(df: DataFrame, least: int, most: int, column: str = "samples", key: str = "utt") -> DataFrame:
    """Rows of at least the given length; of those above the most, a chunk of that length at a hashed place."""
    n, v = F.size(column), F.col(column)
    start = F.pmod(F.xxhash64(key), F.greatest(n - most + 1, F.lit(1))).cast("int")
    return df.where(n >= least).withColumn(column, F.when(n > most, F.slice(v, start + 1, F.lit(most))).otherwise(v))


def feature_chunks(feat: Column, size: int) -> Column:
    """Chunks of size frames; the last one is filled up with frames from the beginning."""
    n = F.size(feat)
    whole = F.flatten(F.array_repeat(feat, F.floor(F.lit(size) / n).cast("int") + 2))
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(whole, i * size + 1, size))


def pooled(df: DataFrame, key: str, feat: str = "feat") -> DataFrame:
    """``(key, pooled)``: means, then deviations sqrt(var_samp + 1e-7), of all bins over time."""
    frames = df.select(key, F.explode(feat).alias("frame"))
    bins = frames.select(key, F.posexplode("frame").alias("bin", "x")).groupBy(key, "bin").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.sqrt(F.var_samp(F.col("x").cast("double")) + 1e-7).alias("dev"))
    listed = bins.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "mean", "dev"))).alias("b"))
    return listed.select(key, F.concat(F.transform("b", lambda x: x["mean"]), F.transform("b", lambda x: x["dev"])).alias("pooled"))


def voiced(samples: Column, spans: Column, rate: int) -> Column:
    """The samples of the spans ``(begin, end)`` in seconds, one behind the other."""
    at = lambda t: F.floor(t * rate).cast("int")
    return F.flatten(F.transform(spans, lambda s: F.slice(samples, at(s["begin"]) + 1, at(s["end"]) - at(s["begin"]))))


def multi_crop(v: Column, key: Column, local: int, local_length: int, wide: int, wide_length: int) -> Column:
    """Chunks at hashed places: local short ones and wide long ones."""

    def chunks(count, length, salt):
        start = lambda i: F.pmod(F.xxhash64(key, F.lit(salt), i), F.greatest(F.size(v) - length + 1, F.lit(1))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.slice(v, start(i) + 1, length))

    return F.struct(chunks(local, local_length, "local").alias("local_chunks"), chunks(wide, wide_length, "global").alias("global_chunks"))


def embed(df: DataFrame, model: bytes | Callable, feat: str = "feat", out: str = "emb") -> DataFrame:
    """The rows with an embedding of each feature matrix. model: the bytes of an ONNX graph with input feats and output embs, or
    a function that makes, once in a worker, a function of a matrix."""
    rest = [c for c in df.schema if c.name not in (feat, out)]
    maker = model if callable(model) else None
    graph = None if callable(model) else df.sparkSession.sparkContext.broadcast(model)

    def load():
        if maker is not None:
            return maker()
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(graph.value, options, providers=["CPUExecutionProvider"])
        return lambda x: session.run(["embs"], {"feats": x[None].astype(np.float32)})[0][0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = load()
        for pdf in batches:
            made = [np.asarray(f(np.stack([np.asarray(r, float) for r in m])), float).tolist() for m in pdf[feat]]
            yield pdf[[c.name for c in rest]].assign(**{out: made})

    return df.mapInPandas(run, ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in rest), f"`{out}` array<double>"]))
