"""Binary formats: archives of vectors and matrices, waveforms, shards. Files are read by Spark, and parsed in tasks."""

from __future__ import annotations

import io
import struct
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import numbered
from . import ranges

_SHAPES = {b"FV": ("<f4", 1), b"DV": ("<f8", 1), b"FM": ("<f4", 2), b"DM": ("<f8", 2)}


def parse_archive(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Keys and arrays of ``key \\0B TAG \\4 rows [\\4 cols] values`` records."""
    at = 0
    while at < len(data):
        end = data.index(b" ", at)
        key = data[at:end].decode().strip()
        if data[end + 1 : end + 3] != b"\0B":
            raise ValueError(f"{key} isn't binary")
        tag, at = data[end + 3 : end + 5], end + 6
        if tag not in _SHAPES:
            raise ValueError(f"type {tag!r} isn't read")
        kind, dims = _SHAPES[tag]
        shape = []
        for _ in range(dims):
            shape.append(struct.unpack_from("<i", data, at + 1)[0])
            at += 5
        n = int(np.prod(shape))
        yield key, np.frombuffer(data, kind, n, at).reshape(shape)
        at += n * int(kind[-1])


def archive_record(key: str, array: np.ndarray) -> bytes:
    a = np.asarray(array, "<f4")
    return key.encode() + b" \0B" + (b"FV " if a.ndim == 1 else b"FM ") + b"".join(b"\4" + struct.pack("<i", n) for n in a.shape) + a.tobytes()


def read_archives(spark: SparkSession, path: str, matrix: bool = False) -> DataFrame:
    """``(utt, emb)``, or ``(utt, feat)`` of matrices, of all archives at the path, read by byte ranges."""
    return ranges.read_archives(spark, path, matrix=matrix)


def pack_archives(df: DataFrame, column: str = "emb") -> DataFrame:
    """``(archive binary, index)``: a row for each batch of ``(utt, column)``, with ``key offset`` lines; write it as files or Parquet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, index = io.BytesIO(), []
            for utt, v in zip(pdf["utt"], pdf[column]):
                index.append(f"{utt} {out.tell() + len(str(utt).encode()) + 1}")
                out.write(archive_record(str(utt), np.array([np.asarray(x) for x in v]) if np.ndim(v[0]) else np.asarray(v)))
            if index:
                yield pd.DataFrame([(out.getvalue(), "\n".join(index))], columns=["archive", "index"])

    return df.select("utt", column).mapInPandas(run, "archive binary, index string")


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (channels x n, in the range of int16) of 16-bit PCM; other chunks are skipped, a wrong data size is mended."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, channels, rate, bits = 12, 1, 16000, 16
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            channels, rate, bits = struct.unpack_from("<H", data, at + 10)[0], struct.unpack_from("<I", data, at + 12)[0], struct.unpack_from("<H", data, at + 22)[0]
        elif name == b"data":
            if bits != 16:
                raise ValueError(f"{bits} bits a sample aren't read")
            n = min(size, len(data) - at - 8) // (2 * channels) * channels
            return rate, np.frombuffer(data, "<i2", n, at + 8).reshape(-1, channels).T.astype(float)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM."""
    pcm = np.clip(np.asarray(samples), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def decode_waves(df: DataFrame, content: str = "content", on_error: str = "drop") -> DataFrame:
    """Rows with ``sample_rate``, ``samples`` (first channel) and ``duration``; rows that can't be read go, or fail the job."""
    rest = [f for f in df.schema if f.name != content]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for raw in pdf[content]:
                try:
                    rate, x = parse_wav(bytes(raw))
                    made.append((rate, x[0].tolist(), x.shape[1] / rate))
                except (ValueError, struct.error, TypeError):
                    if on_error == "error":
                        raise
                    made.append(None)
            ok = [m is not None for m in made]
            good = [m for m in made if m is not None]
            if good:  # a batch of broken rows only gives nothing
                yield pdf.loc[ok, [f.name for f in rest]].assign(sample_rate=[m[0] for m in good], samples=[m[1] for m in good], duration=[m[2] for m in good])

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "sample_rate int, samples array<double>, duration double"]))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, run, key, members map<suffix, bytes>)`` of tar files, read by byte ranges; see :func:`ranges.read_shards`."""
    return ranges.read_shards(spark, path)


def pack_shards(df: DataFrame, per_shard: int = 1000) -> DataFrame:
    """``(shard long, content binary)``: tar files of rows ``(key, members)``, each of about per_shard keys, dealt by hash."""
    total = df.count()
    placed = df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // per_shard)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for _, row in pdf.sort_values("key").iterrows():
                for suffix, data in sorted(dict(row["members"]).items()):
                    info = tarfile.TarInfo(f"{row['key']}.{suffix}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(bytes(data)))
        return pd.DataFrame([(pdf["shard"].iloc[0], out.getvalue())], columns=["shard", "content"])

    return placed.select("shard", "key", "members").groupBy("shard").applyInPandas(run, "shard long, content binary")


def pick_random(store: DataFrame, df: DataFrame, key: str, seed: str) -> DataFrame:
    """Each row with one blob ``(data)`` of the store ``(key, data)``, chosen by a hash of its key. Keys are numbered without their blobs."""
    n = store.count()
    places = numbered(store.select(F.col("key").alias("blob_key")), "blob_key", out="__at")
    chosen = df.withColumn("__at", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(n))).join(places, "__at").drop("__at")
    return chosen.join(store.select(F.col("key").alias("blob_key"), "data"), "blob_key")
