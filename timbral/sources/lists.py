"""Lists that name files: waves or features of each row, read in the tasks that hold the rows; sub-segment vectors; tables with a header."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import parse_wav, wav_bytes
from .ranges import _filesystem, headers, index_entries, read_records

LIST = "key string, spk string, wav string, feat string, vad array<array<string>>"


def read_list_lines(spark: SparkSession, path: str, schema: str = LIST, on_bad: str = "fail") -> DataFrame:
    """Rows of lines of JSON. A line that can't be parsed, or has no key, fails the job, or goes (``drop``)."""
    if on_bad not in ("fail", "drop"):
        raise ValueError("on_bad is fail or drop")
    lines = spark.read.text(path).where(F.trim("value") != "")
    if on_bad == "fail":
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    marked = f"{schema}, _corrupt_record string"
    return lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).where("r._corrupt_record IS NULL AND r.key IS NOT NULL").select("r.*").drop("_corrupt_record")


def cut_by_spans(samples: np.ndarray, rate: int, spans) -> np.ndarray:
    """The samples of spans ``(begin, end)`` in seconds, one behind the other; no spans leave all samples."""
    if spans is None:
        return samples
    parts = [samples[int(float(b) * rate) : int(float(e) * rate)] for b, e in spans]
    return np.concatenate(parts) if parts else samples[:0]


def with_waves(df: DataFrame, wav: str = "wav", vad: str | None = "vad", on_error: str = "drop") -> DataFrame:
    """Rows with ``sample_rate`` and ``samples`` (first channel) of the file that each names, cut by the spans of its vad column (null: whole).

    Files are read one at a time by the task that holds the row. A row whose file can't be read or whose spans are no numbers
    goes, or fails the job (``error``). Columns with the names of the results are replaced.
    """
    vad = vad if vad in df.columns else None
    made = ("sample_rate", "samples")
    rest = [f for f in df.schema if f.name not in made]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i : i + 1]
                try:
                    system, inside = _filesystem(row[wav].iloc[0])
                    with system.open_input_stream(inside) as f:
                        rate, x = parse_wav(f.read())
                    samples = cut_by_spans(x[0], rate, row[vad].iloc[0] if vad else None)
                except (OSError, ValueError, TypeError, AttributeError, struct.error):
                    if on_error == "error":
                        raise
                    continue
                yield row[[f.name for f in rest]].assign(sample_rate=rate, samples=[samples])

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "sample_rate int, samples array<double>"]))


def write_waves(df: DataFrame, folder: str, rate: int = 16000, key: str = "utt", samples: str = "samples") -> DataFrame:
    """Writes a mono 16-bit file of each row and returns ``(utt, path)``; names are new, as a task may run twice. Only the paths returned count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = []
            for x in pdf["samples"]:
                path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wav"
                system, inside = _filesystem(path)
                system.create_dir(inside.rpartition("/")[0], recursive=True)
                with system.open_output_stream(inside) as f:
                    f.write(wav_bytes(x, rate))
                paths.append(path)
            yield pd.DataFrame({"utt": pdf["utt"], "path": paths})

    return df.select(F.col(key).cast("string").alias("utt"), F.col(samples).cast("array<double>").alias("samples")).where("samples IS NOT NULL").mapInPandas(run, "utt string, path string")


def with_features(df: DataFrame, feat: str = "feat", key: str = "key") -> DataFrame:
    """Rows with the matrix that each one's ``path:offset`` names, in the place of that text; rows that name none go. Places are read in their order."""
    index = index_entries(df.select(F.col(key).alias("key"), F.col(feat).alias("value")).where("value IS NOT NULL").select(F.col("value").alias("key"), "value").distinct())
    matrices = read_records(index, matrix=True).select(F.col("utt").alias("__place"), F.col("feat").alias("__feat"))
    return df.withColumnRenamed(feat, "__place").join(matrices, "__place").withColumnRenamed("__feat", feat).drop("__place")


def read_pieces(spark: SparkSession, path: str, ending: str = "", shift_ms: int = 10) -> DataFrame:
    """``(rec, begin, end, path, offset, emb)`` of archives of sub-segment vectors ``rec-bms-ems-f0-f1``: seconds in the recording, and the place, whose order is that of the archive.

    The id is read from the right, as rec may hold dashes; records with other ids go.
    """
    index = headers(spark, path, "archive", ending).where("kind <> 'broken'").where(F.col("key").rlike(r"^.*-\d+-\d+-\d+-\d+$"))
    named = index.withColumn("key", F.concat_ws("\t", "path", F.col("offset").cast("string"), "key"))
    at = F.split("utt", "\t", 3)
    rows = read_records(named).select(at[0].alias("path"), at[1].cast("long").alias("offset"), at[2].alias("id"), "emb")
    part = lambda i: F.regexp_extract("id", r"^(.*)-(\d+)-(\d+)-(\d+)-(\d+)$", i)
    second = lambda i: (part(2).cast("long") + part(i).cast("long") * shift_ms) / 1000.0
    return rows.select(part(1).alias("rec"), second(4).alias("begin"), second(5).alias("end"), "path", "offset", "emb")


def read_tsv(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """A table whose first line names its columns, separated by tabs, as text; quotes mean nothing. where is put to the rows."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows if where is None else rows.where(where)
