"""Keyed text: one row a line, fields parted by white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "utt string, channel int, begin double, end double, label string"


def read_scp(spark: SparkSession, path: str, on_command: str = "error") -> DataFrame:
    """``(key, value)``: the first field and the rest. A value that is a command (it ends in ``|``) is never run: it fails the job, or its row goes."""
    line = F.trim(F.col("value"))
    rows = spark.read.text(path).where(line != "").select(F.regexp_extract(line, r"^(\S+)\s*(.*)$", 1).alias("key"), F.regexp_replace(F.regexp_extract(line, r"^(\S+)\s*(.*)$", 2), r"\s+", " ").alias("value"))
    if on_command == "drop":
        return rows.where(~F.col("value").endswith("|"))
    return rows.withColumn("value", F.when(F.col("value").endswith("|"), F.raise_error(F.lit("a value is a command"))).otherwise(F.col("value")))


def read_list(spark: SparkSession, path: str, name: str = "key") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns by position, with the types of the schema; a missing field is null, one that can't be cast fails."""
    from pyspark.sql.types import _parse_datatype_string

    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*(F.get(fields, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(_parse_datatype_string(schema))))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``(key, members)`` of lines ``key member member ...``."""
    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(fields[0].alias("key"), F.slice(fields, 2, F.size(fields)).alias("members"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    begin = f[3].cast("double")
    return spark.read.text(path).where(F.trim("value") != "").select(f[1].alias("utt"), f[2].cast("int").alias("channel"), begin.alias("begin"), (begin + f[4].cast("double")).alias("end"), f[7].alias("label"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "seg string, utt string, begin double, end double")


def read_labels(spark: SparkSession, path: str, shift_ms: int = 10) -> DataFrame:
    """``(utt, begin, end, label)`` of lines ``utt-bms-ems-f0-f1 label``; the id is read from the right, as utt may hold dashes."""
    f = F.split(F.trim("value"), r"\s+")
    part = lambda i: F.regexp_extract(f[0], r"^(.*)-(\d+)-(\d+)-(\d+)-(\d+)$", i)
    at = lambda i: (part(2).cast("long") + part(i).cast("long") * shift_ms) / 1000.0
    return spark.read.text(path).where(F.trim("value") != "").select(part(1).alias("utt"), at(4).alias("begin"), at(5).alias("end"), f[1].alias("label"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(emb)`` of lines of numbers."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("emb"))


def read_json_list(spark: SparkSession, path: str, schema: str = "key string, spk string, wav string, feat string, vad array<array<string>>") -> DataFrame:
    """Lines of JSON; a line that isn't fails the job."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_lines(df: DataFrame, path: str, *parts, separator: str = " ") -> None:
    """A line a row of the given columns, doubles with five places."""
    kinds = dict(df.dtypes)
    shown = [F.format_string("%.5f", F.col(p)) if isinstance(p, str) and kinds.get(p) in ("double", "float") else (F.col(p).cast("string") if isinstance(p, str) else p) for p in parts]
    df.select(F.concat_ws(separator, *shown).alias("value")).write.text(path)


def write_json_list(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def scan_directory(spark: SparkSession, path: str, pattern: str = "*.wav", depth: int = 3) -> DataFrame:
    """``(key, path, length)`` of files below a folder: the key is the last components of the path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/").alias("key"), "path", "length")
