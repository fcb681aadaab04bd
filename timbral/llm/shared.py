"""Tables in the shared folder of the cluster, and connected components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. In local mode (as in tests) it may be unset; on a cluster it must not be."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{tempfile.gettempdir()}/timbral-scratch").rstrip("/")


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects its garbage, which this asks for."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs a reread only.

    Shuffle files that the table replaces are freed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/timbral-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    free_shuffles(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Removes tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str, text_col: str):
    """A fingerprint of id and text: rows of one id with different texts differ, and rows without an id have one, too."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def likely_rows(rows: DataFrame, ids: DataFrame, id_col: str = "id", bits: int | None = None, unlikely: bool = False) -> DataFrame:
    """Rows whose id may be among the ids: all that are, few others. unlikely: the other rows.

    A bitmap goes to all tasks, so that texts which no join needs are not shuffled. It has
    some 16 bits for each id, 2**16 at least and 2**27 (16 MB) at most; where there are more
    ids it fills up and lets more rows pass, never fewer.
    """
    spark = rows.sparkSession
    if bits is None:
        bits = min(27, max(16, math.ceil(math.log2(16 * ids.count() + 1))))
    size = 1 << bits
    place = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(size))
    marks = ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")).toArrow()
    bitmap = np.zeros(size >> 6, np.int64)
    bitmap[marks.column(0).to_numpy()] = marks.column(1).to_numpy()
    known = spark.sparkContext.broadcast(bitmap)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            mask = pa.array(((known.value[at >> 6] >> (at & 63)) & 1).astype(bool) ^ unlikely)
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

    return rows.select("*", place.alias("__place")).mapInArrow(tidy(pick), rows.schema)


def without(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is none of the (distinct or repeated) ids; only rows that may be among them are shuffled."""
    suspects = likely_rows(rows, ids, id_col).join(ids.select(id_col).distinct(), id_col, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns))
    return likely_rows(rows, ids, id_col, unlikely=True).unionByName(suspects)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for each end of the edges ``(a, b)``; component is the smallest id that can be reached.

    Labels sink along edges and along labels until nothing changes. Each round is joins
    and grouped minima, so that neither edges nor components meet in one task. Null ends
    are ignored; loops give a component of one.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.lit(None).cast("long").alias("before"), F.least("id", "m").alias("label")))
    while True:
        now = labels.select("id", "label")
        near = both.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = now.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = now.select(F.col("id").alias("low"), F.col("label").alias("next"))
        after = written(lower.join(jump, "low").select("id", F.col("label").alias("before"), F.least("low", "next").alias("label")))
        drop(labels)
        labels = after
        if not labels.where("before <> label").limit(1).count():
            drop(both)
            return labels.select("id", F.col("label").alias("component"))
