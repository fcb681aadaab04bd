"""``python -m timbral.cli TASK ...``: batch tasks on files; each reads tables, makes one DataFrame and writes it."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import intervals, metrics, scoring, signal
from .sources import binary, lists, ranges, text_tables
from .speakers import Speakers


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    """Archives of vectors, or Parquet of (utt, emb)."""
    return binary.read_archives(spark, path) if path.endswith(".ark") else spark.read.parquet(path)


def _scores(spark: SparkSession, path: str) -> DataFrame:
    rows = text_tables.read_table(spark, path, "enroll string, test string, score double, label string")
    return rows.withColumn("target", F.col("label").isin("target", "tgt").cast("int"))


def score(spark, a) -> None:
    v = _vectors(spark, a.embeddings)
    mean = scoring.mean_vector(_vectors(spark, a.mean_of), "emb") if a.mean_of else None
    out = scoring.cosine_scores(text_tables.read_table(spark, a.trials, "enroll string, test string, label string"), v, mean)
    text_tables.write_lines(out, a.out, "enroll", "test", "score", "label")


def norm(spark, a) -> None:
    cohort = _vectors(spark, a.cohort).select(F.col("utt").alias("name"), "emb")
    vectors = _vectors(spark, a.embeddings)
    out = scoring.with_magnitudes(scoring.normalised(_scores(spark, a.scores), scoring.cohort_stats(vectors, cohort, a.top_n or None)), vectors)
    four = [F.format_string("%.4f", F.col(c)) for c in ("enroll_mag", "test_mag", "enroll_mean", "test_mean")]
    text_tables.write_lines(out, a.out, "enroll", "test", "norm_score", "label", *four)


def _speakers(spark: SparkSession, a) -> tuple[Speakers, DataFrame]:
    """The model (an ONNX file, or ``module:function``, which makes a function of a feature matrix) and the recordings of a list of files."""
    module, colon, name = a.model.rpartition(":")
    if colon and module.isidentifier() and not a.model.endswith(".onnx"):
        model = getattr(importlib.import_module(module), name)
    else:
        model = spark.read.format("binaryFile").load(a.model).select("content").first().content
    waves = lists.with_waves(text_tables.read_scp(spark, a.waves).select(F.col("key").alias("utt"), F.col("value").alias("wav")), vad=None)
    return Speakers(model, a.rate), signal.at_rate(waves, a.rate).select("utt", "samples")


def embed(spark, a) -> None:
    """Vectors of all recordings as archives below out, and their index in out/index."""
    speakers, recordings = _speakers(spark, a)
    written = ranges.write_archives(speakers.embeddings(recordings), a.out)
    text_tables.write_lines(written, f"{a.out}/index", F.concat(F.col("key"), F.lit(" "), F.col("path"), F.lit(":"), F.col("offset").cast("string")))


def similarity(spark, a) -> None:
    """A score from 0 to 1 for each line ``enroll test`` of trials."""
    speakers, recordings = _speakers(spark, a)
    out = speakers.similarity(text_tables.read_table(spark, a.trials, "enroll string, test string"), speakers.embeddings(recordings))
    text_tables.write_lines(out, a.out, "enroll", "test", "score")


def diarize(spark, a) -> None:
    """Turns as RTTM lines, of the speech segments of all recordings."""
    speakers, recordings = _speakers(spark, a)
    turns = speakers.diarize(text_tables.read_segments(spark, a.segments).select("utt", "begin", "end"), recordings)
    text_tables.write_lines(turns, a.out, intervals.rttm_line(begin="turn_begin", end="turn_end"))


def measure(spark, a) -> None:
    curve = metrics.det_curve(_scores(spark, a.scores), ties=("enroll", "test")).cache()
    metrics.equal_error_rate(curve).join(metrics.min_cost(curve, a.p_target)).select((F.col("eer") * 100).alias("eer_percent"), "threshold", "min_dcf").show(truncate=False)


def turns(spark, a) -> None:
    merged = intervals.merge_turns(text_tables.read_labels(spark, a.labels))
    text_tables.write_lines(merged, a.out, intervals.rttm_line(begin="turn_begin", end="turn_end"))


def der(spark, a) -> None:
    intervals.diarization_error(text_tables.read_rttm(spark, a.reference), text_tables.read_rttm(spark, a.hypothesis), collar=a.collar).show(1000, truncate=False)


TASKS = {
    "score": (score, ["trials", "embeddings", "out"], {"mean_of": ""}),
    "norm": (norm, ["scores", "embeddings", "cohort", "out"], {"top_n": 300}),
    "measure": (measure, ["scores"], {"p_target": 0.01}),
    "embed": (embed, ["waves", "model", "out"], {"rate": 16000}),
    "similarity": (similarity, ["waves", "model", "trials", "out"], {"rate": 16000}),
    "diarize": (diarize, ["waves", "model", "segments", "out"], {"rate": 16000}),
    "turns": (turns, ["labels", "out"], {}),
    "der": (der, ["reference", "hypothesis"], {"collar": 0.25}),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    tasks = parser.add_subparsers(dest="task", required=True)
    for name, (_, needed, options) in TASKS.items():
        sub = tasks.add_parser(name)
        for x in needed:
            sub.add_argument(f"--{x}", required=True)
        for x, default in options.items():
            sub.add_argument(f"--{x}", default=default, type=type(default))
    args = parser.parse_args(argv)
    TASKS[args.task][0](SparkSession.builder.appName(f"timbral {args.task}").getOrCreate(), args)


if __name__ == "__main__":
    main()
