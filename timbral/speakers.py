"""A registry of speakers: similarity of two recordings, registration and recognition, diarization of many recordings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vec
from .operators import clustering, intervals, scoring, signal


class Speakers:
    """Holds the registered models; recordings are DataFrames ``(utt, samples)``, embeddings ``(utt, emb)``.

    model is the bytes of an ONNX graph, or a function that makes a function of a feature matrix.
    """

    def __init__(self, model: bytes | Callable, rate: int = 16000, bins: int = 80, window: int = 150, period: int = 75):
        self.model, self.rate, self.bins, self.window, self.period = model, rate, bins, window, period
        self.models: DataFrame | None = None

    def features(self, recordings: DataFrame) -> DataFrame:
        return signal.fbank_features(recordings, rate=self.rate, bins=self.bins).withColumn("feat", signal.mean_normalised(F.col("feat")))

    def embeddings(self, recordings: DataFrame) -> DataFrame:
        return signal.embed(self.features(recordings), self.model).select("utt", "emb")

    def similarity(self, trials: DataFrame, embeddings: DataFrame) -> DataFrame:
        """Scores from 0 to 1 of ``(enroll, test)``; 0 where one has no embedding."""
        return scoring.cosine_scores(trials, embeddings, scale="unit", on_missing="keep").fillna({"score": 0.0})

    def register(self, named: DataFrame) -> None:
        """Adds ``(name, emb)``; a name that is there is replaced."""
        new = named.select("name", vec.as_double(F.col("emb")).alias("emb"))
        self.models = new if self.models is None else self.models.join(new, "name", "left_anti").unionByName(new)

    def recognize(self, embeddings: DataFrame) -> DataFrame:
        if self.models is None:
            raise ValueError("no speaker is registered")
        return scoring.identify(embeddings, self.models)

    def diarize(self, segments: DataFrame, recordings: DataFrame) -> DataFrame:
        """Turns ``(utt, turn_begin, turn_end, label)`` of speech segments ``(utt, begin, end)``: pieces, embeddings, clusters, merged turns."""
        shift = 0.01
        frames = segments.withColumn("n_frames", F.floor((F.col("end") - F.col("begin")) / shift).cast("long"))
        pieces = intervals.subsegments(frames, self.window, self.period)
        at = lambda c: F.col("begin") + F.col(c) * shift
        pieces = pieces.select("utt", at("first").alias("b"), at("last").alias("e"))
        cut = pieces.join(recordings, "utt")
        start, count = F.floor(F.col("b") * self.rate).cast("int"), F.floor((F.col("e") - F.col("b")) * self.rate).cast("int")
        cut = cut.select("utt", "b", "e", F.slice("samples", start + 1, count).alias("samples"))
        vectors = signal.embed(self.features(cut), self.model)
        labels = clustering.cluster(vectors.select("utt", F.col("b").alias("ord"), "emb"), order="ord")
        labelled = vectors.select("utt", F.col("b").alias("begin"), F.col("e").alias("end")).join(labels.withColumnRenamed("ord", "begin"), ["utt", "begin"])
        return intervals.merge_turns(labelled.withColumn("label", F.col("label").cast("string")))
