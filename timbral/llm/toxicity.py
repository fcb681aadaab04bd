"""Toxicity by compression distance: two zstandard dictionaries, short windows, calibrated thresholds.

A window is one lower-cased word between blanks, or the first four letters of a longer
one behind a blank, which stands for all its forms. Each character is written as a fixed
four-byte code, so that the match structure of so short a window outweighs the frame.
Each dictionary is raw content made of the windows that recur in its class: the
ordinary one of windows in enough ordinary documents, the most frequent last, where
offsets are cheapest; the toxic one of windows that recur in toxic documents and that
the ordinary dictionary doesn't hold. A window counts as toxic if its length under
the toxic dictionary is at most ``most_bytes`` and at least ``least_gain`` bytes below
that under the ordinary one. Both thresholds, and the logistic curve from counts to a
score, are fitted on the training documents.

Training uses a bounded sample: ``max_toxic`` and ``max_ordinary`` labelled documents,
first by hash of their id. Scoring reads whole texts. Null and empty texts have no
window and get the score of no evidence; equal texts get equal scores; further columns
are ignored; an empty table gives an empty result. Without a toxic or an ordinary
training document all scores are the share of toxic ones among all.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, narrow, small_batches

WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Settings:
    max_toxic: int = 1500
    max_ordinary: int = 4500
    ordinary_share: float = 0.001
    toxic_share: float = 0.02
    least_documents: int = 2
    ordinary_bytes: int = 1 << 20
    toxic_bytes: int = 1 << 14


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    most_bytes: int
    least_gain: int
    weights: tuple[float, float, float]

    def score(self, hits: int, words: int) -> float:
        w = self.weights
        x = w[0] + w[1] * min(hits, 8) + w[2] * math.sqrt(hits / max(words, 1))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


class _Codes(dict):
    def __missing__(self, char: str) -> bytes:
        self[char] = out = hashlib.blake2b(char.encode("utf-8", "surrogatepass"), digest_size=4).digest()
        return out


_codes = _Codes()


def windows(word: str) -> tuple[str, ...]:
    return (f" {word} ", f" {word[:4]}") if len(word) > 4 else (f" {word} ",)


def coded(window: str) -> bytes:
    return b"".join(map(_codes.__getitem__, window))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, strategy=zstandard.STRATEGY_BTOPT,
        window_log=max(17, len(content).bit_length()), hash_log=17, chain_log=18, search_log=5, min_match=4, target_length=64,
    )
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def _content(found: Iterable[str], counts: Counter, most: int) -> bytes:
    parts, used = [], 0
    for window in sorted(found, key=lambda w: (-counts[w], w)):
        part = coded(window)
        if used + len(part) > most:
            break
        parts.append(part)
        used += len(part)
    return b"".join(reversed(parts))


class Lengths:
    """Window lengths under both dictionaries; the long ordinary dictionary is asked only where it can matter."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.by_ordinary, self.by_toxic = compressor(ordinary).compress, compressor(toxic).compress

    def gain(self, window: str, most_bytes: int) -> tuple[int, int] | None:
        """(toxic length, gain), or None where the toxic length is above most_bytes."""
        data = coded(window)
        toxic = len(self.by_toxic(data))
        return (toxic, len(self.by_ordinary(data)) - toxic) if toxic <= most_bytes else None


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a small ridge logistic regression; the classes weigh as they come."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: Iterable[tuple[str | None, int]], settings: Settings = Settings()) -> Model:
    """A model of (text, label) rows; the rows are the bounded sample."""
    documents = [(Counter(WORDS((text or "").lower())), int(label)) for text, label in rows]
    counts = {0: Counter(), 1: Counter()}
    for words, label in documents:
        counts[label].update({w for word in words for w in windows(word)})
    size = Counter(label for _, label in documents)
    enough = lambda label, share: max(settings.least_documents + label, round(share * size[label]))
    common = [w for w, n in counts[0].items() if n >= enough(0, settings.ordinary_share)]
    held = set(common)
    marked = [w for w, n in counts[1].items() if n >= enough(1, settings.toxic_share) and w not in held]
    share = (size[1] + 0.5) / (len(documents) + 1)
    prior = math.log(share / (1 - share))
    ordinary, toxic = _content(common, counts[0], settings.ordinary_bytes), _content(marked, counts[1], settings.toxic_bytes)
    if not size[0] or not size[1] or not marked:
        return Model(ordinary, toxic, 0, 1, (prior, 0.0, 0.0))
    lengths, known, farthest = Lengths(ordinary, toxic), {}, 20
    y = np.array([label for _, label in documents], float)
    total = np.array([max(1, words.total()) for words, _ in documents], float)
    grid = [(most, gain) for most in range(11, farthest + 1) for gain in range(1, 9)]
    hits = np.zeros((len(documents), len(grid)))
    for i, (words, _) in enumerate(documents):
        for word, n in words.items():
            if word not in known:
                found = [f for w in windows(word) if (f := lengths.gain(w, farthest)) is not None]
                known[word] = [k for k, (most, gain) in enumerate(grid) if any(a <= most and b >= gain for a, b in found)]
            if at := known[word]:
                hits[i, at] += n
    best = None
    for k, (most, gain) in enumerate(grid):
        x = np.stack([np.ones(len(y)), np.minimum(hits[:, k], 8), np.sqrt(hits[:, k] / total)], 1)
        w = _logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        loss = -np.mean(np.log(np.where(y == 1, p, 1 - p) + 1e-12))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, most, gain, tuple(map(float, w)))
    return Model(ordinary, toxic, best[1], best[2], best[3])


@functools.lru_cache(maxsize=2)
def _judge(model: Model):
    """A function of a text's words; verdicts on windows are kept, in two generations of bounded size."""
    lengths, young, old = Lengths(model.ordinary, model.toxic), {}, {}

    @functools.lru_cache(maxsize=50_000)
    def marked(window: str) -> bool:
        found = lengths.gain(window, model.most_bytes)
        return found is not None and found[1] >= model.least_gain

    def hit(word: str) -> bool:
        nonlocal young, old
        verdict = old.get(word)
        if verdict is None:
            whole, *heads = windows(word)
            verdict = any(map(marked, heads)) or marked.__wrapped__(whole)
        if len(young) >= 400_000:
            young, old = {}, young
        young[word] = verdict
        return verdict

    def judge(text: str | None) -> float:
        words = WORDS((text or "").lower())
        get = young.get
        hits = 0
        for word in words:
            verdict = get(word)
            hits += hit(word) if verdict is None else verdict
        return model.score(hits, len(words))

    return judge


def sample_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[tuple[str | None, int]]:
    """The training sample. The ids, bounded by the settings, are broadcast; texts of those rows only come to the driver."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = own.where("toxic = 1").orderBy(*order).limit(settings.max_toxic).unionByName(own.where("toxic = 0").orderBy(*order).limit(settings.max_ordinary))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.text or ""))]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)``: score from 0 to 1, predicted 1 from 0.5 on."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = narrow(docs, **{"id": id_col, "text": text_col})
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        judge = _judge(shared.value)
        return lambda row: ((row[0], s := judge(row[1]), int(s >= 0.5)),)

    return map_rows(rows, make, f"`{id_col}` {kind}, score double, predicted int")
