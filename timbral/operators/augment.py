"""What is done to each row of training data: speed, reverberation or noise of a class at a level, masks in time and frequency.

Choices are draws of (key, seed, number), see :mod:`timbral.functions.draws`. They are columns of a plan; what they do to
samples (:mod:`timbral.operators.signal`) is a map over the rows of the plan. An epoch is another seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws, vec
from .prefix import numbered

#: Signal-to-noise ratios in dB by the class that the name of a noise begins with (fixed values).
NOISE_LEVELS = {"noise": (0.0, 15.0), "speech": (10.0, 30.0), "music": (5.0, 15.0)}
OTHER_LEVEL = (0.0, 15.0)
#: Speeds that are drawn from; the first leaves a row as it is (fixed values).
SPEEDS = (1.0, 0.9, 1.1)

# Numbers of the draws of a row, so that no two decisions share one.
_SPEED, _WHETHER, _KIND, _SOURCE, _LEVEL, _MASKED = range(6)
_MASKS = 16


def drawn_speed(df: DataFrame, key: str, seed: str, n_speakers: int, speeds: tuple[float, ...] = SPEEDS, label: str = "label") -> DataFrame:
    """Each row with one of the speeds as ``speed``; a row of speed i counts as another speaker, n_speakers * i labels further. Null labels stay null."""
    i = draws.whole(F.col(key), seed, _SPEED, len(speeds))
    out = df.withColumn("speed_index", i.cast("int"))
    return out.withColumns({"speed": F.element_at(F.array(*map(F.lit, speeds)), F.col("speed_index") + 1), label: F.col(label) + n_speakers * F.col("speed_index")})


def noise_class(name: Column) -> Column:
    """The class whose name begins the name of a noise, else ``other``."""
    out = F.lit("other")
    for kind in NOISE_LEVELS:
        out = F.when(name.startswith(kind), kind).otherwise(out)
    return out


def drawn_noise(df: DataFrame, noises: DataFrame, reverbs: DataFrame, key: str, seed: str, prob: float = 0.6) -> DataFrame:
    """Each row with ``augment`` (none, reverb, noise), and what it is done with: ``source``, a name, and ``snr_db`` for noises.

    noises and reverbs are ``(name, ...)``, of which names alone are read; a name counts once for each row it has. Both kinds
    are equally likely, and each name of a kind. The level is even in the range of the noise's class. Where the drawn kind has
    no names, the row stays as it is (none). Names are numbered in their order by ranges, and met by an equi-join on kind and number.
    """
    stores = {"reverb": reverbs, "noise": noises}
    names, sizes = [], {}
    for kind, store in stores.items():
        named = numbered(store.select(F.col("name").alias("source")), "source", out="__drawn").select(F.lit(kind).alias("augment"), "__drawn", "source")
        names.append(named)
        sizes[kind] = store.count()
    k = F.col(key)
    kind = F.when(draws.chance(k, seed, _KIND, 0.5), "reverb").otherwise("noise")
    place = F.when(F.col("augment") == "reverb", draws.whole(k, seed, _SOURCE, sizes["reverb"])).when(F.col("augment") == "noise", draws.whole(k, seed, _SOURCE, sizes["noise"]))
    chosen = df.withColumn("augment", F.when(draws.chance(k, seed, _WHETHER, prob), kind).otherwise("none")).withColumn("__drawn", place)
    met = chosen.join(names[0].unionByName(names[1]), ["augment", "__drawn"], "left").drop("__drawn")
    met = met.withColumn("augment", F.when(F.col("source").isNull(), "none").otherwise(F.col("augment")))
    cls = noise_class(F.col("source"))
    low, high = F.lit(OTHER_LEVEL[0]), F.lit(OTHER_LEVEL[1])
    for name, (least, most) in NOISE_LEVELS.items():
        low, high = F.when(cls == name, least).otherwise(low), F.when(cls == name, most).otherwise(high)
    return met.withColumn("snr_db", F.when(F.col("augment") == "noise", draws.between(k, seed, _LEVEL, low, high)))


def mask_spans(key: Column, seed: str, size: Column, count: int, most: int, axis: int) -> Column:
    """count spans ``(first, end)`` of 1 to most places on an axis of the given size; they may overlap, and end with the axis."""
    made = []
    for i in range(count):
        at = _MASKED + 1 + 2 * (i * 2 + axis)
        first = draws.whole(key, seed, at, size)
        made.append(F.struct(first.alias("first"), F.least(first + 1 + draws.whole(key, seed, at + 1, most), size.cast("long")).alias("end")))
    return F.array(*made) if made else F.array().cast("array<struct<first:bigint,end:bigint>>")


def masked(df: DataFrame, key: str, seed: str, feat: str = "feat", time_masks: int = 1, bin_masks: int = 1, most_frames: int = 10, most_bins: int = 8, prob: float = 0.6) -> DataFrame:
    """Feature matrices (arrays of frames) with spans of frames and of bins set to 0, with probability prob; a null or empty matrix stays.

    The columns ``masked``, ``time_spans`` and ``bin_spans`` say what was done (spans also where the row isn't masked).
    """
    k, frames = F.col(key), F.col(feat).cast("array<array<double>>")
    bins = F.size(F.get(frames, F.lit(0)))
    out = df.withColumns({
        "masked": draws.chance(k, seed, _MASKED, prob) & (F.size(frames) > 0) & (bins > 0),
        "time_spans": mask_spans(k, seed, F.size(frames), time_masks, most_frames, 0), "bin_spans": mask_spans(k, seed, bins, bin_masks, most_bins, 1),
    })
    covered = lambda spans, i: F.exists(spans, lambda s: (s["first"] <= i) & (i < s["end"]))
    zeros = lambda frame: F.transform(frame, lambda x: F.lit(0.0))
    one = lambda frame, t: F.when(covered(F.col("time_spans"), t), zeros(frame)).otherwise(F.transform(frame, lambda x, b: F.when(covered(F.col("bin_spans"), b), 0.0).otherwise(x)))
    return out.withColumn(feat, F.when(F.col("masked"), F.transform(frames, one)).otherwise(frames))


def mixed(df: DataFrame, samples: str = "samples", noise: str = "noise", snr: str = "snr_db") -> DataFrame:
    """Samples plus the noise at its level, then scaled to a peak of one; a longer noise is cut, a shorter one repeated. Rows without a level stay."""
    n = F.size(samples)
    fitted = F.slice(F.flatten(F.array_repeat(F.col(noise), F.floor(n / F.greatest(F.size(noise), F.lit(1))).cast("int") + 1)), F.lit(1), n)
    gain = vec.noise_gain(F.col(samples), fitted, F.col(snr))
    usable = F.col(snr).isNotNull() & (F.size(noise) > 0) & (n > 0)
    return df.withColumn(samples, F.when(usable, vec.peak_normalise(vec.plus(F.col(samples), vec.times(fitted, gain)))).otherwise(vec.as_double(F.col(samples))))
