"""Keyed tables of a data directory: lookups, consistency, subsets, unions.

Every random choice is a hash of the key and a seed, so that it can be repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import pinned
from .prefix import numbered, running_before


def filter_ids(df: DataFrame, ids: DataFrame, key: str, exclude: bool = False) -> DataFrame:
    """Rows whose key is (exclude: is not) among the first column of ids."""
    listed = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return df.join(listed, key, "left_anti" if exclude else "left_semi")


def invert(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """``(value, out)``: the keys of each value in the order of ``order``."""
    listed = df.groupBy(value).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(key).alias("key")))).alias("found"))
    return listed.select(value, F.transform("found", lambda x: x["key"]).alias(out))


def uninvert(df: DataFrame, value: str, listed: str, key: str) -> DataFrame:
    return df.select(F.explode(listed).alias(key), value)


def lookup(left: DataFrame, right: DataFrame, key: str, on_missing: str = "error") -> DataFrame:
    """Equi join to a table with unique keys. error: a missing key fails the job; drop: its row goes; keep: nulls."""
    if on_missing in ("drop", "keep"):
        return left.join(right, key, "inner" if on_missing == "drop" else "left")
    marked = left.join(right.withColumn("__there", F.lit(True)), key, "left")
    checked = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit(f"{key} is missing: "), F.col(key).cast("string")))).otherwise(F.col("__there"))
    return marked.withColumn("__there", checked).where("__there").drop("__there")


def raw_list(utt2spk: DataFrame, wav: DataFrame, vad: DataFrame | None = None, keep_without_vad: bool = False) -> DataFrame:
    """``(key, spk, wav[, vad])``; rows without speech spans go, or stay with a null."""
    rows = lookup(utt2spk, wav, "key", "drop")
    return rows if vad is None else rows.join(vad, "key", "left" if keep_without_vad else "inner")


def unique_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def consistent(tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Each table with only those keys that all of them have."""
    common = reduce(lambda a, b: a.join(b, key, "left_semi"), (t.select(key).distinct() for t in tables.values()))
    return {name: t.join(common, key, "left_semi") for name, t in tables.items()}


def closed(tables: dict[str, DataFrame], keys: tuple[str, ...] = ("utt", "spk", "rec")) -> dict[str, DataFrame]:
    """The largest parts of the tables in which each key of each level stands in all tables that have a column of that level.

    A table may have several levels, as one of utterances with their speakers and recordings: a recording that is lost takes its
    utterances along, they the speakers that have no other one, and so on, until a round of semi-joins drops nothing. Rows with a
    null key go. Each round is written, so that the plan does not grow with the number of rounds.
    """
    now = {name: pinned(t) for name, t in tables.items()}
    sizes = {name: t.count() for name, t in now.items()}
    while True:
        for key in keys:
            holders = [name for name, t in now.items() if key in t.columns]
            if len(holders) > 1:
                common = pinned(reduce(lambda a, b: a.join(b, key, "left_semi"), (now[name].select(key).distinct() for name in holders)))
                now |= {name: now[name].join(common, key, "left_semi").select(now[name].columns) for name in holders}
            elif holders:
                now[holders[0]] = now[holders[0]].where(F.col(key).isNotNull())
        now = {name: pinned(t) for name, t in now.items()}
        before, sizes = sizes, {name: t.count() for name, t in now.items()}
        if sizes == before:
            return now


def combine(sources: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Unions of the tables that all sources have."""
    names = set.intersection(*(set(s) for s in sources))
    return {n: reduce(lambda a, b: a.unionByName(b), (s[n] for s in sources)) for n in sorted(names)}


def cut_to(tables: dict[str, DataFrame], keep: DataFrame) -> dict[str, DataFrame]:
    """The tables of a data directory cut to a list of keys (one column: utt, spk or rec), and then to what is left of all levels."""
    key = keep.columns[0]
    if not any(key in t.columns for t in tables.values()):
        raise ValueError(f"no table has {key}")
    return closed({n: t.join(keep.select(key).distinct(), key, "left_semi").select(t.columns) if key in t.columns else t for n, t in tables.items()})


def spread_per_group(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """At most n rows of each group, at an even stride that is as wide as the group allows."""
    w = Window.partitionBy(group)
    rows = df.withColumn("__rank", F.row_number().over(w.orderBy(key))).withColumn("__count", F.count(F.lit(1)).over(w))
    stride = F.greatest(F.lit(1), F.floor(F.col("__count") / n))
    return rows.where(((F.col("__rank") - 1) % stride == 0) & (F.col("__rank") <= n * stride)).drop("__rank", "__count")


def hashed(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit("|"), F.lit(seed)))


def groups_up_to(df: DataFrame, group: str, n: int, seed: str) -> DataFrame:
    """Whole groups, in hash order, as long as the rows before a group are fewer than n."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    before = running_before(sizes, "n", hashed(F.col(group), seed), group)
    return df.join(before.where(F.col("before") < n).select(group), group, "left_semi")


def least_members(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of groups with at least n rows."""
    return df.join(df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n), group, "left_semi")


def dense_ids(df: DataFrame, name: str, out: str = "id") -> DataFrame:
    """``(name, id)``: 0 to N - 1 in the order of the distinct names."""
    return numbered(df.select(name).distinct(), name, out=out)


def copies(df: DataFrame, key: str, n: int) -> DataFrame:
    """Each row as its copies 0 to n, with ``_copy-i`` behind the key."""
    made = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return made.withColumn(key, F.concat(F.col(key).cast("string"), F.lit("_copy-"), F.col("copy").cast("string")))


def majority(df: DataFrame, key: str, label: str, weight: str, epsilon: float = 1e-5) -> DataFrame:
    """The label with the largest sum of each key; labels within epsilon of it tie, and the smallest name wins."""
    sums = df.groupBy(key, label).agg(F.sum(weight).alias("total"))
    best = F.max("total").over(Window.partitionBy(key))
    near = sums.withColumn("best", best).where(F.col("total") > F.col("best") - epsilon)
    return near.groupBy(key).agg(F.min(label).alias(label), F.max("total").alias("total"))


def calibration_trials(utts: DataFrame, short: tuple[float, float], long: float, n: int, seed: str) -> DataFrame:
    """``(enroll, test, label)``: for each of n draws a target and a nontarget pair of a short and a long utterance.

    utts is ``(utt, spk, dur)``. Speakers need both kinds. A draw takes, by hash, a speaker,
    one utterance of each kind, and a long one of the next speaker in that draw's order.
    """
    kind = F.when((F.col("dur") > short[0]) & (F.col("dur") < short[1]), "short").when(F.col("dur") > long, "long")
    u = utts.withColumn("kind", kind).where("kind IS NOT NULL")
    both = u.groupBy("spk").agg(F.countDistinct("kind").alias("k")).where("k = 2").select("spk")
    u = u.join(both, "spk", "left_semi")
    ranked = u.withColumn("rank", F.row_number().over(Window.partitionBy("spk", "kind").orderBy(hashed(F.col("utt"), seed), "utt")))
    firsts = ranked.where("rank = 1").groupBy("spk").agg(F.max(F.when(F.col("kind") == "short", F.col("utt"))).alias("short"), F.max(F.when(F.col("kind") == "long", F.col("utt"))).alias("long"))
    placed = pinned(numbered(firsts, hashed(F.col("spk"), seed), "spk"))
    following = placed.select((F.col("at") - 1).alias("at"), F.col("long").alias("other"))
    drawn = placed.where(F.col("at") < n).join(following, "at", "left")
    pairs = F.inline(F.array(F.struct(F.col("short").alias("enroll"), F.col("long").alias("test"), F.lit("target").alias("label")), F.struct(F.col("short").alias("enroll"), F.col("other").alias("test"), F.lit("nontarget").alias("label"))))
    return drawn.select(pairs).where("test IS NOT NULL")


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """The rows in hash order of their key; another seed, as the number of an epoch, gives another order."""
    return df.orderBy(hashed(F.col(key), seed), key)


def share_of(df: DataFrame, key: str, rank: int, world: int, seed: str = "") -> DataFrame:
    """The rows of one of several workers: each row belongs to exactly one."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(world)) == rank)


def copied(tables: dict[str, DataFrame], key: str, ids: DataFrame | None = None, path_column: str = "path", old: str = "", new: str = "") -> dict[str, DataFrame]:
    """A copy of the tables for some ids, with paths moved from one folder to another."""
    out = {}
    for name, t in tables.items():
        t = t if ids is None else filter_ids(t, ids, key)
        out[name] = t.withColumn(path_column, F.regexp_replace(path_column, F.lit("^" + old), F.lit(new))) if old and path_column in t.columns else t
    return out


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def within_durations(df: DataFrame, durations: DataFrame, least: float, most: float, key: str = "utt") -> DataFrame:
    """Rows whose duration, of the map ``(key, dur)``, lies between both ends; rows that the map lacks go."""
    return df.join(durations.where(F.col("dur").between(least, most)), key)


def ranged(df: DataFrame, key: str, cuts: list[str], names: list[str], out: str = "part") -> DataFrame:
    """The range of a key in the order of strings: names[i] before cuts[i], the last name from the last cut on. A null key has a null range."""
    part = F.when(F.col(key).isNull(), None)
    for cut, name in zip(cuts, names):
        part = part.when(F.col(key) < cut, name)
    return df.withColumn(out, part.otherwise(names[-1]))


def recoded(df: DataFrame, column: str, codes: dict[str, str], default: str, out: str) -> DataFrame:
    """Labels by a table of codes; what it lacks, nulls too, gets the default."""
    code = F.lit(default)
    for old, new in codes.items():
        code = F.when(F.col(column) == old, new).otherwise(code)
    return df.withColumn(out, code)


def speaker_of(df: DataFrame, key: str, separator: str = "-", out: str = "spk") -> DataFrame:
    """The speaker as the part of the utterance's id before the first separator; an id without one is its own speaker."""
    return df.withColumn(out, F.substring_index(key, separator, 1))


def own_speaker(df: DataFrame, key: str, out: str = "spk") -> DataFrame:
    """Each utterance as a speaker of its own."""
    return df.withColumn(out, F.col(key))


def prefixed(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Ids with a prefix for each of the columns, as copies of a directory beside the original need."""
    return df.withColumns({c: F.concat(F.lit(p), F.col(c).cast("string")) for c, p in prefixes.items()})
