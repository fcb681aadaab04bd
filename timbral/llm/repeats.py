"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms.

A string of ``length`` bytes that starts at two places or more is a repeat. To find
all of them without sorting every suffix of a corpus in one place:

1. Each string of that length has an anchor, the least fingerprint of 16 bytes in its
   first half, and the anchor starts a core that the string holds to its end. Equal
   strings have equal cores. A core that is met once can't be part of a repeat.
2. The strings that share an anchor are a context of a place. Equal contexts, as in
   copies, are counted and repeat as a whole; a core with two or more different
   contexts needs to be looked into.
3. These contexts meet by core. A task reads them in batches, each batch as shards.
   A string is written as four symbols, fingerprints of its quarters. For each shard
   the transform of its strings is built, symbol by symbol from the right. Two
   transforms are merged by refining their interleave: each round distributes the
   interleave stably by the next preceding symbol and splits blocks of equal prefixes,
   so that after four rounds the blocks are the repeated intervals. Suffixes are not
   sorted again.
4. Repeated intervals go back to all places of their contexts, and the union of what
   they cover is removed.

A core with more than ``split_from`` different contexts, as at the edge of a passage that very
many texts share, would make one task too large. Its contexts are counted string by string
instead, with the same result: runs of 16 starts whose common bytes no other context has are
left out, of the others each start is counted by the fingerprint of its string, a grouped count
that Spark adds up on both sides of the shuffle. So no task holds all contexts of a core.

Null and empty texts have no bytes. Rows are told apart by id and text: repeated rows are
copies of each other and repeat, different texts of one id are texts of their own, and
rows with a null id take part like others. A text shorter than the length is left as it
is. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, small_batches, tidy
from .shared import drop, likely_rows, row_key, written
from .shingles import mix, word_hashes

_FACTOR = 0xD6E8FEB86659FD93
_BLOCK = 1 << 15


@dataclass(frozen=True)
class Settings:
    length: int = 400
    split_from: int = 500
    batch_bytes: int = 1 << 20
    shards: int = 2

    @property
    def half(self) -> int:
        return self.length // 2

    @property
    def core(self) -> int:
        return self.length - self.half + 1


def _grams(data: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """Fingerprints of all substrings of each of the widths, powers of two, by doubling."""
    h, factor, width, out = data.astype(np.uint64) + np.uint64(1), _FACTOR, 1, {}
    while True:
        if width in widths:
            out[width] = h
        if width >= max(widths):
            return out
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width


def _wide(data: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all substrings of any width: of two overlapping powers of two."""
    power = 1 << (width.bit_length() - 1)
    h = _grams(data, [power])[power]
    n = len(data) - width + 1
    return mix(h[:n] * np.uint64(0x9FB21C651E98DF25) + h[width - power : width - power + n])


def anchors(text: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of the text: core fingerprint, position, and the first and last start of its strings."""
    parts, data = [], np.frombuffer(text, np.uint8)
    total = len(data) - s.length + 1
    power = 1 << (s.core.bit_length() - 1)
    for start in range(0, max(total, 0), _BLOCK):
        n = min(_BLOCK, total - start)
        block = data[start : start + n + s.length - 1]
        h = _grams(block, [16, power])
        places = n + s.half - 1
        low = (mix(h[16][:places]) & ~np.uint64((1 << 17) - 1)) | np.arange(places, dtype=np.uint64)
        width = 1
        while 2 * width <= s.half:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < s.half:
            low = np.minimum(low[: n], low[s.half - width : s.half - width + n])
        at = (low[:n] & np.uint64((1 << 17) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        place = at[first]
        core = mix(h[power][place] * np.uint64(0x9FB21C651E98DF25) + h[power][place + s.core - power])
        parts.append((core, place + start, first + start, np.append(first[1:], n) - 1 + start))
    if not parts:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    return tuple(map(np.concatenate, zip(*parts)))


class Transform:
    """The transform of a set of strings of equally many symbols, a layer for each number of symbols still to come.

    Layer k lists the suffixes of k symbols in order; ``before[k]`` are the symbols that
    precede them, ``heads`` the single symbols of layer 1, ``order`` the strings in order.
    """

    def __init__(self, symbols: list[np.ndarray]):
        order = np.argsort(symbols[-1], kind="stable")
        self.heads, self.before = symbols[-1][order], []
        for preceding in reversed(symbols[:-1]):
            own = preceding[order]
            self.before.append(own)
            order = order[np.argsort(own, kind="stable")]
        self.order = order


def merge(a: Transform, b: Transform) -> tuple[Transform, np.ndarray]:
    """The merged transform (strings of b are numbered behind those of a), and the block number of each string in order."""
    out = object.__new__(Transform)
    at = np.searchsorted(a.heads, b.heads, side="right") + np.arange(len(b.heads))
    z = np.zeros(len(a.heads) + len(b.heads), bool)
    z[at] = True

    def woven(x, y):
        made = np.empty(len(z), x.dtype)
        made[~z], made[z] = x, y
        return made

    out.heads = woven(a.heads, b.heads)
    block = np.cumsum(np.diff(out.heads, prepend=out.heads[:1]) != 0)
    out.before = []
    for own_a, own_b in zip(a.before, b.before):
        own = woven(own_a, own_b)
        out.before.append(own)
        to = np.argsort(own, kind="stable")  # a stable distribution by one symbol
        z, own, block = z[to], own[to], block[to]
        block = np.cumsum((np.diff(own, prepend=own[:1]) != 0) | (np.diff(block, prepend=block[:1]) != 0))
    out.order = woven(a.order, b.order + len(a.order))
    return out, block


def repeated_starts(contexts: list[bytes], s: Settings) -> list[np.ndarray]:
    """Of each context (all different), which of its strings occur in another one, too."""
    quarter = -(-s.length // 4)
    places = [0, quarter, 2 * quarter, s.length - quarter]
    counts = [max(0, len(c) - s.length + 1) for c in contexts]
    shards, step = [], -(-len(contexts) // s.shards)
    for i in range(0, len(contexts), step):
        symbols: list[list[np.ndarray]] = [[], [], [], []]
        data = np.frombuffer(b"".join(contexts[i : i + step]), np.uint8)
        if len(data) < s.length:
            continue
        h, offset = _wide(data, quarter), 0
        for context, n in zip(contexts[i : i + step], counts[i : i + step]):
            for k, place in enumerate(places):
                symbols[k].append(h[offset + place : offset + place + n])
            offset += len(context)
        shards.append(Transform([np.concatenate(x) for x in symbols]))
    blocks = None
    while len(shards) > 1:
        merged = [merge(*shards[i : i + 2]) if i + 1 < len(shards) else (shards[i], None) for i in range(0, len(shards), 2)]
        shards, blocks = [t for t, _ in merged], merged[0][1]
    total = sum(counts)
    hit = np.zeros(total, bool)
    if shards and total:
        whole = shards[0]
        if blocks is None:  # one shard only: merged with nothing
            whole, blocks = merge(whole, Transform([np.empty(0, np.uint64)] * 4))
        twice = np.bincount(blocks) > 1
        hit[whole.order] = twice[blocks]
    return np.split(hit, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _table(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _places(rows: DataFrame, s: Settings, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, many = [], []
            for text in batch.column(1).to_pylist():
                own = anchors((text or "").encode("utf-8", "surrogatepass"), s)
                found.append(own)
                many.append(len(own[0]))
            if sum(many):
                core, place, low, high = map(np.concatenate, zip(*found))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(many)), many)))
                yield _table("id core place low high", ids, core.view(np.int64), place.astype(np.int32), low.astype(np.int32), high.astype(np.int32))

    return rows.mapInArrow(tidy(run), f"id {kind}, core long, place int, low int, high int")


def _on_contexts(places: DataFrame, rows: DataFrame, names: str, types: tuple, make, s: Settings) -> DataFrame:
    """What make(text, core, place, low, high, id) yields for each place, next to the text that it is in."""
    columns = ["core", "place", "low", "high"]
    listed = places.groupBy("id").agg(F.collect_set(F.struct(*columns)).alias("found"))
    joined = listed.join(likely_rows(rows, places.select("id").distinct()), "id").select("id", "text", *(F.col(f"found.{c}").alias(c) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                out = []
                for key, text, *found in zip(*(c.to_pylist() for c in batch.slice(i, 50).columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    for core, place, low, high in zip(*found):
                        out += make(data, core, place, low, high, key)
                if out:
                    yield _table(names, *(pa.array(c, t) for c, t in zip(zip(*out), types)))

    spark = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return joined.mapInArrow(tidy(run), ", ".join(f"{n} {spark[t]}" for n, t in zip(names.split(), types)))


def _mark(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


def _marked(places: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Each place with the fingerprint of its context."""
    make = lambda text, core, place, low, high, key: [(key, core, place, low, high, _mark(text[low : high + s.length]))]
    return _on_contexts(places, rows, "id core place low high mark", (pa.int64(),) * 2 + (pa.int32(),) * 3 + (pa.int64(),), make, s)


def _merged(contexts: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Runs of repeated starts ``(core, mark, before, after, first, last)`` of contexts that meet by core, relative to their first start."""
    make = lambda text, core, place, low, high, key: [(core, _mark(c := text[low : high + s.length]), place - low, place - high, c)]
    made = _on_contexts(contexts, rows, "core mark before after context", (pa.int64(),) * 2 + (pa.int32(),) * 2 + (pa.binary(),), make, s)
    dealt = made.repartition("core").sortWithinPartitions("core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            out = []
            for row, flags in zip(held, repeated_starts([r[4] for r in held], s)):
                out += [(*row[:4], first, last) for first, last in _runs(flags)]
            return _table("core mark before after first last", *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 2 + (pa.int32(),) * 4))) if out else None

        held, used, key = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if used >= s.batch_bytes and row[0] != key:
                    if (done := flush(held)) is not None:
                        yield done
                    held, used = [], 0
                held.append(row)
                used, key = used + len(row[4]), row[0]
        if held and (done := flush(held)) is not None:
            yield done

    return dealt.mapInArrow(tidy(run), "core long, mark long, before int, after int, first int, last int")


def _counted(contexts: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """The same of contexts of very common cores: their starts are counted by the fingerprint of their strings."""

    def pieces(low, high, place):
        for j in range((place - high) // 16, (place - low) // 16 + 1):  # runs of 16 starts, equally cut in all contexts of the core
            yield place - 16 * j - 15, max(low, place - 16 * j - 15), min(high, place - 16 * j)

    inner = lambda text, core, at: _mark(text[at + 15 : at + s.length], core & 0xFFFF)
    parts = lambda text, core, place, low, high, key: [(key, inner(text, core, at), core, place, low, high, a, b) for at, a, b in pieces(low, high, place)]
    wide = (pa.int64(),) * 3 + (pa.int32(),) * 5
    cut = written(_on_contexts(contexts, rows, "id inner core place low high a b", wide, parts, s))
    alike = cut.groupBy("inner").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("inner")
    left = cut.join(alike, "inner", "left_semi").select("id", F.col("inner").alias("core"), "place", F.col("a").alias("low"), F.col("b").alias("high"), F.struct("core", "low", "high").alias("whole"))
    left = written(left)
    strings = lambda text, core, place, low, high, key: [(key, core, place, i, _mark(text[i : i + s.length])) for i in range(low, high + 1)]
    starts = written(_on_contexts(left, rows, "id core place start string", (pa.int64(),) * 2 + (pa.int32(),) * 2 + (pa.int64(),), strings, s))
    twice = starts.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    hit = starts.join(twice, "string", "left_semi").select("id", "core", "place", "start")
    owner = left.select("id", "core", "place", F.col("whole.core").alias("whole"), F.col("whole.low").alias("low"), F.col("whole.high").alias("high"), F.col("low").alias("a"))
    found = hit.join(owner, ["id", "core", "place"]).where("start >= low AND start <= high AND start >= a AND start < a + 16")
    return found.select("id", F.col("whole").alias("core"), "place", "low", "high", (F.col("start") - F.col("low")).alias("first"), (F.col("start") - F.col("low")).alias("last"))


def _intervals(docs_rows: DataFrame, s: Settings, kind: str) -> DataFrame:
    """``(id, spans)``: repeated starts of each row that has any, as (first, last) pairs. Equal ids must have equal texts."""
    everywhere = written(_places(docs_rows, s, kind))
    # a table of its own, so that the join below is dealt anew and a core with very many places can be split
    cores = written(everywhere.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    places = written(everywhere.join(cores, "core", "left_semi"))
    drop(everywhere)
    marked = written(_marked(places, docs_rows, s))
    drop(places)
    before, after = (F.col("place") - F.col("low")).alias("before"), (F.col("place") - F.col("high")).alias("after")
    own = written(marked.groupBy("core", "mark", before, after).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place", "low", "high")).alias("owner")))
    mixed = own.groupBy("core").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    # every context of such a core is a partner, but only those met once are in doubt
    doubtful = own.where("n = 1").select("core").distinct()
    owners = written(own.join(mixed, "core").join(doubtful, "core", "left_semi").select("owner.*", "core", "mark", "many"))
    context = ["core", "mark", "before", "after"]
    runs = _merged(owners.where(F.col("many") <= s.split_from), docs_rows, s)
    large = owners.where(F.col("many") > s.split_from)
    if large.limit(1).count():
        counted = _counted(large, docs_rows, s).join(large.select("id", "core", "place", "low", "high", "mark"), ["id", "core", "place", "low", "high"])
        runs = runs.unionByName(counted.select("core", "mark", before, after, "first", "last"))
    whole = own.where("n > 1").select(*context, F.lit(0).alias("first"), (F.col("before") - F.col("after")).alias("last"))
    once = own.where("n = 1").select(*context)
    found = written(whole.unionByName(runs.join(once, context, "left_semi")))
    hits = marked.select("id", "low", "core", "mark", before, after).join(found, context)
    spans = written(hits.groupBy("id").agg(F.collect_set(F.struct((F.col("low") + F.col("first")).alias("first"), (F.col("low") + F.col("last")).alias("last"))).alias("spans")))
    drop(cores, marked, own, owners, found)
    return spans


def keep(text: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left, and the maximal removed runs [begin, end)."""
    removed: list[list[int]] = []
    for first, last in sorted(spans):
        if removed and first <= removed[-1][1]:
            removed[-1][1] = max(removed[-1][1], last + length)
        else:
            removed.append([first, last + length])
    parts, at = [], 0
    for begin, end in removed:
        parts.append(text[at:begin])
        at = end
    parts.append(text[at:])
    return b"".join(parts), [tuple(r) for r in removed]


def passage_cores(text: str | None, words: int) -> np.ndarray:
    """Fingerprints of the strings of words that stand for passages: each passage of ``words`` words holds one, chosen by the
    passage alone (the least 4-gram among its first 2/5 of starts), of the 3/5 of its words that follow."""
    h = word_hashes(text)
    total, wide = len(h) - words + 1, 2 * words // 5
    if total <= 0:
        return np.empty(0, np.uint64)
    core = words - wide + 1
    places = total + wide - 1
    low = (mix(_grams(h, [4])[4][:places]) & ~np.uint64((1 << 28) - 1)) | np.arange(places, dtype=np.uint64)
    width = 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:total], low[wide - width : wide - width + total])
    return np.unique(_wide(h, core)[np.unique(low & np.uint64((1 << 28) - 1)).astype(np.int64)])


def passages(rows: DataFrame, words: int = 50) -> DataFrame:
    """``(key, n_passages)`` of rows ``(key, text)``: how many of its passage strings another key has, too, if any.

    Every passage of so many words (A-Z lower-cased) that two texts share counts, however few its bytes are; no
    string of fewer than 3/5 of them does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [passage_cores(text, words) for text in batch.column(1).to_pylist()]
            many = list(map(len, found))
            if sum(many):
                yield _table("key core", batch.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))), np.concatenate(found).view(np.int64))

    cores = written(rows.select("key", "text").mapInArrow(tidy(run), "key long, core long"))
    shared = written(cores.groupBy("core").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("core"))
    counted = written(cores.join(shared, "core", "left_semi").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_passages")))
    drop(cores, shared)
    return counted


def remove(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", digests: bool = False, passage_words: int | None = None) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans)`` of each row, with the ``removed`` runs and the ``kept`` bytes, or with their digest.

    passage_words adds ``n_passages``: passages of so many words that other rows hold, too, which are reported
    whether or not they have the bytes to be removed; see :func:`passages`.
    """
    small_batches(docs.sparkSession)
    rows = narrow(docs, id=id_col, text=text_col).withColumn("key", row_key("id", "text"))
    kind = rows.schema["id"].dataType.simpleString()
    spans = _intervals(narrow(rows, id="key", text="text"), settings, "bigint").withColumnRenamed("id", "key")
    if passage_words:
        spans = written(spans.join(passages(rows, passage_words), "key", "full_outer"))
    else:
        spans = spans.withColumn("n_passages", F.lit(0).cast("long"))
    more = "n_passages" if passage_words else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, removed = keep(data, [(f["first"], f["last"]) for f in found or ()], settings.length)
                line = (len(data), len(data) - len(kept), len(removed))
                out.append((*line, hashlib.sha256(kept).hexdigest()) if digests else (*line, [{"begin": a, "end": b} for a, b in removed], kept))
            types = (pa.int64(),) * 3 + ((pa.string(),) if digests else (pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()))
            names = "id n_bytes n_removed n_spans " + ("kept_sha256" if digests else "removed kept")
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield _table(names + f" {more}" * bool(more), batch.column(0), *columns, *[batch.column(3).fill_null(0)] * bool(more))

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "removed array<struct<begin: long, end: long>>, kept binary") + ", n_passages long" * bool(more)
    # Rows without repeats stay where they are read; only those with some are shuffled to meet their runs.
    touched = spans.select("key")
    likely = likely_rows(rows, touched, "key")
    changed = likely.join(spans, "key", "left").select("id", "text", "spans", "n_passages")
    rest = likely_rows(rows, touched, "key", unlikely=True).select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(0).cast("long").alias("n_passages"))
    return changed.mapInArrow(tidy(run), schema).unionByName(rest.mapInArrow(tidy(run), schema)).withColumnRenamed("id", id_col)


def on_characters(data: bytes, removed: list[tuple[int, int]]) -> str:
    """What is left of the text if the removed runs shrink to whole characters."""
    parts, at = [], 0
    for begin, end in removed:
        while begin < end and data[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:begin])
        at = end
    parts.append(data[at:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with all their columns, without repeats in the text; those of which no word is left go."""
    small_batches(docs.sparkSession)
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    spans = _intervals(narrow(keyed, id="__key", text=text_col), settings, "bigint").select(F.col("id").alias("__key"), F.col("spans").alias("__spans"))
    touched = likely_rows(keyed, spans.select("__key"), "__key").join(spans, "__key", "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__spans")
    at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                removed = keep(data, [(f["first"], f["last"]) for f in found or ()], settings.length)[1]
                texts.append(on_characters(data, removed) if removed else text)
            left = [bool(t and t.strip()) or not f for t, f in zip(texts, batch.column(batch.num_columns - 1).to_pylist())]
            mask = pa.array(left, pa.bool_())
            columns = [c.filter(mask) for c in batch.columns[:-1]]
            texts = [t for t, l in zip(texts, left) if l]
            columns[at] = pa.array(texts, batch.schema[at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return likely_rows(keyed, spans.select("__key"), "__key", unlikely=True).drop("__key").unionByName(touched.mapInArrow(tidy(run), docs.schema))
