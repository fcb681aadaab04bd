"""N-gram Jaccard join with adaptive multi-match prefixes.

Each text is the set of its word shingles. Equal sets are one entity from the start,
so that copies are never paired. A global order of shingles (frequency class, then
fingerprint) puts widespread shingles last. If two sets link, the first l shingles
that they share lie in the first ``n - need(n) + l`` of each, for any l: a longer
prefix may therefore ask for more shared shingles before a pair is verified.

1. Frequency classes: each task counts shingles in 2**20 buckets and reports the
   buckets far above its mean; the sums make a table of one byte a bucket.
2. Each entity takes the l of least estimated cost by that table, where it is read:
   a longer prefix costs rows, and leaves fewer candidates. Only that prefix is shuffled,
   ``(shingle, entity)`` by shingle; shingles of one entity end there. Shingles of the
   highest classes are known to be shared, and are dealt by entity instead.
3. Star rounds: entities are verified against one head of the lists they share most;
   links make components. Further rounds, over the contracted components and with other
   heads, follow while they merge much and many pairs across components are left.
4. All remaining pairs, those across components only, whose first shared shingle leaves
   room for enough overlap, are made. Two entities must share as many prefix shingles as
   the smaller l of both asks for; then they are verified.

Verification compares whole shingle sets, made again from the texts; texts of
entities in no pair are dropped before the shuffle by a bitmap.
No pair is cut off anywhere: the classes are exact up to equal 64-bit fingerprints of
different shingles or sets. Links inside a component that is known are not all tested,
so that a group of near copies costs its size; the result is classes, not a count of links.

Texts that are null or without words have the empty set, link with nothing and are
components of one. Rows are told apart by id and text, so repeated rows of one id act as
copies and different texts of one id as texts of their own. Rows with a null id link like
others; a component without any id has a null component_id. Further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, small_batches, tidy
from .shared import components, drop, likely_rows, row_key, without, written
from .shingles import in_common, shingle_set

_PLACE_BITS, _L_BITS = 27, 5


@dataclass(frozen=True)
class Settings:
    """``pair_cost``: verifying a candidate, in rows of a prefix. ``rare_others``: other entities in the list of a shingle of the
    lowest class. ``wide_class``: from this class on, all shingles of a bucket are taken as shared. Star rounds go on, ``rounds`` at most,
    while more than ``pairs_a_row`` pairs across components for each prefix row are left."""

    shingle: int = 5
    percent: int = 80
    bucket_bits: int = 20
    pair_cost: float = 8.0
    rare_others: float = 0.02
    wide_class: int = 4
    rounds: int = 4
    pairs_a_row: float = 4.0

    def need(self, n):
        """The least overlap with any partner of a set of n."""
        return -(-self.percent * n // 100)

    def longest_l(self, n: int) -> int:
        """The most shared prefix shingles that are asked for: a quarter of the plain prefix, and some for short texts."""
        return min(self.need(n), 3 + (n - self.need(n)) // 4, (1 << _L_BITS) - 1)

    def linked(self, both: int, n: int, m: int) -> bool:
        return 100 * both >= self.percent * (n + m - both) and both > 0


def _entity(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _survey(rows: DataFrame, s: Settings) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``(id, key, entity, n)`` of each row; a byte for each bucket of shingles, its class: 0, or the logarithm of how far it is
    above the mean; and the list size that each class stands for."""
    size, kind = 1 << s.bucket_bits, rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, kept = np.zeros(size, np.int32), 0, None

        def table(ids, keys, *columns):
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([ids, keys, *(pa.array(c, t) for c, t in zip(columns, types))], names=["id", "key", "entity", "n", "bucket", "count"])

        for batch in batches:
            sets = [shingle_set(text, s.shingle) for text in batch.column(1).to_pylist()]
            tokens = np.concatenate([*sets, np.empty(0, np.uint64)])
            np.add.at(counts, (tokens >> np.uint64(64 - s.bucket_bits)).astype(np.int64), 1)
            total, kept = total + len(tokens), batch.column(0).type
            none = [None] * len(sets)
            yield table(batch.column(0), batch.column(2), list(map(_entity, sets)), list(map(len, sets)), none, none)
        if total:
            hot = np.flatnonzero(counts > 6 + 3 * total / size)
            none = [None] * (len(hot) + 1)
            yield table(pa.array(none, kept), pa.array(none, pa.int64()), none, none, np.append(hot, -1).tolist(), np.append(counts[hot], total).tolist())

    both = written(rows.mapInArrow(tidy(count), f"id {kind}, key long, entity long, n int, bucket long, count long"))
    found = both.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("n")).collect()
    total = next((r.n for r in found if r.bucket < 0), 0)
    table = np.zeros(size, np.uint8)
    for r in found:  # fewer than a third of the buckets of a task can be so far above its mean
        if r.bucket >= 0:
            table[r.bucket] = min(31, 1 + int(np.log2(max(1.0, r.n / (3 * total / size + 1)))))
    others = np.where(np.arange(32) > 0, np.exp2(np.arange(32) - 1) * (3 * total / size + 1), s.rare_others)
    return both.where("bucket IS NULL").select("id", "key", "entity", "n"), table, others


def chosen_l(n: int, others: np.ndarray, s: Settings) -> int:
    """The l of least cost for n shingles, of which the first have lists of so many others: a row of each prefix shingle, its
    list, and the candidates, who share l or more of the lists."""
    most = s.longest_l(n)
    ends = n - s.need(n) + np.arange(1, most + 1)
    load = np.cumsum(others[: ends[-1]])[ends - 1]
    return 1 + int(np.argmin(ends + load * (1 + s.pair_cost / np.arange(1, most + 1))))


def _prefix_rows(rows: DataFrame, table: np.ndarray, others: np.ndarray, s: Settings) -> DataFrame:
    """``(deal, token, entity, info)`` for each shingle of the prefix of each different set of a task; info is n, place and l.

    deal is the token, or a hash of token and entity where the class alone says that the token is shared.
    """
    classes = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, ids, infos, wide = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, s.shingle)
                n, entity = len(found), _entity(found)
                if not n or entity in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(entity)
                kind = classes.value[(found >> np.uint64(64 - s.bucket_bits)).astype(np.int64)]
                order = np.argsort((kind.astype(np.uint64) << np.uint64(59)) | (found >> np.uint64(5)), kind="stable")[: n - s.need(n) + s.longest_l(n)]
                l = chosen_l(n, others[kind[order]], s)  # noqa: E741
                order = order[: n - s.need(n) + l]
                tokens.append(found[order].view(np.int64))
                wide.append(kind[order] >= s.wide_class)
                ids.append(np.full(len(order), entity, np.int64))
                infos.append((n << (_PLACE_BITS + _L_BITS)) | (np.arange(len(order), dtype=np.int64) << _L_BITS) | l)
            if tokens:
                token, entity, info, known = map(np.concatenate, (tokens, ids, infos, wide))
                deal = np.where(known, token ^ (entity * np.int64(0x2545F4914F6CDD1D)), token)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, token, entity, info, known)], names=["deal", "token", "entity", "info", "wide"])

    return rows.mapInArrow(tidy(run), "deal long, token long, entity long, info long, wide boolean")


def _prefixes(rows: DataFrame, table: np.ndarray, others: np.ndarray, s: Settings) -> DataFrame:
    """``(token, entity, n, l, place, lonely)``: prefix rows of shingles that two entities or more may share; lonely is how many
    shingles of its prefix the entity shares with nobody's prefix. Entities without a partner are gone."""
    dealt = _prefix_rows(rows, table, others, s).repartition("deal").distinct()  # copies in different tasks give equal rows
    met = dealt.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("deal"))).where("met > 1 OR wide")
    info = lambda shift, bits: F.shiftright("info", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    met = met.select("token", "entity", info(_PLACE_BITS + _L_BITS, 31).alias("n"), info(0, _L_BITS).alias("l"), info(_L_BITS, _PLACE_BITS).alias("place"))
    own = Window.partitionBy("entity")
    spare = F.floor(F.col("n") * (100 - s.percent) / 100).cast("int")  # n - need(n)
    counted = met.withColumn("lonely", spare + F.col("l") - F.count(F.lit(1)).over(own)).withColumn("first", F.min("place").over(own))
    return written(counted.where(F.col("first") <= spare).drop("first"))


def _room(overlap, n, m, s: Settings):
    """An overlap that can't be larger is enough."""
    return overlap * (100 + s.percent) >= (n + m) * s.percent


def _stars(rows: DataFrame, heads: str, s: Settings) -> DataFrame:
    """Pairs of each entity with the head with which it shares most lists, of those in another group."""
    head = rows.groupBy("token").agg(F.min(F.expr(f"struct({heads}, entity, n, group)")).alias("head")).select("token", *(F.col(f"head.{c}").alias(f"head_{c}") for c in ("entity", "n", "group")))
    paired = rows.join(head, "token").where("head_group <> group").where(_room(F.least("n", "head_n"), F.col("n"), F.col("head_n"), s))
    counted = paired.groupBy("entity", "n", "l", "head_entity").agg(F.count(F.lit(1)).alias("shared"))
    fits = counted.where(F.col("shared") * 4 >= F.col("n") * (100 - s.percent) / 100)
    best = fits.groupBy("entity").agg(F.max(F.struct("shared", "head_entity")).alias("best"))
    return best.select(F.col("entity").alias("a"), F.col("best.head_entity").alias("b"))


def _grouped(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Prefix rows with the group of the entity, of the lists that hold two groups or more."""
    rows = prefixes.join(labels.withColumnRenamed("id", "entity"), "entity", "left").withColumn("group", F.coalesce("component", "entity")).drop("component")
    mixed = rows.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("token")
    return written(rows.join(mixed, "token", "left_semi"))


def _candidates(rows: DataFrame, s: Settings) -> DataFrame:
    """Pairs ``(a, b, l)`` across groups that may link if a shingle of a list is the first that they share; a row for each such list."""
    a, b = rows.alias("a"), rows.alias("b")
    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.group") != F.col("b.group")) & (F.col("a.entity") < F.col("b.entity")) & _room(left, F.col("a.n"), F.col("b.n"), s))
    return pairs.select(F.col("a.entity").alias("a"), F.col("b.entity").alias("b"), F.least("a.l", "b.l").alias("l"))


def _pairs_a_row(rows: DataFrame, s: Settings) -> float:
    """How many candidates there are for each row, estimated from a 64th of the lists; it only settles whether to contract further."""
    few = rows.where(F.pmod(F.xxhash64("token"), F.lit(64)) == 0)
    return _candidates(few, s).count() / max(1, few.count())


def _across(rows: DataFrame, s: Settings) -> DataFrame:
    """The candidates that share as many prefix shingles as the smaller l of both asks for."""
    pairs = written(_candidates(rows, s).distinct())
    several = pairs.where("l > 1")
    ends = several.select(F.col("a").alias("entity")).union(several.select(F.col("b").alias("entity"))).distinct()
    # written, as both ends read them: else the rows may be joined to the ends twice, on larger tables only
    lists = written(rows.join(ends, "entity", "left_semi").groupBy("entity").agg(F.collect_list("token").alias("tokens")))
    met = several.join(lists.select(F.col("entity").alias("a"), F.col("tokens").alias("of_a")), "a").join(lists.select(F.col("entity").alias("b"), F.col("tokens").alias("of_b")), "b")
    return pairs.where("l = 1").select("a", "b").unionByName(met.where(F.size(F.array_intersect("of_a", "of_b")) >= F.col("l")).select("a", "b"))


def _verified(pairs: DataFrame, rows: DataFrame, first: DataFrame, s: Settings) -> DataFrame:
    """The pairs that link, by their whole shingle sets."""
    key = lambda end: first.select(F.col("entity").alias(end), F.col("key").alias(f"key_{end}"))
    pairs = written(pairs.join(key("a"), "a").join(key("b"), "b"))
    keys = written(pairs.select(F.col("key_a").alias("key")).union(pairs.select(F.col("key_b").alias("key"))).distinct())
    likely = likely_rows(rows.select("key", "text"), keys, "key").join(keys, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))  # equal keys, equal texts
    text = lambda end: likely.select(F.col("key").alias(f"key_{end}"), F.col("text").alias(f"text_{end}"))
    joined = pairs.join(text("b"), "key_b").join(text("a"), "key_a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = {}, 0  # sets of entities met lately, of bounded total size

        def made(entity, text):
            nonlocal known, held
            if (found := known.get(entity)) is None:
                if held > 1_000_000:
                    known, held = {}, 0
                found = known[entity] = shingle_set(text.as_py(), s.shingle)
                held += len(found) + 100
            return found

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            mask = []
            for x, y, ta, tb in zip(a, b, batch.column(2), batch.column(3)):
                one, other = made(x, ta), made(y, tb)
                mask.append(s.linked(in_common(one, other), len(one), len(other)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    links = written(joined.select("a", "b", "text_a", "text_b").mapInArrow(tidy(verify), "a long, b long"))
    drop(pairs, keys)
    return links


def _labelled(rows: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """``(id, key, entity, n)`` of each row, and of each entity ``(entity, component, component_id, stays)``.

    stays is the key of the row that stands for the component: that of the smallest id.
    """
    members, table, others = _survey(rows, s)
    filled = members.where("n > 0")
    first = filled.groupBy("entity").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "key")).alias("least")).select("entity", "least", F.col("least.key").alias("key"))
    first = written(first)
    prefixes = _prefixes(rows, table, others, s)
    # the head of a list is first the entity with the fewest shingles of its own: of near copies, the text they were made from, if it is there
    links = _verified(_stars(prefixes.withColumn("group", F.col("entity")), "lonely", s), rows, first, s)
    labels = components(links)
    lists = _grouped(prefixes, labels)
    before = first.count() - labels.where("id <> component").count()
    for turn in range(1, s.rounds):
        if _pairs_a_row(lists, s) <= s.pairs_a_row:
            break
        more = _verified(_stars(lists, f"xxhash64(entity, token, {turn})", s), rows, first, s)
        links, labels = (merged := written(links.union(more))), components(merged)
        drop(lists)
        lists = _grouped(prefixes, labels)
        left = first.count() - labels.where("id <> component").count()
        if before - left < before // 1000 + 10:
            break
        before = left
    drop(prefixes)
    links = written(links.union(_verified(_across(lists, s), rows, first, s)))
    labelled = first.join(components(links).withColumnRenamed("id", "entity"), "entity", "left")
    labelled = labelled.select("entity", F.coalesce("component", "entity").alias("component"), "least")
    smallest = labelled.groupBy("component").agg(F.min("least").alias("least")).select("component", F.col("least.id").alias("component_id"), F.col("least.key").alias("stays"))
    return members, labelled.join(smallest, "component").select("entity", "component", "component_id", "stays")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return narrow(docs, id=id_col, text=text_col).withColumn("key", row_key("id", "text"))


def classes(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` of each row; component_id is the smallest id that links lead to, the row's own included."""
    members, found = _labelled(_rows(docs, id_col, text_col), settings)
    found = found.drop("component", "stays")
    joined = members.join(found, (members.entity == found.entity) & (members.n > 0), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one row of each component: of the smallest id; rows without words stay."""
    members, found = _labelled(_rows(docs, id_col, text_col), settings)
    seen = written(members.where("n > 0").join(found.select("entity", "stays"), "entity").select(F.col("key").alias("__key"), (F.col("key") == F.col("stays")).alias("stays")))
    rows = without(docs.withColumn("__key", row_key(id_col, text_col)), seen.where("NOT stays").select("__key"), "__key")
    again = written(seen.where("stays").groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key"))
    if again.limit(1).count():  # rows of one id and text: copies in one task are made one before they are shuffled
        columns = [F.col(f"`{c}`") for c in docs.columns]
        alike = likely_rows(rows, again, "__key").join(again, "__key", "left_semi").groupBy("__key").agg(F.first(F.struct(*columns)).alias("row"))
        rows = without(rows, again, "__key").select(*columns).unionByName(alike.select("row.*"))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
