"""I-Match fingerprints: hashes of a text's terms of middling frequency, over several randomised subsets of the lexicon.

The lexicon is the words whose inverse document frequency ln(documents / documents with it) lies in a band. Each subset
takes a word by the digits of its SHA-256, with one probability for all subsets of a scale: dense subsets tell short texts
apart, thin ones stay equal where a long text was changed in part. A signature is the hash of a text's distinct terms of a
subset in their order; the fingerprint is all signatures in a row, the first over the whole lexicon. Two fingerprints are
as alike as the share of equal signatures, of the subsets that at least one of the texts has a term of.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A null text is empty; a text without a term of the lexicon has
empty signatures only, and two such fingerprints are equal (likeness 1). Repeated rows count as documents of their own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, narrow, small_batches, tidy
from .shared import free_shuffles, written

#: Hexadecimal digits of a signature, and what stands for none.
DIGITS, EMPTY = 4, "----"
#: Different words that a task counts before it hands them on.
HELD = 1 << 18


@dataclass(frozen=True)
class Settings:
    """common, rare: words in more than one of common documents, or in fewer than one of rare, are outside the band. scales:
    a word is in a subset with probability 1 / scale; subsets: for each scale, in sixteens.

    A word of the lexicon is in one of rare documents at least, so the lexicon has at most rare times the mean number of
    different words of a document. Up to most_terms words go to all tasks; beyond that, terms meet the lexicon in a join.
    """

    common: int = 10
    rare: int = 2000
    scales: tuple[int, ...] = (16, 128, 1024)
    subsets: int = 32
    most_terms: int = 1 << 19

    def __post_init__(self) -> None:
        if self.subsets % 16 or any(s < 1 or 65536 % s for s in self.scales):
            raise ValueError("subsets come in sixteens, and scales must divide 65536")

    @property
    def size(self) -> int:
        return 1 + self.subsets * len(self.scales)


def distinct_terms(text: str | None) -> set[bytes]:
    """Words in UTF-8, whose order is that of their code points; lower() and split() of bytes know ASCII only."""
    return set((text or "").encode("utf-8", "surrogatepass").lower().split())


def memberships(term: bytes, s: Settings) -> tuple[int, ...]:
    """The subsets that a term is in; number 0 has all."""
    found = [0]
    for i, scale in enumerate(s.scales):
        for j in range(s.subsets // 16):
            digits = hashlib.sha256(term + f" {i} {j}".encode()).hexdigest()
            found += [1 + i * s.subsets + 16 * j + k for k in range(16) if int(digits[4 * k : 4 * k + 4], 16) < 65536 // scale]
    return tuple(found)


class Signer:
    """Signatures of sets of terms. Memberships are made once for each term that occurs, at most ``held`` of them."""

    def __init__(self, settings: Settings, held: int = HELD) -> None:
        self.settings, self.held, self.known = settings, held, {}

    def __call__(self, terms: Iterable[bytes]) -> list[str]:
        subsets: list[list[bytes]] = [[] for _ in range(self.settings.size)]
        for term in sorted(terms):
            at = self.known.get(term)
            if at is None:
                if len(self.known) >= self.held:
                    self.known.clear()
                at = self.known[term] = memberships(term, self.settings)
            for k in at:
                subsets[k].append(term)
        return [md5(b" ".join(x)).hexdigest()[:DIGITS] if x else EMPTY for x in subsets]


def alike(a: list[str], b: list[str]) -> float:
    """The share of equal signatures among the subsets of which a or b has a term; 1 if neither has any."""
    equal = [x for x, y in zip(a, b) if x == y]
    met = len(a) - equal.count(EMPTY)
    return (len(equal) - equal.count(EMPTY)) / met if met else 1.0


def likeness(a: str, b: str, settings: Settings = Settings()) -> Column:
    """:func:`alike` of two columns of fingerprints."""
    places = F.sequence(F.lit(0), F.lit(settings.size - 1))
    at = lambda c, i: F.substr(F.col(c), i * DIGITS + 1, F.lit(DIGITS))
    pairs = F.transform(places, lambda i: F.struct(at(a, i).alias("x"), at(b, i).alias("y")))
    met = F.filter(pairs, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY))
    return F.when(F.size(met) == 0, 1.0).otherwise(F.size(F.filter(met, lambda p: p["x"] == p["y"])) / F.size(met))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, n)`` over all rows, terms in UTF-8. Tasks add up what they have, so that little is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(distinct_terms(text))
                if len(counts) >= HELD:
                    yield flush()
        if counts:
            yield flush()

    found = narrow(docs, text=text_col).mapInArrow(tidy(run), "term binary, n long")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """``(term)``: the words of the band, over all rows."""
    total = docs.count()
    inside = (F.col("n") * settings.common <= total) & (F.col("n") * settings.rare >= total)
    return written(document_frequencies(docs, text_col).where(inside).select("term"))


def _chooser(terms: DataFrame, settings: Settings) -> Callable[[], Callable[[set[bytes]], set[bytes]]] | None:
    """What narrows a set of terms to the lexicon in a task, or None if the lexicon is too large to go to all tasks."""
    if terms.count() > settings.most_terms:
        return None
    known = terms.sparkSession.sparkContext.broadcast(frozenset(terms.toArrow().column(0).to_pylist()))
    return lambda: lambda found: found & known.value


def _signed(rows: DataFrame, terms: DataFrame, settings: Settings, columns: dict[str, str]) -> DataFrame:
    """Columns of fingerprints in place of columns of term arrays, by a join of the terms with the lexicon."""
    keyed = written(rows.withColumn("__row", F.monotonically_increasing_id()))
    which = F.explode(F.array(*(F.struct(F.lit(out).alias("out"), F.col(c).alias("terms")) for c, out in columns.items())))
    long = keyed.select("__row", which.alias("w")).select("__row", "w.out", F.explode("w.terms").alias("term"))
    met = long.join(terms, "term").groupBy("__row", "out").agg(F.array_sort(F.collect_list("term")).alias("terms"))  # a document's own

    def make():
        sign = Signer(settings)
        return lambda row: [(row[0], row[1], "".join(sign(row[2])))]

    made = map_rows(met, make, "__row long, out string, fingerprint string").groupBy("__row").pivot("out", list(columns.values())).agg(F.first("fingerprint"))
    none = EMPTY * settings.size
    joined = keyed.join(made, "__row", "left").drop("__row", *columns)
    return joined.fillna(none, list(columns.values()))


def fingerprints(docs: DataFrame, terms: DataFrame | None = None, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of each row; terms is a lexicon, or that of the rows themselves."""
    small_batches(docs.sparkSession)
    terms = lexicon(docs, settings, text_col) if terms is None else terms
    kind = docs.schema[id_col].dataType.simpleString()
    rows = narrow(docs, id=id_col, text=text_col)
    chooser = _chooser(terms, settings)
    if chooser is None:
        sets = map_rows(rows, lambda: lambda row: [(row[0], sorted(distinct_terms(row[1])))], f"`{id_col}` {kind}, __terms array<binary>")
        return _signed(sets, terms, settings, {"__terms": "fingerprint"})

    def make():
        choose, sign = chooser(), Signer(settings)
        return lambda row: [(row[0], "".join(sign(choose(distinct_terms(row[1])))))]

    return map_rows(rows, make, f"`{id_col}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def against_edited(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``: each text against itself
    with its last half taken from the next one in the order of ids (after the last, the first).

    Rows of one id follow each other by a hash of their texts, rows without an id come last. Rows are dealt into ranges of
    the order, so that neighbours meet inside a task that keeps one row at a time; the last row of each range meets the
    first of the next in a table of two rows a range. Rows that are equal throughout are dealt out, too.
    """
    small_batches(docs.sparkSession)
    terms = lexicon(docs, settings, text_col)
    chooser = _chooser(terms, settings)
    free_shuffles(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string"
    if chooser is None:
        payload = "own_terms array<binary>, edited_terms array<binary>, next_terms array<binary>"
    else:
        payload = "fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairing() -> Callable[[object, str, object, str], tuple]:
        choose, sign = (chooser(), Signer(settings)) if chooser else (None, None)
        last: list = [None, None]  # a text is met twice, as next and as own

        def mark(text: str):
            found = distinct_terms(text)
            return sign(choose(found)) if sign else sorted(found)

        def pair(key, text: str, following: str) -> tuple:
            if last[0] != text:
                last[:] = [text, mark(text)]
            own, made = last[1], edited(text, following)
            new = mark(made)
            last[:] = [following, own if following == text else mark(following)]
            head = (key, len(text), hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest())
            return (*head, "".join(own), "".join(new), alike(own, new), alike(own, last[1])) if sign else (*head, own, new, last[1])

        return pair

    order = [F.col("id").asc_nulls_last(), F.col("h"), F.col("deal")]
    rows = narrow(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.withColumn("h", F.xxhash64("text")).withColumn("deal", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = f"{schema}, {payload}, role string, range int, text string"
    target = to_arrow_schema(_parse_datatype_string(full))
    blanks = (None,) * (len(target) - 4)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*made), target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, before, place = pairing(), None, TaskContext.get().partitionId()
        for batch in batches:
            made = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if before is None:
                    made.append((key, *blanks, "first", place, text))
                else:
                    made.append((*pair(*before, text), "done", place, None))
                before = (key, text)
            if made:
                yield batch_of(made)
        if before is not None:
            yield batch_of([(before[0], *blanks, "last", place, before[1])])

    scratch = written(dealt.mapInArrow(tidy(run), full), compression="zstd")
    ranges = sorted(row["range"] for row in scratch.where("role = 'last'").select("range").collect())  # one row a range
    following = docs.sparkSession.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1])), "range int, other int")
    lasts = scratch.where("role = 'last'").select(F.col(f"`{id_col}`").alias("id"), "text", "range")
    firsts = scratch.where("role = 'first'").select(F.col("text").alias("following"), F.col("range").alias("other"))
    borders = lasts.join(following, "range").join(firsts, "other").select("id", "text", "following")
    bordering = map_rows(borders, lambda: (lambda pair: lambda row: [pair(*row)])(pairing()), f"{schema}, {payload}")
    whole = scratch.where("role = 'done'").drop("role", "range", "text").unionByName(bordering)
    if chooser is not None:
        return whole
    signed = _signed(whole, terms, settings, {"own_terms": "fingerprint", "edited_terms": "edited_fingerprint", "next_terms": "next_fingerprint"})
    near = lambda other: likeness("fingerprint", other, settings)
    return signed.withColumns({"near_edited": near("edited_fingerprint"), "near_next": near("next_fingerprint")}).drop("next_fingerprint")
