"""Compact codes of vectors: equal consecutive parts, each named by its nearest entry of that part's codebook.

All arithmetic is on integers, so that every partitioning gives the same codes: a component x is floor(scale * x).
The nearest entry is found in a vantage-point tree over the entries of a part position. Each subtree has bounds of its
entries' distances from the vantage point, rounded so that they never exclude one of them; a subtree is visited unless
its least possible distance is above the best one so far, so that ties are seen, too; and what decides is the exact
squared distance, then the lower index.

Rows: those whose vector is null, holds a null or a non-finite component, can't be cut, or has another length than the
kept vector of the smallest id, go. Integers saturate at 2**27 either way, so that distances fit 64 bits. Repeated rows
count as often as they stand there; equal ids are ordered by their vectors, null ids come last. An empty table gives
empty codebooks and no codes. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, tidy
from .shared import written

#: Integers beyond this saturate.
LARGEST = 1 << 27
#: Vectors that are searched at once in a task.
BLOCK = 4096
#: Label totals up to this number go to all tasks (16 bytes each); more are joined by salted keys.
FEW_LABELS = 1 << 16
SALTS = 64


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def floor_root(x: np.ndarray) -> np.ndarray:
    """Largest integers whose squares are not above x."""
    r = np.sqrt(x.astype(float)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def ceil_root(x: np.ndarray) -> np.ndarray:
    r = floor_root(x)
    return r + (r * r < x)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


@dataclass
class _Node:
    entry: int  # the vantage point
    children: list[tuple[int, int, _Node]] = field(default_factory=list)  # least and largest distance from it, rounded outwards
    middle: int = 0  # squared distance up to which entries are in the first child


def vantage_tree(book: np.ndarray, members: np.ndarray | None = None) -> _Node:
    """A tree over the entries; the vantage point is the one farthest from the first."""
    members = np.arange(len(book)) if members is None else members
    at = int(np.argmax(squared(book[members], book[members[0]]))) if len(members) > 1 else 0
    node = _Node(int(members[at]))
    rest = np.delete(members, at)
    if len(rest):
        far = squared(book[rest], book[node.entry])
        node.middle = int(np.sort(far)[(len(far) - 1) // 2])
        for some in (far <= node.middle, far > node.middle):
            if some.any():
                node.children.append((int(floor_root(far[some]).min()), int(ceil_root(far[some]).max()), vantage_tree(book, rest[some])))
    return node


def nearest(tree: _Node, book: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row of q, the lower index among equals."""
    best = np.full(len(q), np.iinfo(np.int64).max)
    index = np.full(len(q), len(book))

    def visit(node: _Node, rows: np.ndarray) -> None:
        d2 = squared(q[rows], book[node.entry])
        better = (d2 < best[rows]) | ((d2 == best[rows]) & (node.entry < index[rows]))
        best[rows[better]], index[rows[better]] = d2[better], node.entry
        if not node.children:
            return
        low, high = floor_root(d2), ceil_root(d2)
        bounds = [np.maximum(np.maximum(least - high, low - most), 0) for least, most, _ in node.children]
        first = d2 <= node.middle
        for some, order in ((first, (0, 1)), (~first, (1, 0))):
            for child in order:
                if child < len(node.children):
                    open_ = some & (bounds[child] * bounds[child] <= best[rows])
                    if open_.any():
                        visit(node.children[child][2], rows[open_])

    if len(q):
        visit(tree, np.arange(len(q)))
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """books: parts x entries x width integers. Its size is that of the settings, whatever the number of vectors."""

    books: np.ndarray
    scale: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(float) * scale), -LARGEST, LARGEST).astype(np.int64)


def _fine(vectors: DataFrame, parts: int, vector_col: str) -> DataFrame:
    """Rows whose vector is finite and can be cut."""
    v = F.col(f"`{vector_col}`")
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)).where(~wrong)


def _first(kept: DataFrame, id_col: str, vector_col: str, n: int) -> list[list[float]]:
    """The vectors of the n smallest ids, all as long as the first."""
    ordered = lambda df: [row["v"] for row in df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(n).collect()]
    found = ordered(kept)
    if len({len(v) for v in found}) > 1:
        found = ordered(kept.where(F.size(F.col(f"`{vector_col}`")) == len(found[0])))
    return found


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most BLOCK rows with their vectors as a matrix; small batches are joined."""
    held: list[pa.RecordBatch] = []

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        for batch in table.to_batches(max_chunksize=BLOCK):
            values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            yield batch, values.reshape(batch.num_rows, -1)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield from flush()
            held = []
    if held:
        yield from flush()


def _assigned(values: np.ndarray, books: np.ndarray, trees: list[_Node], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    whole = _integers(values, scale)
    width = books.shape[2]
    for part, (book, tree) in enumerate(zip(books, trees)):
        q = whole[:, part * width : (part + 1) * width]
        yield (q, *nearest(tree, book, q))


def _means(kept: DataFrame, books: np.ndarray, vector_col: str, scale: int) -> np.ndarray:
    """The codebooks after one round: a task adds up what it has, so that a row for each component comes from it."""
    parts, entries, width = books.shape
    schema = "part int, entry int, at int, n long, total long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [vantage_tree(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, values in _blocks(batches, 0):
            for part, (q, index, _) in enumerate(_assigned(values, books, trees, scale)):
                n[part] += np.bincount(index, minlength=entries)
                np.add.at(total[part], index, q)
        part, entry, at = (x.ravel() for x in np.indices(total.shape))
        used = np.repeat(n.ravel(), width) > 0
        yield pa.RecordBatch.from_arrays([pa.array(part[used].astype(np.int32)), pa.array(entry[used].astype(np.int32)), pa.array(at[used].astype(np.int32)), pa.array(np.repeat(n.ravel(), width)[used]), pa.array(total.ravel()[used])], names=["part", "entry", "at", "n", "total"])

    sums = kept.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(tidy(run), schema)
    out = books.copy()
    for row in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # one row a component of the codebooks
        out[row["part"], row["entry"], row["at"]] = row["total"] // row["n"]
    return out


def train(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks that begin as the parts of the vectors of the smallest ids; a round assigns every vector, and puts the
    floored mean of its parts in place of each entry that was used. It stops early where nothing changes any more."""
    kept = _fine(vectors, settings.parts, vector_col)
    first = _first(kept, id_col, vector_col, settings.entries)
    if not first:
        return Codebooks(np.empty((settings.parts, 0, 0), np.int64), settings.scale)
    kept = kept.where(F.size(F.col(f"`{vector_col}`")) == len(first[0]))
    start = _integers(np.array(first), settings.scale)
    books = np.ascontiguousarray(start.reshape(len(first), settings.parts, -1).transpose(1, 0, 2))
    for _ in range(settings.rounds):
        after = _means(kept, books, vector_col, settings.scale)
        if np.array_equal(after, books):
            break
        books = after
    return Codebooks(books, settings.scale)


def encode(vectors: DataFrame, codebooks: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """``(id[, label], code, error)``: two hex digits a part, and the squared distance from what they stand for."""
    kind = lambda c: vectors.schema[c].dataType.simpleString()
    carried = [c for c in (id_col, label_col) if c]
    schema = ", ".join([*(f"`{c}` {kind(c)}" for c in carried), "code string, error long"])
    books, scale = codebooks.books, codebooks.scale
    v = F.col(f"`{vector_col}`")
    kept = _fine(vectors, codebooks.books.shape[0], vector_col)
    kept = kept.where(F.size(v) == books.shape[0] * books.shape[2]) if books.size else kept.where("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [vantage_tree(b) for b in books]
        for batch, values in _blocks(batches, len(carried)):
            error, columns = np.zeros(len(values), np.int64), []
            for _, index, d2 in _assigned(values, books, trees, scale):
                error += d2
                columns.append(index.astype(np.uint8))
            codes = [row.tobytes().hex() for row in np.stack(columns, axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(codes, pa.string()), pa.array(error)], names=[*carried, "code", "error"])

    return kept.select(*(F.col(f"`{c}`") for c in carried), v).mapInArrow(tidy(run), schema)


def decoded(codebooks: Codebooks, code: str = "code"):
    """The vector that a code stands for, as a column: entries of the codebooks over the scale."""
    books = F.array(*(F.array(*(F.array(*(F.lit(x / codebooks.scale) for x in entry)) for entry in book)) for book in codebooks.books.tolist()))
    at = lambda i: F.conv(F.substr(F.col(code), 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(codebooks.books) - 1)), lambda i: F.element_at(F.element_at(books, i + 1), at(i) + 1)))


def with_label_error(coded: DataFrame, label_col: str = "label", id_col: str = "vec_id", few: int = FEW_LABELS) -> DataFrame:
    """Rows of :func:`encode` with ``label_error``, the sum of the errors of all rows with the same label (nulls are one).

    Sums are made in the tasks first. Their table goes to all tasks if it is small, by a count; else each row meets it
    under one of several salts, so that a label of a third of all rows is dealt out.
    """
    totals = written(coded.groupBy(F.col(f"`{label_col}`").alias("__label")).agg(F.sum("error").alias("label_error")))
    if totals.count() <= few:
        return coded.join(F.broadcast(totals), F.col(f"`{label_col}`").eqNullSafe(F.col("__label")), "left").drop("__label")
    salted = totals.select("__label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    rows = coded.withColumn("__salt", F.pmod(F.xxhash64(f"`{id_col}`", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted.withColumnRenamed("__salt", "__other"), F.col(f"`{label_col}`").eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__other")), "left").drop("__label", "__salt", "__other")


def compressed(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of each kept row."""
    rows = narrow(vectors, **{"vec_id": id_col, "embedding": vector_col, "label": label_col})
    codebooks = train(rows, settings)
    coded = written(encode(rows, codebooks, label_col="label"))
    return with_label_error(coded).select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(codebooks.sha256).alias("codebooks_sha256"))
