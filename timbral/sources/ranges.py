"""Archives of vectors and tar shards, read by byte ranges.

A first pass reads headers alone, and seeks over what they describe: a Python data source with a partition a file
(``spark.read.format("timbral_headers")``), or the offsets of an index file. What it gives is a table ``(path, offset,
length, key, kind)`` that can be joined and filtered like any other. A second pass deals those rows in the order of their
places, so that a task reads neighbouring ranges of few files, and holds one record and a read-ahead. So a file is
read by as many tasks as its size asks for, and no file is ever held whole.

Records of archives: vectors and matrices of single and double precision, sparse ones, and matrices compressed to one or
two bytes a value, each binary.
"""

from __future__ import annotations

import fnmatch
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.prefix import islands

HEADERS = "path string, offset long, length long, key string, kind string"
#: Bytes that a task reads ahead, and bytes of records in one batch that goes back to Spark.
AHEAD, BATCH = 1 << 20, 16 << 20
#: Bytes of one task's share.
SPLIT = 64 << 20


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(urlparse(path).path if path.startswith("file:") else path)
    return fs.FileSystem.from_uri(path)


class Window:
    """A file that is read at offsets, some bytes ahead."""

    def __init__(self, path: str, ahead: int = AHEAD) -> None:
        system, inside = _filesystem(path)
        self.file = system.open_input_file(inside)
        self.size, self.ahead, self.start, self.held = self.file.size(), ahead, 0, b""

    def __call__(self, offset: int, n: int) -> bytes:
        """n bytes from the offset on; fewer at the end of the file."""
        if not (self.start <= offset and offset + n <= self.start + len(self.held)):
            self.held = self.file.read_at(max(0, min(max(n, self.ahead), self.size - offset)), offset) if offset < self.size else b""
            self.start = offset
        return self.held[offset - self.start : offset - self.start + n]

    def exactly(self, offset: int, n: int) -> bytes:
        data = self(offset, n)
        if len(data) < n:
            raise EOFError(f"the file ends inside of a record at {offset}")
        return data

    def close(self) -> None:
        self.file.close()


# --- archives -----------------------------------------------------------------------------------

#: Tags of dense records: type of a value, number of dimensions.
DENSE = {b"FV": ("<f4", 1), b"DV": ("<f8", 1), b"FM": ("<f4", 2), b"DM": ("<f8", 2)}
#: Tags of compressed matrices: type of a stored value.
COMPRESSED = {b"CM": "<u1", b"CM2": "<u2", b"CM3": "<u1"}


def _marked(window: Window, at: int) -> int:
    """A whole number behind the mark of its size."""
    data = window.exactly(at, 5)
    if data[0] != 4:
        raise ValueError("a whole number isn't of four bytes")
    return struct.unpack_from("<i", data, 1)[0]


def _tag(window: Window, offset: int) -> tuple[bytes, int]:
    head = window(offset, 8)
    if head[:2] != b"\0B" or b" " not in head[2:]:
        raise ValueError("a record isn't binary")
    tag = head[2 : head.index(b" ", 2)]
    return tag, offset + 3 + len(tag)


def record_end(window: Window, offset: int) -> tuple[bytes, int]:
    """Tag and end of the record whose binary mark is at the offset. Values are not read, but for the counts in sparse rows."""
    tag, at = _tag(window, offset)
    if tag in DENSE:
        kind, dims = DENSE[tag]
        sizes = [_marked(window, at + 5 * i) for i in range(dims)]
        return tag, at + 5 * dims + int(np.prod(sizes, dtype=np.int64)) * int(kind[-1])
    if tag in COMPRESSED:
        rows, columns = struct.unpack("<ii", window.exactly(at + 8, 8))
        return tag, at + 16 + (8 * columns if tag == b"CM" else 0) + rows * columns * int(COMPRESSED[tag][-1])
    if tag == b"SV":
        return tag, at + 10 + 10 * _marked(window, at + 5)
    if tag == b"SM":
        rows, at = _marked(window, at), at + 5
        for _ in range(rows):
            if window.exactly(at, 3) != b"SV ":
                raise ValueError("a row of a sparse matrix isn't sparse")
            at += 13 + 10 * _marked(window, at + 8)
        return tag, at
    raise ValueError(f"records of type {tag!r} aren't read")


def _sparse(window: Window, at: int) -> tuple[np.ndarray, int]:
    size, n = _marked(window, at), _marked(window, at + 5)
    pairs = np.frombuffer(window.exactly(at + 10, 10 * n), np.dtype([("m", "u1"), ("i", "<i4"), ("k", "u1"), ("x", "<f4")]), n)
    out = np.zeros(size)
    out[pairs["i"]] = pairs["x"]
    return out, at + 10 + 10 * n


def _expanded(tag: bytes, window: Window, at: int) -> np.ndarray:
    low, span, rows, columns = struct.unpack("<ffii", window.exactly(at, 16))
    at += 16
    if tag != b"CM":
        kind = COMPRESSED[tag]
        stored = np.frombuffer(window.exactly(at, rows * columns * int(kind[-1])), kind).reshape(rows, columns)
        return low + stored * (span / (65535.0 if tag == b"CM2" else 255.0))
    # four marks of each column, 0, 64, 192 and 255 of its bytes, with straight lines between
    marks = low + np.frombuffer(window.exactly(at, 8 * columns), "<u2").reshape(columns, 4) * (span / 65535.0)
    stored = np.frombuffer(window.exactly(at + 8 * columns, rows * columns), "u1").reshape(columns, rows)
    return np.stack([np.interp(s, (0, 64, 192, 255), m) for s, m in zip(stored, marks)], axis=1) if columns else np.zeros((rows, 0))


def record_at(window: Window, offset: int) -> np.ndarray:
    """The vector or matrix whose binary mark is at the offset, in double precision."""
    tag, at = _tag(window, offset)
    if tag in DENSE:
        kind, dims = DENSE[tag]
        shape = [_marked(window, at + 5 * i) for i in range(dims)]
        n = int(np.prod(shape, dtype=np.int64))
        return np.frombuffer(window.exactly(at + 5 * dims, n * int(kind[-1])), kind).reshape(shape).astype(float)
    if tag in COMPRESSED:
        return _expanded(tag, window, at)
    if tag == b"SV":
        return _sparse(window, at)[0]
    if tag == b"SM":
        rows, at, made = _marked(window, at), at + 5, []
        for _ in range(rows):
            row, at = _sparse(window, at + 3)
            made.append(row)
        return np.stack(made) if made else np.zeros((0, 0))
    raise ValueError(f"records of type {tag!r} aren't read")


def archive_headers(window: Window) -> Iterator[tuple[int, int, str, str]]:
    """``(offset, length, key, tag)`` of each record; the offset is that of the binary mark. A record cut off by the end is ``broken``."""
    at = 0
    while at < window.size:
        head = window(at, 4096)
        if b" " not in head:
            raise ValueError(f"no key at {at}")
        key = head[: head.index(b" ")]
        start = at + len(key) + 1
        try:
            tag, at = record_end(window, start)
        except EOFError:
            tag, at = b"broken", window.size
        if at > window.size:
            tag, at = b"broken", window.size
        yield start, at - start, key.decode().strip(), tag.decode()


# --- tar files ----------------------------------------------------------------------------------


def _number(field: bytes) -> int:
    if field[:1] == b"\x80":  # a large one, in binary
        return int.from_bytes(field[1:], "big")
    return int(field.split(b"\0")[0].strip() or b"0", 8)


def _extended(data: bytes) -> dict[str, str]:
    """Records ``length name=value`` of an extended header."""
    out, at = {}, 0
    while at < len(data) and b" " in data[at:]:
        length = int(data[at : data.index(b" ", at)])
        name, _, value = data[at:][:length].partition(b" ")[2].partition(b"=")
        out[name.decode()] = value.rstrip(b"\n").decode("utf-8", "replace")
        at += length
    return out


def tar_headers(window: Window) -> Iterator[tuple[int, int, str, str]]:
    """``(offset, length, name, kind)`` of the regular files; the offset is that of the contents. What the end cuts off, or a header
    that can't be read, is ``broken``; nothing behind it is read, as the places of what follows aren't known."""
    at, longer = 0, {}
    while at + 512 <= window.size:
        head = window.exactly(at, 512)
        if not head.strip(b"\0"):
            return
        try:
            if _number(head[148:156]) != sum(head[:148]) + sum(head[156:]) + 8 * 32:
                raise ValueError("checksum")
            size, kind = _number(head[124:136]), head[156:157]
        except ValueError:
            yield at, 0, "", "broken"
            return
        size = int(longer.get("size", size)) if kind not in (b"x", b"g", b"L", b"K") else size
        if kind == b"x":
            longer |= _extended(window(at + 512, size))
        elif kind == b"L":
            longer["path"] = window(at + 512, size).rstrip(b"\0").decode("utf-8", "replace")
        elif kind not in (b"g", b"K"):
            lead, name = head[345:500].split(b"\0")[0], head[:100].split(b"\0")[0]
            own = (lead + b"/" + name if lead and head[257:262] == b"ustar" and head[262:264] != b" \0" else name).decode("utf-8", "replace")
            if kind in (b"0", b"\0", b"7"):
                whole = at + 512 + size <= window.size
                yield at + 512, size, longer.get("path", own), "file" if whole else "broken"
            longer = {}
        at += 512 + -(-size // 512) * 512


# --- the data source ----------------------------------------------------------------------------


@dataclass
class _File(InputPartition):
    path: str


class _HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.path, self.walk, self.ending, self.columns = options["path"], options.get("kind", "archive"), options.get("ending", ""), columns

    def partitions(self) -> list[_File]:
        """A partition a file, with its path only."""
        system, inside = _filesystem(self.path)
        prefix = self.path[: len(self.path) - len(inside)] if urlparse(self.path).scheme and self.path.endswith(inside) else ""
        folder, _, last = inside.rpartition("/")
        pattern = last if any(c in last for c in "*?[") else ""
        info = None if pattern else system.get_file_info(inside)
        found = [info] if info is not None and info.is_file else system.get_file_info(fs.FileSelector(folder if pattern else inside, recursive=not pattern, allow_not_found=True))
        wanted = lambda f: f.is_file and f.path.endswith(self.ending) and not f.base_name.startswith(("_", ".")) and (not pattern or fnmatch.fnmatchcase(f.base_name, pattern))
        return [_File(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if wanted(f)]

    def read(self, partition: _File) -> Iterator[tuple]:
        window = Window(partition.path, 1 << 16)
        walk = {"archive": archive_headers, "tar": tar_headers}[self.walk]
        try:
            for offset, length, key, kind in walk(window):
                row = {"path": partition.path, "offset": offset, "length": length, "key": key, "kind": kind}
                yield tuple(row[c] for c in self.columns)
        finally:
            window.close()


class HeaderSource(DataSource):
    """Options: path (a file, a folder, or a folder and a pattern of names), kind (archive or tar), ending of file names. A schema of fewer columns is taken."""

    @classmethod
    def name(cls) -> str:
        return "timbral_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HeaderReader(dict(self.options), schema.names)


def headers(spark: SparkSession, path: str, kind: str = "archive", ending: str = "") -> DataFrame:
    """``(path, offset, length, key, kind)`` of the records below a path."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("timbral_headers").option("kind", kind).option("ending", ending).load(path)


def index_entries(lines: DataFrame) -> DataFrame:
    """The same columns of an index ``(key, value)`` with values ``path:offset``; lengths aren't known. A value without an offset is at 0."""
    value = F.col("value")
    has = value.rlike(r":\d+$")
    path = F.when(has, F.regexp_extract(value, r"^(.*):(\d+)$", 1)).otherwise(value)
    offset = F.when(has, F.regexp_extract(value, r":(\d+)$", 1).cast("long")).otherwise(F.lit(0).cast("long"))
    return lines.select(path.alias("path"), offset.alias("offset"), F.lit(None).cast("long").alias("length"), "key", F.lit("indexed").alias("kind"))


# --- reading of ranges --------------------------------------------------------------------------


def _dealt(index: DataFrame, split: int, *order: str) -> DataFrame:
    """Rows in the order of their places, in as many parts as their bytes ask for."""
    have = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    parts = max(1, min(have["n"], -(-max(have["bytes"], 0) // split)))
    parts = parts if have["bytes"] else max(1, -(-have["n"] // 10_000))
    return index.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)


def _windows() -> Callable[[str], Window]:
    """The open file of a task; another path closes it."""
    now: list[Window | str | None] = [None, None]

    def of(path: str) -> Window:
        if now[0] != path:
            if now[1] is not None:
                now[1].close()
            now[:] = [path, Window(path)]
        return now[1]

    return of


def read_records(index: DataFrame, matrix: bool = False, split: int = SPLIT) -> DataFrame:
    """``(utt, emb)``, or ``(utt, feat)`` of matrices, of the rows of a header table or index. Filter the index to read less.

    Records cut off by the end of their file fail the job, unless their rows (kind ``broken``) are filtered out before.
    """
    name, kind = ("feat", "array<array<double>>") if matrix else ("emb", "array<double>")
    target = to_arrow_schema(_parse_datatype_string(f"utt string, {name} {kind}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, keys, values, held = _windows(), [], [], 0
        for batch in batches:
            for path, offset, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
                array = record_at(window(path), offset)
                keys.append(key)
                values.append(array.tolist())
                held += array.nbytes
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values, target.field(1).type)], schema=target)
                    keys, values, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values, target.field(1).type)], schema=target)

    return _dealt(index, split, "path", "offset").select("path", "offset", "key").mapInArrow(run, f"utt string, {name} {kind}")


def read_archives(spark: SparkSession, path: str, keys: DataFrame | None = None, matrix: bool = False, ending: str = "", split: int = SPLIT) -> DataFrame:
    """The records of all archives below a path, or those of some keys (first column); a broken last record goes."""
    index = headers(spark, path, "archive", ending).where("kind <> 'broken'")
    if keys is not None:
        index = index.join(keys.select(F.col(keys.columns[0]).cast("string").alias("key")).distinct(), "key", "left_semi")
    return read_records(index, matrix, split)


def shard_groups(spark: SparkSession, path: str, ending: str = ".tar") -> DataFrame:
    """``(path, run, key, suffix, offset, length, kind)`` of the members of tar files: members side by side with one name before the
    last dot are a run. The same name in two places is two runs. Members without a dot belong to none."""
    members = headers(spark, path, "tar", ending)
    split = members.select("path", "offset", "length", "kind", F.regexp_extract("key", r"(?s)^(.+)\.[^.]*$", 1).alias("prefix"), F.regexp_extract("key", r"(?s)\.([^.]*)$", 1).alias("suffix"))
    split = split.where("prefix <> '' OR kind = 'broken'")
    runs = islands(split, ["path", "prefix"], "path", "offset")
    return runs.select("path", "run", F.col("prefix").alias("key"), "suffix", "offset", "length", "kind")


def read_shards(spark: SparkSession, path: str, suffixes: list[str] | None = None, ending: str = ".tar", last: str = "keep", split: int = SPLIT) -> DataFrame:
    """``(shard, run, key, members map<suffix, bytes>)``: a row a run of members, of some suffixes only where they are given.

    A broken member can only be the last one of its file, as what follows can't be found. Its run stays, with the members before
    it, or goes (``last="drop"``). Of equal suffixes in one run the last one counts. Runs are dealt whole, by their places in
    the files, so that no contents are shuffled; a task holds the members of one run and one batch of rows.
    """
    groups = shard_groups(spark, path, ending)
    wanted = groups.where("kind <> 'broken'")
    if last == "drop":
        wanted = wanted.join(groups.where("kind = 'broken'").select("run").distinct(), "run", "left_anti")  # one run a file at most
    if suffixes is not None:
        wanted = wanted.where(F.col("suffix").isin(suffixes))
    schema = "shard string, run long, key string, members map<string, binary>"

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, rows, own, held = _windows(), [], None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), target)], schema=target)

        for batch in batches:
            for path, number, key, suffix, offset, length in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if own is None or own[1] != number:
                    if own is not None:
                        rows.append((*own[:3], list(own[3].items())))
                    if held >= BATCH:
                        yield out()
                        rows, held = [], 0
                    own = (path, number, key, {})
                own[3][suffix] = window(path).exactly(offset, length)
                held += length
        if own is not None:
            rows.append((*own[:3], list(own[3].items())))
        if rows:
            yield out()

    order = _dealt_runs(wanted, split)
    return order.select("path", "run", "key", "suffix", "offset", "length").mapInArrow(run, schema)


def _dealt_runs(members: DataFrame, split: int) -> DataFrame:
    """Whole runs in the order of their places: ranges are cut by the number of the run, which ascends with the places."""
    total = members.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
    return members.repartitionByRange(max(1, -(-total // split)), "run").sortWithinPartitions("run", "offset")


# --- writing ------------------------------------------------------------------------------------


def write_archives(df: DataFrame, folder: str, column: str = "emb", key: str = "utt") -> DataFrame:
    """Writes ``(key, column)`` as archives, one a task, and returns the index ``(key, path, offset, length)`` of what was written.

    A task that is run again writes another file; only the files of the index that is returned count. Write the index, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from .binary import archive_record

        path, at, sink = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.ark", 0, None
        system, inside = _filesystem(path)
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sink is None:
                    system.create_dir(os.path.dirname(inside), recursive=True)
                    sink = system.open_output_stream(inside)
                record = archive_record(name, np.asarray(value, float))
                sink.write(record)
                head = len(name.encode()) + 1
                rows.append((name, path, at + head, len(record) - head))
                at += len(record)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["key", "path", "offset", "length"])
        if sink is not None:
            sink.close()

    return df.select(F.col(key).cast("string").alias("key"), column).mapInArrow(run, "key string, path string, offset long, length long")
