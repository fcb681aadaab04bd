"""Files of two-covariance models, binary or text, and processing chains as tables.

Models have the size of a few D x D matrices; they are read and written on the driver.
"""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.backend import Link, Plda, fit_link, parse_chain, through
from .ranges import _filesystem, record_at, record_end

_OPEN, _CLOSE = b"<Plda>", b"</Plda>"
_NUMBERS = re.compile(rb"\[([^\]]*)\]")


class _Held:
    """Bytes in memory, read as a file at offsets is."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def __call__(self, offset: int, n: int) -> bytes:
        return self.data[offset : offset + n]

    def exactly(self, offset: int, n: int) -> bytes:
        if len(out := self(offset, n)) < n:
            raise EOFError("the model ends early")
        return out


def parse_plda(data: bytes) -> Plda:
    """Mean, transform and the between-class variances of a model's bytes. Values in a binary file may be single, double or compressed."""
    if data[:2] == b"\0B":
        if data[2:9] != _OPEN + b" ":
            raise ValueError("no model of this kind")
        at, parts = 9, []
        for _ in range(3):
            held = _Held(b"\0B" + data[at:])  # as the value of a record begins
            parts.append(record_at(held, 0))
            at += record_end(held, 0)[1] - 2
        if data[at : at + len(_CLOSE)] != _CLOSE:
            raise ValueError("the model has no end")
        mean, transform, psi = parts
    else:
        body = data.strip()
        if not (body.startswith(_OPEN) and body.endswith(_CLOSE)):
            raise ValueError("no model of this kind")
        values = _NUMBERS.findall(body)
        if len(values) != 3:
            raise ValueError(f"a model has three values, this one {len(values)}")
        rows = [[float(x) for x in line.split()] for line in values[1].splitlines() if line.strip()]
        mean, transform, psi = np.array(values[0].split(), float), np.array(rows), np.array(values[2].split(), float)
    if mean.ndim != 1 or transform.shape != (len(mean), len(mean)) or psi.shape != mean.shape:
        raise ValueError("the values of the model differ in size")
    return Plda(mean, transform, psi)


def plda_bytes(plda: Plda, binary: bool = True) -> bytes:
    """The model as bytes; doubles either way. Text has as many digits as a double needs."""
    if binary:
        vector = lambda v: b"DV \4" + struct.pack("<i", len(v)) + np.asarray(v, "<f8").tobytes()
        matrix = b"DM \4" + struct.pack("<i", plda.transform.shape[0]) + b"\4" + struct.pack("<i", plda.transform.shape[1]) + np.ascontiguousarray(plda.transform, "<f8").tobytes()
        return b"\0B" + _OPEN + b" " + vector(plda.mean) + matrix + vector(plda.psi) + _CLOSE + b" "
    line = lambda v: " ".join(repr(float(x)) for x in v)
    rows = "\n  ".join(line(r) for r in plda.transform)
    return f"<Plda>  [ {line(plda.mean)} ]\n [\n  {rows} ]\n [ {line(plda.psi)} ]\n</Plda> ".encode()


def read_plda(spark: SparkSession, path: str) -> Plda:
    return parse_plda(spark.read.format("binaryFile").load(path).select("content").first().content)


def write_plda(plda: Plda, path: str, binary: bool = True) -> None:
    system, inside = _filesystem(path)
    system.create_dir(inside.rpartition("/")[0])
    with system.open_output_stream(inside) as f:
        f.write(plda_bytes(plda, binary))


# --- chains -------------------------------------------------------------------------------------

CHAIN = "at int, method string, options map<string,string>, value string, row int, numbers array<double>"


def chain_table(spark: SparkSession, links: list[Link]) -> DataFrame:
    """A row for each row of each value of a link; a link without values has one row. A vector is row -1."""
    rows = []
    for at, link in enumerate(links):
        rows.append((at, link.method, link.options, None, None, None))
        for name, value in link.values.items():
            matrix = len(value) and isinstance(value[0], (list, tuple))
            rows += [(at, link.method, link.options, name, i, list(map(float, v))) for i, v in (enumerate(value) if matrix else [(-1, value)])]
    return spark.createDataFrame(rows, CHAIN)


def chain_of(table: DataFrame) -> list[Link]:
    """The links of a chain table, in any order of its rows."""
    links: dict[int, Link] = {}
    for r in sorted(table.collect(), key=lambda r: (r["at"], r["value"] or "", -1 if r["row"] is None else r["row"])):  # of the size of a model
        link = links.setdefault(r["at"], Link(r["method"], dict(r["options"])))
        if r["value"] is not None and r["row"] < 0:
            link.values[r["value"]] = list(r["numbers"])
        elif r["value"] is not None:
            link.values.setdefault(r["value"], []).append(list(r["numbers"]))
    return [links[at] for at in sorted(links)]


def save_chain(spark: SparkSession, links: list[Link], path: str) -> None:
    chain_table(spark, links).coalesce(1).write.mode("overwrite").parquet(path)


def load_chain(spark: SparkSession, path: str) -> list[Link]:
    return chain_of(spark.read.parquet(path))


def replaced_link(links: list[Link], at: int, text: str, df: DataFrame, label: str = "spk", emb: str = "emb") -> list[Link]:
    """The chain with the link at a place (from 0) replaced by the one link of text, fitted on df behind the links before it. The others keep their values."""
    new = parse_chain(text)
    if len(new) != 1:
        raise ValueError("one link replaces one link")
    if not 0 <= at < len(links):
        raise IndexError(f"the chain has no link {at}")
    return [*links[:at], fit_link(new[0], through(links[:at], df, label, emb), label), *links[at + 1 :]]
