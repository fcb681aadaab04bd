"""Fill-in-the-middle: texts are cut at unit borders into prefix, middle and suffix, and written in another order.

A text is kept as its maximal runs of one character class, each with the number of units that
have ended with it. A cut after a number of units is then a binary search for the run that
holds it and one addition; no list of units is made, and a text of a million lines that are
empty is one run.

Texts: null is the empty text, which stays plain. Repeated rows give equal rows, an empty table
an empty one; a null id counts as the empty string. Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, narrow, small_batches

#: What a run of a class ends: a unit with each character, one with its last character, or none.
EACH, LAST, NONE = 2, 1, 0


def _space(points: np.ndarray) -> np.ndarray:
    return (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))


def _kinds(points: np.ndarray) -> np.ndarray:
    """White space 0, digits 1, letters (and all beyond ASCII) 2, other characters 3."""
    lower = points | 0x20
    letter = (points > 0x7F) | ((lower >= 0x61) & (lower <= 0x7A) & (points < 0x80))
    digit = (points >= 0x30) & (points <= 0x39)
    return np.select([_space(points), digit, letter], [0, 1, 2], 3)


#: By unit: the class of each code point, and what a run of each class ends. A last run that ends none ends one with the text.
UNITS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], tuple[int, ...]]] = {
    "char": (lambda points: np.zeros(len(points), np.int8), (EACH,)),
    "line": (lambda points: (points == 0x0A).astype(np.int8), (NONE, EACH)),
    "word": (lambda points: _space(points).astype(np.int8), (NONE, LAST)),
    "class": (_kinds, (LAST, LAST, LAST, LAST)),
}


class Runs(NamedTuple):
    """Maximal runs of a class: first offsets (and the length of the text), what each ends, and the units ended with each."""

    start: np.ndarray
    ends: np.ndarray
    total: np.ndarray

    @property
    def units(self) -> int:
        return int(self.total[-1]) if len(self.total) else 0

    def offset(self, units: int) -> int:
        """The code points of the first so many units."""
        if units <= 0:
            return 0
        i = int(np.searchsorted(self.total, units))
        if self.ends[i] == EACH:
            before = int(self.total[i - 1]) if i else 0
            return int(self.start[i]) + units - before
        return int(self.start[i + 1])


def runs(text: str, unit: str) -> Runs:
    classes, closing = UNITS[unit]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = classes(points)
    first = np.flatnonzero(np.diff(kind, prepend=-1))
    start = np.append(first, len(points))
    ends = np.asarray(closing, np.int8)[kind[first]]
    closed = np.where(ends == EACH, np.diff(start), ends)
    if len(ends) and ends[-1] == NONE:
        closed[-1] = 1
    return Runs(start, ends, np.cumsum(closed))


@dataclass(frozen=True)
class Settings:
    """unit: where cuts may fall, of UNITS. percent: of texts that are cut; spm_percent: of those, suffix first. Marks must not
    begin with what they end with, so that they can be found again behind any text that doesn't hold them."""

    unit: str = "line"
    percent: int = 100
    spm_percent: int = 50
    seed: str = "7"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        for mark in self.marks:
            if not mark or any(mark.startswith(mark[-i:]) for i in range(1, len(mark))):
                raise ValueError(f"mark {mark!r} is empty or overlaps itself")
        if len(set(self.marks)) < 3:
            raise ValueError("marks must differ")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(seed: str, key: str) -> list[int]:
    """Four numbers of 32 bits, of seed and key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode("utf-8", "surrogatepass")).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def rearranged(text: str, key: str, s: Settings) -> tuple[int, str, str, int | None, int | None]:
    """Units, form, output, and code points of prefix and middle (None where plain)."""
    index = runs(text, s.unit)
    h1, h2, h3, h4 = draws(s.seed, key)
    if not text or any(mark in text for mark in s.marks) or h3 % 100 >= s.percent:
        return index.units, "plain", text, None, None
    a, b = sorted(index.offset(h % (index.units + 1)) for h in (h1, h2))
    first, mid, last = text[:a], text[a:b], text[b:]
    if h4 % 100 < s.spm_percent:
        return index.units, "spm", s.suffix + last + s.prefix + first + s.middle + mid, a, b - a
    return index.units, "psm", s.prefix + first + s.suffix + last + s.middle + mid, a, b - a


def transform(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, form, output, prefix_chars, middle_chars)`` of each row: n units; form plain, psm (prefix first) or spm (suffix first).

    The cuts and the form depend on seed and id only, so that a lost task gives the same rows again. A text that holds
    a mark stays plain, as it could not be read back.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = narrow(docs, id=id_col, text=text_col).select("id", F.col("id").cast("string").alias("key"), "text")

    def make():
        def of_row(row: tuple) -> list[tuple]:
            return [(row[0], *rearranged(row[2] or "", row[1] or "", settings))]

        return of_row

    return map_rows(rows, make, f"`{id_col}` {kind}, n long, form string, output string, prefix_chars long, middle_chars long")


def restored(settings: Settings = Settings(), output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, by output and form alone."""

    def parts(body: Column, first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.substring_index(body, first, 1)
        rest = F.substr(body, F.length(a) + len(first) + 1)
        b = F.substring_index(rest, second, 1)
        return a, b, F.substr(rest, F.length(b) + len(second) + 1)

    s = settings
    out = F.col(output)
    after = lambda mark: F.substr(out, F.lit(len(mark) + 1))
    prefix, suffix, middle = parts(after(s.prefix), s.suffix, s.middle)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(after(s.suffix), s.prefix, s.middle)
    spm = F.concat(prefix, middle, suffix)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
