"""Benchmark decontamination by template windows.

Words of texts and benchmark items are made canonical: numbers, names (capitalised
inside a sentence) and units (behind a number) become typed placeholders, other words
are lower-cased. Windows of eight canonical words are hashed, those of the texts pass a
bitmap of fixed size that the benchmark's windows fill, and join on the hash. For each
text and item, the joined windows are taken diagonal by diagonal, those first that cover
more. Values of the item that stand for several values of the text in turn (for one of them in
fewer than two thirds of their places), or the other way round, leave only windows without
them and with the item's own values; then a window whose slots contradict those taken is left out: one value of
the item must always stand for one value of the text, and the other way round. The text
is contaminated by the item if the windows left cover ``least_share`` of its words. So a
question with other numbers or names is found, and prose that merely has the shape isn't.

Windows that are mostly placeholders are used on both sides. Those whose slots have the
item's own values count as they are; those with other values count if the windows taken
hold at least as many literal words of the item as one window of mostly literal words has.
Fewer than two literal words in a window prove nothing about other values, so such windows
join on their values. Items are looked for in their own spelling and without capitals, as
in a text that is all in lower or all in upper case, where names are literal words.

Items of fewer than ``least_words`` words are too short to prove anything and are left
out; those of fewer than a window are one window. Null and empty texts and items match nothing;
repeated rows of an id are one text; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, narrow, small_batches, tidy
from .shared import without, written
from .shingles import _FACTORS, _VALUE, mix, powers

# Units that can follow a number.
UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg t ton tons gram grams ounce ounces oz lb lbs pound pounds ml l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal pa bar "
    "c f k degree degrees percent cent cents dollar dollars euro euros usd eur kmh mph kilometers kilometres meters metres centimeters centimetres kilograms"
).split()
#: UTF-8 of curly quotes, dashes, the ellipsis and the no-break space; they part words.
MARKS = [b"\xe2\x80\x98", b"\xe2\x80\x99", b"\xe2\x80\x9c", b"\xe2\x80\x9d", b"\xe2\x80\x93", b"\xe2\x80\x94", b"\xe2\x80\xa6", b"\xc2\xab", b"\xc2\xbb", b"\xc2\xa0"]

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_WORD = _DIGIT | _UPPER
_WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"|"]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord("."), ord(",")]] = True
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA5A5A5A5A5A5A501, 0xA5A5A5A5A5A5A502, 0xA5A5A5A5A5A5A503))


@dataclass(frozen=True)
class Settings:
    window: int = 8
    least_words: int = 5
    least_share: float = 0.5
    literal_share: float = 0.6
    least_literal: int = 2
    bitmap_bits: int = 23


def _hashes(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    place = np.arange(len(at)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_VALUE[data[at]] * powers(int(lengths.max()))[place], first))


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    at = np.flatnonzero(_WORD[data])
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return np.sort(_hashes(data, first, np.diff(first, append=len(at)), at))


_UNIT_HASHES = _unit_hashes()


def canonical(text: str | None, names: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the fingerprint of its canonical form, and of its value if it is a slot, else 0. Without names, these are words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw.isascii():
        for mark in MARKS:
            raw = raw.replace(mark, b" ")
    data = np.frombuffer(raw, np.uint8)
    word, digit = _WORD[data], _DIGIT[data]
    if len(data) > 2 and digit.any():  # a point between digits belongs to the number
        word = word.copy()
        word[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    at = np.flatnonzero(word)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    lower = np.frombuffer(raw.lower(), np.uint8)
    second = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) if len(data) > 1 else None
    begins = at[first]
    accented = np.zeros(len(data), bool)
    if second is not None and second.any():  # capital letters of Latin-1
        lower = lower.copy()
        lower[1:][second] += 0x20
        accented[:-1] = second
    value = _hashes(lower, first, lengths, at)
    number = digit[begins]
    known = np.searchsorted(_UNIT_HASHES, value)
    unit = np.zeros(len(value), bool)
    unit[1:] = number[:-1] & (_UNIT_HASHES[np.minimum(known[1:], len(_UNIT_HASHES) - 1)] == value[1:])
    capital = _UPPER[data[begins]] | accented[begins]
    following = np.minimum(begins + 1 + accented[begins], len(data) - 1)
    capital &= ~((lengths > 1) & (_UPPER[data[following]]))
    ends = begins + lengths
    stops = np.concatenate([[0], np.cumsum(_STOP[data] & ~word)])
    inside = np.zeros(len(value), bool)
    inside[1:] = stops[begins[1:]] == stops[ends[:-1]]
    name = capital & inside & ~number & names
    form = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, value)))
    return form, np.where(number | name | unit, value, np.uint64(0))


def windows(form: np.ndarray, slots: np.ndarray, width: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of each window: of its forms, or of its values if it has next to no literal word."""
    n = len(form) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = form[:n] * _FACTORS[0]
    for i in range(1, width):
        total = total + form[i : n + i] * _FACTORS[i]
    hashes = mix(total + np.uint64(width))
    if slots.any():
        literal = np.concatenate([[0], np.cumsum(slots == 0)])
        few = np.flatnonzero(literal[width:] - literal[:n] < s.least_literal)
        if len(few):
            value = np.where(slots != 0, slots, form)
            total = value[few] * _FACTORS[0]
            for i in range(1, width):
                total = total + value[few + i] * _FACTORS[i]
            hashes[few] = mix(total + np.uint64(width + 64))
    return np.arange(n), hashes


_ROW = "id {}, at int, hash long, n_words int, width int, slots array<long>"


def _window_rows(rows: DataFrame, s: Settings, widths: list[int] | None, bitmap) -> DataFrame:
    """Windows of texts that pass the bitmap, or (without widths) all windows of items."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                form, slots = canonical(text)
                n = len(form)
                if widths is None and n < s.least_words:
                    continue
                if widths is None and ((bare := canonical(text, names=False))[0] != form).any():
                    at, hashes = windows(*bare, min(n, s.window), s)
                    for a, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        out.append((a, h, n, min(n, s.window), bare[1][a : a + s.window].view(np.int64).tolist()))
                        of.append(i)
                for width in widths or [min(n, s.window)]:
                    at, hashes = windows(form, slots, width, s)
                    if widths is not None and len(at):
                        key = (hashes >> np.uint64(64 - s.bitmap_bits)).astype(np.int64)
                        hit = np.flatnonzero((bitmap.value[key >> 3] >> (key & 7).astype(np.uint8)) & 1)
                        at, hashes = at[hit], hashes[hit]
                    for a, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        out.append((a, h, n, width, slots[a : a + width].view(np.int64).tolist()))
                        of.append(i)
            if out:
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=["id", "at", "hash", "n_words", "width", "slots"])

    return rows.mapInArrow(tidy(run), _ROW.format(kind))


def _untorn(windows: list[dict]) -> list[dict]:
    """The windows of a diagonal, if none of its values is torn: stands for one value of the other side in fewer than two thirds
    of its places. With torn values this is no consistent re-parameterisation, and only what is verbatim and without them counts."""
    pairs = {m["place"] + i: ab for m in windows for i, ab in enumerate(zip(m["item_slots"], m["slots"])) if ab[0] or ab[1]}
    torn = []
    for side in (0, 1):
        met: dict[int, dict[int, int]] = {}
        for ab in pairs.values():
            own = met.setdefault(ab[side], {})
            own[ab[1 - side]] = own.get(ab[1 - side], 0) + 1
        torn.append({x for x, own in met.items() if 3 * max(own.values()) < 2 * sum(own.values())})
    if not any(torn):
        return windows
    return [m for m in windows if m["item_slots"] == m["slots"] and torn[0].isdisjoint(m["item_slots"])]


def judge(matches: list[dict], s: Settings = Settings()) -> tuple[int, int, int, int]:
    """Words of the item covered by consistent windows, changed slots, first and last word in the text."""
    by_diagonal: dict[int, list[dict]] = {}
    for m in matches:
        by_diagonal.setdefault(m["at"] - m["place"], []).append(m)
    by_diagonal = {d: whole for d, own in by_diagonal.items() if (whole := _untorn(own))}
    forth: dict[int, int] = {}
    back: dict[int, int] = {}
    taken: list[tuple[dict, set, bool]] = []
    literal: set[int] = set()
    for _, own in sorted(by_diagonal.items(), key=lambda x: (-len(x[1]), x[0])):
        for m in sorted(own, key=lambda m: m["place"]):
            pairs = {(a, b) for a, b in zip(m["item_slots"], m["slots"]) if a or b}
            new_forth, new_back = dict(pairs), {b: a for a, b in pairs}
            if len(new_forth) < len(pairs) or len(new_back) < len(pairs):
                continue
            if any(forth.get(a, b) != b for a, b in pairs) or any(back.get(b, a) != a for a, b in pairs):
                continue
            forth |= new_forth
            back |= new_back
            own_words = {m["place"] + i for i, a in enumerate(m["item_slots"]) if not a}
            literal |= own_words
            taken.append((m, pairs, len(own_words) >= s.literal_share * m["width"] or all(a == b for a, b in pairs)))
    if taken and len(literal) < s.literal_share * taken[0][0]["width"]:
        taken = [t for t in taken if t[2]]
    covered = {w for m, _, _ in taken for w in range(m["place"], m["place"] + m["width"])}
    words = [w for m, _, _ in taken for w in (m["at"], m["at"] + m["width"] - 1)]
    changed = {a for _, pairs, _ in taken for a, b in pairs if a != b}
    return len(covered), len(changed), min(words, default=0), max(words, default=0)


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc id, item id, share, n_covered, n_changed_slots, first_word, last_word)`` of each contaminated text and item."""
    s = settings
    small_batches(docs.sparkSession)
    items = written(_window_rows(narrow(benchmark, id=item_col, text=item_text_col), s, None, None))
    size = 1 << s.bitmap_bits
    marks = items.select(F.shiftrightunsigned("hash", 64 - s.bitmap_bits).alias("key")).groupBy(F.expr("key >> 3").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(key & 7 AS int))")).alias("bits"))
    bitmap = np.zeros(size // 8, np.uint8)  # 1 MB, whatever the benchmark is
    marks = marks.toArrow()
    bitmap[marks.column(0).to_numpy()] = marks.column(1).to_numpy()
    widths = [r.width for r in items.select("width").distinct().orderBy("width").collect()]
    rows = narrow(docs, id=id_col, text=text_col)
    found = _window_rows(rows, s, widths or [s.window], docs.sparkSession.sparkContext.broadcast(bitmap)).select("id", "at", "hash", "width", "slots")
    right = items.select(F.col("id").alias("item"), F.col("at").alias("place"), "hash", "width", F.col("n_words").alias("item_words"), F.col("slots").alias("item_slots"))
    met = found.join(right, ["hash", "width"]).groupBy("id", "item").agg(F.max("item_words").alias("item_words"), F.collect_set(F.struct("at", "place", "width", "slots", "item_slots")).alias("matches"))

    def make():
        def of_row(row):
            covered, changed, first, last = judge(row[3], s)
            if covered >= s.least_share * row[2]:
                yield row[0], row[1], covered / row[2], covered, changed, first, last

        return of_row

    kinds = [met.schema[c].dataType.simpleString() for c in ("id", "item")]
    return map_rows(met, make, f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, share double, n_covered bigint, n_changed_slots bigint, first_word bigint, last_word bigint")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts that no item contaminates, with all their columns."""
    return without(docs, find(docs, benchmark, settings, id_col, text_col).select(id_col), id_col)
