"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

A line without a word is neutral. A line fails by the first of these rules:

* ``boilerplate``: it holds a phrase of :data:`BOILERPLATE` and is short;
* ``navigation``: separators stand between most of its words, or it is a list of very short links;
* ``symbols``: marks of ``#*$%&|<>`` weigh more than a share of its words;
* ``shouting``: nearly all of its longer words are in capitals, or end in ``!!``;
* ``punctuation``: it is long and has no sentence mark at all, or it has no letter.

Before that, base rules look at the whole text: too few words, or too many words in
repeated 3-word windows. A document is kept if the base rules pass and the failing
lines hold at most ``max_lost`` of its word characters.

Null and empty texts have no words and fail the base rules. Rows are judged one by
one: repeated rows and ties get equal verdicts, further columns are ignored (or
passed on, by :func:`filter_documents`), and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, narrow, small_batches, tidy

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = re.compile(r"[#*$%&|<>]").findall
LETTER = re.compile(r"[^\W\d_]").search
SENTENCE_MARK = re.compile(r"[.!?…:;。！？]").search

# Phrases of page furniture, lower case.
BOILERPLATE = re.compile(
    "all rights reserved|privacy policy|terms of use|terms of service|cookie policy|we use cookies|accept cookies"
    "|enable javascript|subscribe to our newsletter|sign up for our newsletter|click here to|share on facebook"
    "|share on twitter|follow us on|back to top|skip to content|log in to|lorem ipsum|powered by wordpress"
).search
SEPARATORS = {"|", "»", "›", "·", "•", "/", "::", ">", ">>"}


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    boilerplate_words: int = 25
    separator_share: float = 0.25
    symbol_share: float = 0.5
    shout_share: float = 0.5
    unmarked_words: int = 30
    max_lost: float = 0.3


@dataclass
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    lost_chars: int
    failed_lines: dict[str, int]
    kept: bool
    text: str


def line_rule(line: str, words: list[str], rules: Rules) -> str | None:
    """The rule by which a line with words fails, or None."""
    n = len(words)
    if n <= rules.boilerplate_words and BOILERPLATE(line.lower()):
        return "boilerplate"
    if n >= 4 and sum(w in SEPARATORS for w in words) > rules.separator_share * n:
        return "navigation"
    if n >= 3 and len(SYMBOLS(line)) > rules.symbol_share * n:
        return "symbols"
    if n >= 4:
        long = [w for w in words if len(w) > 3]
        if long and (line.count("!!") > rules.shout_share * n or sum(w.isupper() for w in long) > 0.8 * len(long)):
            return "shouting"
    if not LETTER(line) or n >= rules.unmarked_words and not SENTENCE_MARK(line):
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if window in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge(text: str | None, rules: Rules = Rules()) -> Verdict:
    text = text or ""
    lines, failed, kept_lines = text.split("\n"), Counter(), []
    words: list[str] = []
    seen: set[str] = set()
    dup = lost = word_chars = 0
    for line in lines:
        own = WORDS(line)
        if own:
            words += own
            chars = sum(map(len, own))
            word_chars += chars
            dup += line in seen
            seen.add(line)
            if rule := line_rule(line, own, rules):
                failed[rule] += 1
                lost += chars
                continue
        kept_lines.append(line)
    repeated = repeated_words(words)
    base_failed = len(words) < rules.min_words or 100 * repeated > rules.max_repeat_percent * len(words)
    kept = not base_failed and lost <= rules.max_lost * word_chars
    return Verdict(len(words), word_chars, len(SYMBOLS(text)), dup, repeated, base_failed, lost, dict(failed), kept, "\n".join(kept_lines))


def score_documents(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Counts and the verdict of each document; with_text adds the cleaned text (null unless kept)."""
    small_batches(docs.sparkSession)
    rows = narrow(docs, **{"id": id_col, "text": text_col})
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        def of_row(row):
            v = judge(row[1], rules)
            out = (row[0], v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed, v.kept, v.lost_chars, sum(v.failed_lines.values()))
            yield (*out, v.text if v.kept else None) if with_text else out

        return of_row

    schema = f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_chars bigint, n_failed_lines bigint"
    return map_rows(rows, make, schema + ", cleaned_text string" * with_text)


def filter_documents(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The kept documents with all their columns; failing lines are gone from the text, and chars_col follows it."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [judge(text, rules) for text in batch.column(at).to_pylist()]
            mask = pa.array([v.kept for v in verdicts], pa.bool_())
            columns = [c.filter(mask) for c in batch.columns]
            texts = [v.text for v in verdicts if v.kept]
            columns[at] = pa.array(texts, batch.schema[at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for t in texts], batch.schema[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)

