"""Chat formatting of typed content parts.

A turn's content is a list of typed parts: text, image, audio or document. A visitor
flattens the parts, in order, into one string: text is escaped, any other part becomes
a placeholder, its reference goes to the list of attachments, and its token count, from
the part's own size or a default of its kind, to the expanded count.

The template is ``<s>[ROLE]`` text ``[/]</s>`` a turn, joined without anything between; a
placeholder is ``<|KIND:NUMBER|>``, numbered through the conversation. Escaping: a backslash
before each ``\\``, ``[`` and ``<`` of a text, so that no control string can be read inside
one; roles are escaped alike, with their ``]``, and of a kind only letters, digits, ``-`` and
``_`` are kept. :func:`parse_parts` inverts it and tells placeholders from texts that look
like them; :func:`parse` gives the texts alone. The loss mask lists the character spans of
assistant texts in the formatted string. Texts may have any length.

A null role is read as ``user``, a null text as empty; rows of one conversation are
ordered by turn, null turns first, ties by role and text, and all are kept, repeated ones
too. Rows with a null conversation id make one conversation under that id. Further columns
are ignored; an empty table gives an empty result. A conversation is formatted in one task,
as its string is one value.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

ESCAPED = re.compile(r"([\\\[<])")
UNESCAPED = re.compile(r"\\(.)", re.DOTALL)
TEXT = re.compile(r"(?:[^\\<]+|\\.)*", re.DOTALL)
PLACEHOLDER = re.compile(r"<\|([A-Za-z0-9_-]+):(\d+)\|>")
#: Characters of text for a token, and the tokens of a part whose size isn't given.
CHARS_A_TOKEN = 4
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


@dataclass
class Formatted:
    text: str = ""
    loss_spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)
    n_tokens: int = 0


def kind_of(part: dict) -> str:
    """The type of a part, as it may stand in a placeholder; a part without one is a text."""
    return re.sub(r"[^A-Za-z0-9_-]", "_", str(part.get("type") or "text"))


class PartVisitor:
    """Visits the parts of a conversation; a method for each type of part returns what stands for it in the string."""

    def __init__(self):
        self.attachments: list[tuple[int, str, str, int]] = []
        self.n_tokens = 0

    def visit(self, part: dict) -> str:
        kind = kind_of(part)
        return (self.text if kind == "text" else self.attachment)(kind, part)

    def text(self, kind: str, part: dict) -> str:
        value = part.get("text") or ""
        self.n_tokens += -(-len(value) // CHARS_A_TOKEN)
        return escape(value)

    def attachment(self, kind: str, part: dict) -> str:
        tokens = self.tokens(kind, part)
        number = len(self.attachments)
        self.attachments.append((number, kind, str(part.get("ref") or ""), tokens))
        self.n_tokens += tokens
        return f"<|{kind}:{number}|>"

    @staticmethod
    def tokens(kind: str, part: dict) -> int:
        """Image: patches of 14 x 14 pixels. Audio: 25 a second. Document: 500 a page."""
        if kind == "image" and part.get("width") and part.get("height"):
            return -(-int(part["width"]) // 14) * -(-int(part["height"]) // 14)
        if kind == "audio" and part.get("seconds"):
            return -(-int(float(part["seconds"]) * 1000) * 25 // 1000)
        if kind == "document" and part.get("pages"):
            return 500 * int(part["pages"])
        return DEFAULT_TOKENS.get(kind, 0)


def parts_of(content) -> list[dict]:
    """A string is one text part; a list is taken as parts; null is an empty text."""
    if content is None:
        return [{"type": "text", "text": ""}]
    return [{"type": "text", "text": content}] if isinstance(content, str) else list(content)


def format_turns(turns: Iterable[tuple[str | None, object]]) -> Formatted:
    out, visitor, pieces, at = Formatted(), PartVisitor(), [], 0
    for role, content in turns:
        role = "user" if role is None else role
        head = f"<s>[{escape(role).replace(']', chr(92) + ']')}]"
        pieces.append(head)
        at += len(head)
        for part in parts_of(content):
            piece = visitor.visit(part)
            if role == "assistant" and kind_of(part) == "text":
                out.loss_spans.append((at, at + len(piece)))
            pieces.append(piece)
            at += len(piece)
        pieces.append("[/]</s>")
        at += len("[/]</s>")
    out.text, out.attachments, out.n_tokens = "".join(pieces), visitor.attachments, visitor.n_tokens
    return out



def parse_parts(formatted: str) -> list[tuple[str, list[tuple[str, str | int]]]]:
    """``(role, parts)`` of each turn, read from the string alone; a part is ``("text", text)`` or ``(kind, number)`` of an attachment.
    Neighbouring texts are one."""
    turns, at, n = [], 0, len(formatted)
    while at < n:
        if not formatted.startswith("<s>[", at):
            raise ValueError(f"no turn begins at {at}")
        end = _end(formatted, at + 4, "]")
        role = unescape(formatted[at + 4 : end])
        close = _end(formatted, end + 1, "[/]</s>")
        parts, here = [], end + 1
        while here < close:
            if m := PLACEHOLDER.match(formatted, here, close):  # a text has no bare <
                parts.append((m[1], int(m[2])))
                here = m.end()
            else:
                to = TEXT.match(formatted, here, close).end()
                if to == here:
                    raise ValueError(f"no part begins at {here}")
                parts.append(("text", unescape(formatted[here:to])))
                here = to
        turns.append((role, parts))
        at = close + len("[/]</s>")
    return turns


def parse(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn; attachments are left out."""
    return [(role, "".join(p for kind, p in parts if kind == "text")) for role, parts in parse_parts(formatted)]


def _end(text: str, at: int, mark: str) -> int:
    """Where the mark first stands outside an escape."""
    while True:
        end = text.find(mark, at)
        if end < 0:
            raise ValueError(f"{mark} is missing behind {at}")
        back = end
        while back > at and text[back - 1] == "\\":
            back -= 1
        if (end - back) % 2 == 0:
            return end
        at = end + 1


def masked_text(formatted: str, spans: Iterable[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def _conversations(rows: DataFrame, content: str, conv_col: str, turn_col: str, role_col: str) -> DataFrame:
    picked = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{content}`").alias("content"))
    return picked.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "content"))).alias("turns"))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: bool = False) -> DataFrame:
    """``(conv_id, formatted, loss_spans, attachments, n_tokens, n_turns)`` of each conversation.

    With ``parts``, the content column holds a JSON list of typed parts; a content that isn't one is a text.
    """
    small_batches(rows.sparkSession)
    grouped = _conversations(rows, text_col, conv_col, turn_col, role_col)
    kind = grouped.schema["conv"].dataType.simpleString()

    def content(value):
        if parts and value is not None:
            try:
                made = json.loads(value)
            except ValueError:
                return value
            return made if isinstance(made, list) and all(isinstance(p, dict) for p in made) else value
        return value

    def make():
        def of_row(row):
            f = format_turns((t["role"], content(t["content"])) for t in row[1])
            spans = [{"begin": a, "end": b} for a, b in f.loss_spans]
            attached = [{"number": n, "kind": k, "ref": r, "n_tokens": t} for n, k, r, t in f.attachments]
            yield row[0], f.text, spans, attached, f.n_tokens, len(row[1])

        return of_row

    return map_rows(
        grouped, make,
        f"`{conv_col}` {kind}, formatted string, loss_spans array<struct<begin: bigint, end: bigint>>, attachments array<struct<number: bigint, kind: string, ref: string, n_tokens: bigint>>, n_tokens bigint, n_turns bigint",
    )


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what the formatted strings and their loss masks hold."""

    def make():
        def of_row(row):
            turns = parse(row[1])
            shown = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = masked_text(row[1], [(s["begin"], s["end"]) for s in row[2]])
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            yield row[0], len(turns), sha(shown), len(loss), sha(loss), len(row[1]), len(row[3]), row[4]

        return of_row

    rows = formatted.select(conv_col, "formatted", "loss_spans", "attachments", "n_tokens")
    kind = rows.schema[conv_col].dataType.simpleString()
    return map_rows(rows, make, f"`{conv_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, n_tokens bigint")
