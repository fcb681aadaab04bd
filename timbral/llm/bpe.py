"""Byte-level BPE encoding and decoding.

The merge table is compiled, lazily, into a deterministic transducer over bytes.
Three facts carry it. A sequence of tokens is the encoding of its bytes exactly if
each two neighbours are the encoding of their joined bytes. So each prefix of a
word has one last token: the one that is compatible with the last token of the
prefix before it. And only a start position whose bytes so far are a proper prefix
of some token can still begin the next token. A state therefore is the list of live
start positions, each as its vocabulary-trie node and the last token before it; a
transition also gives the last token of the prefix that ends there. The tokens that
lead to all live positions are certain and are emitted; the lookahead is bounded by
the longest token. States and transitions are made on first use, kept in a table and
dropped when the table is full, so memory is bounded.

Decoding concatenates the tokens' bytes; :class:`Utf8Stream` turns a stream of
byte pieces into text by a state machine that holds at most three pending bytes.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, narrow, small_batches, tidy


#: Tokens whose bytes the streaming decoder takes at once where a whole text is decoded.
FED_AT_ONCE = 512

#: Tables of a tokenizer in a task that holds nothing else: some 200 MB, and a fifth less time than with the defaults, which take 160.
WIDE = {"max_words": 300_000, "max_states": 200_000}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encodes one word (a match of the splitting pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.next: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        self.depth: list[int] = [0]
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.length.values())
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                if key not in self.next:
                    self.next[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = self.next[key]
            self.token_at[node] = rank
        self.fits: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, ...]] = {}  # of tokens, so no more than the vocabulary
        self.reset()

    def reset(self) -> None:
        start = ((0, -1),)
        self.states, self.ids = [start], {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merge(self, piece: bytes, left: int = 1) -> tuple[int, ...]:
        """Plain merging by rank until so many parts are left, or none merge; used on single tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > left:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def halves(self, token: int) -> tuple[int, ...]:
        """The two tokens whose merge made this one; itself, if it is a byte; more, if its own bytes never become it."""
        known = self.parts.get(token)
        if known is None:
            known = self.parts[token] = self.merge(self.bytes_of[token], 2)
        return known

    def apart(self, before: int, token: int) -> bool:
        """Whether no merge crosses the border of the two, seen backwards: the later merge of both is undone again and again.
        What faces each other before it would have merged instead if its rank is lower, or equal and further left."""
        limit = 1 << 60
        while True:
            if self.ranks.get(self.bytes_of[before] + self.bytes_of[token], limit) < limit:
                return False
            left, right = self.halves(before), self.halves(token)
            if len(left) == 2 and (len(right) == 1 or before > token):
                limit, before = before, left[1]
            elif len(right) == 2:
                limit, token = token + 1, right[0]
            else:
                return True

    def follows(self, before: int, token: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes (before -1: whether the token is its own)."""
        if before < 0:
            return len(self.halves(token)) <= 2
        key = before << 32 | token
        known = self.fits.get(key)
        if known is None:
            known = self.follows(-1, token) and self.apart(before, token)
            if len(self.fits) > 2 * self.max_states:
                self.fits.clear()
            self.fits[key] = known
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The transition by one byte: the next state and the last token of the prefix that ends there."""
        live, last = [], -1
        for node, before in self.states[state]:
            to = self.next.get(node << 8 | byte)
            if to is None:
                continue
            token = self.token_at[to]
            if last < 0 <= token and self.follows(before, token):
                last = token
            if self.inner[to]:
                live.append((to, before))
        if last < 0:
            raise ValueError("the rank table lacks a single byte")
        key = (*live, (0, last))
        number = self.ids.get(key)
        if number is None:
            number = self.ids[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = out = (number, last)
        return out

    def _back(self, lasts: list[int], end: int) -> list[tuple[int, int]]:
        """``(end position, token)`` of the tokens before ``end``, last first."""
        out = []
        while end > 0:
            out.append((end, lasts[end - 1]))
            end -= self.length[lasts[end - 1]]
        return out

    def emit(self, piece: Iterable[int]) -> Iterator[int]:
        """Tokens of a word of any length as soon as all live start positions agree on them."""
        state, lasts, moves = 0, [], self.moves
        for byte in piece:
            state, last = moves.get(state << 8 | byte) or self.move(state, byte)
            lasts.append(last)
            if len(lasts) >= 4 * self.longest:
                here = len(lasts)
                chains = [self._back(lasts, here - self.depth[node]) for node, _ in self.states[state]]
                sure = set(chains[0]).intersection(*chains[1:])
                if sure:
                    cut = max(sure)[0]
                    yield from (token for _, token in reversed(self._back(lasts, cut)))
                    del lasts[:cut]
        yield from (token for _, token in reversed(self._back(lasts, len(lasts))))

    def encode_word(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(self.states) > self.max_states:
            self.reset()
        if len(piece) > 8 * self.longest:
            return tuple(self.emit(piece))
        state, lasts, moves = 0, [], self.moves
        for byte in piece:
            state, last = moves.get(state << 8 | byte) or self.move(state, byte)
            lasts.append(last)
        end, out, length = len(lasts), [], self.length
        while end > 0:
            out.append(last := lasts[end - 1])
            end -= length[last]
        return tuple(reversed(out))


class _Words(dict):
    """Encodings of short words that were met before, in two generations: a full young one replaces the old one."""

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer, self.most, self.old = transducer, most, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word) or self.transducer.encode_word(word.encode("utf-8"))
        if len(word) <= 40:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the text that is complete, ``close`` ends the stream.

    The state is the number of continuation bytes still due and the range allowed for
    the next one. An ill-formed sequence gives U+FFFD once for its longest valid start.
    """

    def __init__(self):
        self.held, self.due, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.due:
            end = len(data)
            while end > max(0, len(data) - 3) and data[end - 1] & 0xC0 == 0x80:
                end -= 1
            end -= bool(end and data[end - 1] >= 0xC0)  # before the last character that isn't ASCII, which may be incomplete
            try:
                ready = data[:end].decode("utf-8")
            except UnicodeDecodeError:
                return self._step(data)
            return ready + self._step(data[end:]) if end < len(data) else ready
        return self._step(data)

    def _step(self, data: bytes) -> str:
        """The state machine, byte by byte: ends of pieces and ill-formed data."""
        out: list[str] = []
        at, n = 0, len(data)
        while at < n:
            byte = data[at]
            if self.due:
                if self.low <= byte <= self.high:
                    self.held.append(byte)
                    self.due, self.low, self.high, at = self.due - 1, 0x80, 0xBF, at + 1
                    if not self.due:
                        out.append(self.held.decode("utf-8"))
                        self.held.clear()
                else:
                    out.append("�")
                    self.held.clear()
                    self.due, self.low, self.high = 0, 0x80, 0xBF
            elif byte < 0x80:
                end = at + 1
                while end < n and data[end] < 0x80:
                    end += 1
                out.append(data[at:end].decode("ascii"))
                at = end
            else:
                at += 1
                if 0xC2 <= byte <= 0xDF:
                    self.due = 1
                elif 0xE0 <= byte <= 0xEF:
                    self.due, self.low, self.high = 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
                elif 0xF0 <= byte <= 0xF4:
                    self.due, self.low, self.high = 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
                else:
                    out.append("�")
                    continue
                self.held.append(byte)
        return "".join(out)

    def close(self) -> str:
        left = "�" if self.due else ""
        self.__init__()
        return left


class ByteBPE:
    """A tokenizer: a splitting pattern and a rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_words: int = 120_000, max_states: int = 100_000):
        self.transducer = Transducer(ranks, max_states)
        self.split = regex.compile(pattern).findall
        self.words = _Words(self.transducer, max_words)
        self.bytes_of = self.transducer.bytes_of

    def encode(self, text: str | None) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.words.__getitem__, self.split(text or ""))))

    def decode_stream(self, ids: Iterable[int], width: int = 1) -> Iterator[str]:
        """Text pieces, each as soon as it is certain; width tokens are fed at once."""
        stream, ids = Utf8Stream(), iter(ids)
        while some := list(itertools.islice(ids, width)):
            if piece := stream.feed(b"".join(map(self.bytes_of.__getitem__, some))):
                yield piece
        if piece := stream.close():
            yield piece


def _tokenizer(data: bytes, pattern: str, **sizes: int) -> ByteBPE:
    """One for each task: Spark hands tasks to its idle Python workers in turn, and kept tables would add up over all of them."""
    return ByteBPE(parse_ranks(data), pattern, **sizes)


def load(path: str, pattern: str) -> ByteBPE:
    with open(path, "rb") as file:
        return _tokenizer(file.read(), pattern)


def _shared(df: DataFrame, path: str):
    """The rank file as a broadcast: its size is the vocabulary's, whatever the corpus is."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, n_tokens)`` of each row.

    Null and empty texts: no tokens. Texts are taken whole; rows are independent, so repeated
    rows, ties and further columns have no effect, and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    data = _shared(docs, path)

    def make():
        encode = _tokenizer(data.value, pattern).encode
        return lambda row: ((row[0], ids := encode(row[1]), len(ids)),)

    rows = narrow(docs, **{"id": id_col, "text": text_col})
    kind = rows.schema["id"].dataType.simpleString()
    return map_rows(rows, make, f"`{id_col}` {kind}, ids array<int>, n_tokens bigint")


def decode_documents(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)``: the ids through the streaming decoder. Null ids: empty text."""
    small_batches(tokens.sparkSession)
    data = _shared(tokens, path)

    def make():
        stream = _tokenizer(data.value, pattern).decode_stream
        return lambda row: ((row[0], "".join(stream(row[1] or ()))),)

    rows = narrow(tokens, **{"id": id_col, "ids": ids_col})
    kind = rows.schema["id"].dataType.simpleString()
    return map_rows(rows, make, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding, then streaming decoding of the ids, with digests in place of ids and bytes, so that neither crosses to the JVM.

    Nulls, empty and long texts, repeated rows, further columns and empty tables are as in :func:`encode_documents`.
    """
    small_batches(docs.sparkSession)
    data = _shared(docs, path)

    def make():
        tokenizer = _tokenizer(data.value, pattern, **WIDE)
        names = {rank: str(rank) for rank in tokenizer.bytes_of}

        def of_row(row):
            ids = tokenizer.encode(row[1])
            listed = ",".join(map(names.__getitem__, ids)).encode()
            decoded = hashlib.sha256()
            for piece in tokenizer.decode_stream(ids, FED_AT_ONCE):
                decoded.update(piece.encode("utf-8"))
            yield row[0], len(ids), hashlib.sha256(listed).hexdigest(), decoded.hexdigest()

        return of_row

    rows = narrow(docs, **{"id": id_col, "text": text_col})
    kind = rows.schema["id"].dataType.simpleString()
    return map_rows(rows, make, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def replace_text(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The rows with ``ids`` and ``n_tokens`` in place of the text, and whether streaming decoding gives the text again (``round_trip``).

    Other columns of these names are replaced. A null text counts as empty; nothing else of a row matters; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    data = _shared(docs, path)
    at = docs.columns.index(text_col)
    rest = [f for f in docs.schema if f.name not in (text_col, "ids", "n_tokens", "round_trip")]
    kept = [docs.columns.index(f.name) for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(data.value, pattern)
        for batch in (whole.slice(i, 40) for whole in batches for i in range(0, whole.num_rows, 40)):  # ids as Python lists take much room
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids = [tokenizer.encode(t) for t in texts]
            same = ["".join(tokenizer.decode_stream(i, FED_AT_ONCE)) == t for t, i in zip(texts, ids)]
            columns = [batch.column(i) for i in kept]
            made = [pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + made, names=[f.name for f in rest] + ["ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(tidy(run), T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]))
