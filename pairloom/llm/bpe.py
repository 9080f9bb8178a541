"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every byte prefix of a pre-token there is exactly one last token its encoding can end
in. ``PrefixCoder`` stores these: the last token of a prefix is the one token that is a
suffix of it and *compatible* with the last token of what lies before, that is, the two
tokens encode to themselves when joined. Following last tokens backwards gives the encoding
of any prefix, so appended bytes continue where the table ends, and an edit recomputes the
table only from the edited byte on.

Ranks are those of a ``.tiktoken`` file: lines of base64 bytes and rank. Each match of the
pattern is encoded by itself; a match that is a token as a whole is that token.

* Null texts count as empty: no ids, empty decoded bytes.
* Texts of any length are encoded whole; repeated rows are encoded one by one.
* Further columns are ignored; only the id and text columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pairloom.llm.common import hold, prepare, texts_of, two_columns

CACHED_PIECES = 300_000
CACHED_PAIRS = 2_000_000
LONG = 64  # bytes; longer pre-tokens fill the table forwards, without recursion
START = 1 << 31  # stands before the first byte
_TOP = 1 << 62
_CODERS: dict[tuple[str, str], TextCoder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixTable:
    """The unique last token of every prefix of some bytes."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", [START]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: tokens of earlier prefixes stand, only later prefixes are added."""
        first = len(self.data) + 1
        self.data += data
        self.last += [-1] * len(data)
        self.coder.extend(self.data, self.last, first)

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replace a range of bytes; prefixes up to ``start`` are kept."""
        rest = data + self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(rest)

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the first ``length`` bytes."""
        at, found = len(self.data) if length is None else length, []
        while at:
            found.append(token := self.last[at])
            at -= self.coder.sizes[token]
        return found[::-1]


class PrefixCoder:
    """Last tokens of prefixes, for one set of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        #: The longest token for the last two bytes, or the one byte, that it ends in.
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            self.reach[token[-2:]] = max(self.reach.get(token[-2:], 1), len(token))
        self._trees: dict[int, tuple] = {}
        self._fits: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost among equals; for tokens and pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], _TOP), i) for i in range(len(parts) - 1))
            if best == _TOP:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _tree(self, token: int) -> tuple[bool, bool, list, list]:
        """Whether merging reaches the token, whether ranks rise on the way, and its left and right edges.

        An edge lists, from the byte up to the token, each part at that end and the rank at
        which the next larger part swallows it.
        """
        known = self._trees.get(token)
        if known is not None:
            return known
        data = self.tokens[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        left, right, before, rising = [], [], -1, True
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], _TOP), i) for i in range(len(parts) - 1))
            if best == _TOP:
                break
            rising &= best >= before
            before = best
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        reached = len(parts) == 1
        left.append((parts[0], _TOP))
        right.append((parts[-1], _TOP))
        self._trees[token] = tree = (reached, rising, left, right)
        return tree

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens, joined, encode to themselves.

        While both tokens are built, the part at the end of the first and the part at the
        start of the second stand side by side until one of them is swallowed. They break
        the pair if they would merge with each other earlier than that; among equal ranks
        the merge further left comes first.
        """
        key = before << 32 | token
        known = self._fits.get(key)
        if known is not None:
            return known
        reached, also, left, _ = self._tree(token)
        _, rising, _, right = self._tree(before) if before != START else (True, True, [], [])
        if before == START:
            answer = reached
        elif not (reached and rising and also):
            answer = self.merged(self.tokens[before] + self.tokens[token]) == [self.tokens[before], self.tokens[token]]
        else:
            i = j = 0
            answer = True
            while True:
                a, a_gone = right[i]
                b, b_gone = left[j]
                rank = self.ranks.get(a + b, _TOP)
                if rank < a_gone and rank <= b_gone and rank != _TOP:
                    answer = False
                    break
                if a_gone == b_gone == _TOP:
                    break
                if a_gone <= b_gone:
                    i += 1
                else:
                    j += 1
        if len(self._fits) >= CACHED_PAIRS:
            self._fits.clear()
        self._fits[key] = answer
        return answer

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The last token of a prefix; ``last`` holds those of the prefixes already known, else -1.

        Suffixes are tried longest first. The prefixes before them are settled on the way, and only
        those that a suffix leads to.
        """
        ranks, known = self.ranks, self._fits
        for start in range(max(0, end - self.reach.get(data[max(0, end - 2) : end], 1)), end):
            token = ranks.get(data[start:end])
            if token is None:
                continue
            before = last[start]
            if before < 0:
                before = self.last_token(data, start, last)
            answer = known.get(before << 32 | token)
            if answer if answer is not None else self.fits(before, token):
                last[end] = token
                return token
        raise ValueError("the ranks do not hold every byte")

    def extend(self, data: bytes, last: list[int], first: int) -> None:
        """Settle the prefixes from length ``first`` on, shortest first."""
        for end in range(first, len(data) + 1):
            self.last_token(data, end, last)

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        at, found = len(data), []
        if at > LONG:
            return PrefixTable(self, data).ids()
        last = [START] + [-1] * at
        self.last_token(data, at, last)
        while at:
            found.append(token := last[at])
            at -= self.sizes[token]
        return found[::-1]


class TextCoder:
    """Whole texts: pre-tokens by a pattern, each encoded by itself, with bounded memory of what recurs.

    A space between two characters that are not white space always starts a pre-token of the
    pattern and no pre-token reaches across it, so such texts are taken apart at spaces and
    each piece, with its space, is looked up. Any other text goes through the pattern whole.
    """

    def __init__(self, path: str, pattern: str):
        self.coder = PrefixCoder(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ids(self, data: bytes) -> bytes:
        ids = self.coder.encode(data)
        return pack(f"<{len(ids)}I", *ids)

    def _match(self, text: str) -> bytes:
        words, found = self.words, []
        for word in self.pattern.findall(text):
            known = words.get(word)
            if known is None:
                known = self._ids(word.encode())
                if len(word) < 64:
                    if len(words) >= CACHED_PIECES:
                        words.clear()
                    words[word] = known
            found.append(known)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = text.split(" ")
        if len(parts) < 3:
            return self._match(text)
        first = parts.pop(0)
        pieces = self.pieces
        found = list(map(pieces.get, parts))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    part = parts[i]
                    if not part or part[0].isspace():
                        return self._match(text)
                    known = pieces.get(part)
                    if known is None:
                        # Letters alone are one pre-token.
                        known = self._ids((" " + part).encode()) if part.isalpha() else self._match(" " + part)
                        if len(part) < 64:
                            if len(pieces) >= CACHED_PIECES:
                                pieces.clear()
                            pieces[part] = known
                    found[i] = known
        return self._match(first) + b"".join(found)


def text_coder(path: str, pattern: str) -> TextCoder:
    """One per Python worker."""
    hold("bpe", _CODERS.clear)
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = TextCoder(path, pattern)
    return _CODERS[path, pattern]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path, pattern)
        for batch in batches:
            packed = [coder.encode(t) if t else b"" for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = text_coder(path, pattern).coder.tokens
        for batch in batches:
            decoded = [b"".join(map(tokens.__getitem__, np.frombuffer(p or b"", "<u4").tolist())) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    return run


def _as_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(p, "<u4").astype(np.int32) for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["id", "ids"])


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.asarray(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "ids"])


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False
) -> DataFrame:
    """``(id, ids)``: ids as array<int>, or packed as little-endian unsigned 32-bit integers."""
    prepare(docs.sparkSession)
    rows = two_columns(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    encoded = rows.mapInArrow(_encode(ranks_path, pattern), f"id {kind}, ids binary")
    return encoded if packed else encoded.mapInArrow(_as_list, f"id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, ids, decoded)``: the bytes that the ids stand for; an unknown id fails."""
    prepare(encoded.sparkSession)
    rows = encoded.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids")
    kind = rows.schema["id"].dataType.simpleString()
    if rows.schema["ids"].dataType.simpleString() != "binary":
        rows = rows.mapInArrow(_as_bytes, f"id {kind}, ids binary")
    return rows.mapInArrow(_decode(ranks_path, pattern), f"id {kind}, ids binary, decoded binary")


def _round_trip(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path, pattern)
        tokens = coder.coder.tokens
        for batch in batches:
            packed = [coder.encode(t) if t else b"" for t in texts_of(batch)]
            decoded = [b"".join(map(tokens.__getitem__, np.frombuffer(p, "<u4").tolist())) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    return run


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)``: packed ids, and the bytes they stand for, by one worker that holds one table."""
    prepare(docs.sparkSession)
    rows = two_columns(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_round_trip(ranks_path, pattern), f"id {kind}, ids binary, decoded binary")
