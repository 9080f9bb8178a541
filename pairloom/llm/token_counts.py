"""Token counts by the whole-token shortcut.

Offline, every vocabulary string that may be a whole pre-token is encoded alone; those that
give exactly their own id are proven to be one token. In texts, a pre-token of that set counts
one without being merged; everything else goes through the tokenizer's merges.

White space never is part of a pre-token here (the tokenizer drops it), so texts are taken
apart at spaces, tabs and newlines, which all engines agree are white space, and pieces are
counted one by one. The tokenizer's own normaliser lower-cases, so a piece of ASCII letters is
looked up in lower case. Pieces with anything else in them are counted by the tokenizer itself:
contractions, special strings (one token each, its default) and characters to be composed.

* Null texts count as empty: no bytes, no tokens.
* Texts are counted whole, whatever their length; repeated rows are counted one by one.
* Further columns are ignored; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from pairloom.llm.common import hold, prepare, texts_of, two_columns

LIMIT = 2048
CACHED_PIECES = 400_000
WORD_END = "</w>"
_LETTERS = re.compile("[a-z]+")
_COUNTERS: dict[str, PieceCounter] = {}


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """ASCII words that the tokenizer, given the word alone, encodes as the one token of that word.

    Bounded by the vocabulary.
    """
    vocabulary = tokenizer.get_vocab()
    words = [t.removesuffix(WORD_END) for t in vocabulary if t.endswith(WORD_END) and _LETTERS.fullmatch(t.removesuffix(WORD_END))]
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, encoded) if e.ids == [vocabulary[w + WORD_END]])


class PieceCounter:
    """Counts of pieces between white space; recurring pieces are kept, up to a bound."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = whole_tokens(self.tokenizer)
        self.known: dict[str, int] = {"": 0}

    def count_all(self, texts: list[str | None]) -> list[int]:
        counts = [0] * len(texts)
        pieces = [t.replace("\n", " ").replace("\t", " ").split(" ") if t else [] for t in texts]
        rest: dict[str, list[int]] = {}
        get, whole = self.known.get, self.whole
        for i, own in enumerate(pieces):
            found = list(map(get, own))
            if None in found:
                for j, n in enumerate(found):
                    if n is None:
                        piece = own[j]
                        if piece.isascii() and piece.isalpha() and piece.lower() in whole:
                            found[j] = self._keep(piece, 1)
                        else:
                            rest.setdefault(piece, []).append(i)
                            found[j] = 0
            counts[i] = sum(found)
        if rest:
            # The tokenizer merges what is left, each piece once for these texts.
            order = list(rest)
            for lo in range(0, len(order), 20_000):
                part = order[lo : lo + 20_000]
                for piece, encoding in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    n = len(encoding)
                    self._keep(piece, n)
                    for i in rest[piece]:
                        counts[i] += n
        return counts

    def _keep(self, piece: str, n: int) -> int:
        if len(piece) < 64:
            if len(self.known) >= CACHED_PIECES:
                self.known.clear()
                self.known[""] = 0
            self.known[piece] = n
        return n


def piece_counter(path: str) -> PieceCounter:
    """One per Python worker."""
    hold("token_counts", _COUNTERS.clear)
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in batches:
            texts = texts_of(batch)
            n_tokens = counter.count_all(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``: UTF-8 bytes, tokens, and whether these exceed ``limit``."""
    prepare(docs.sparkSession)
    rows = two_columns(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_count(tokenizer_path, limit), f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
