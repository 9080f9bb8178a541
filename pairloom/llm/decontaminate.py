"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

Every window of consecutive benchmark words is a pattern. A document's text is normalised
once, byte by byte, and scanned once; matches are given as word ranges and as offsets into
the original text.

* Normalising: A-Z to lower case; a word is a run of digits, a-z and characters beyond ASCII.
* An item of fewer words than a window, but not none, is one pattern as a whole.
* Null and empty texts have no words and match nothing; items without words have no pattern.
* Repeated items and documents are treated row by row; an item without an id marks words but
  is not listed. Further columns of either table are ignored.
* The benchmark's patterns are held in automata of at most ``CHUNK_BYTES`` pattern bytes each.
  A larger benchmark is cut into several; documents then pass through them one after another,
  within the same task, without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import bytes_of, hold, prepare, two_columns

WINDOW_WORDS = 10
CHUNK_BYTES = 2_000_000

# Bytes of words stay (in lower case), all others become spaces.
_NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_AUTOMATA: dict[str, ahocorasick.Automaton | None] = {}

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = (
    "id {id}, n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string,"
    " spans array<struct<start:bigint,end:bigint>>, contaminated boolean"
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def _windows(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, counts, items = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), bytes_of(batch)):
                words = words_of(text)
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    window = words[i : i + size]
                    patterns.append(b" " + b" ".join(window) + b" ")
                    counts.append(len(window))
                    items.append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(patterns, pa.binary()), pa.array(counts, pa.int32()), pa.array(items, pa.string())],
                names=["pattern", "n", "item"],
            )

    return emit


def _automaton(name: str, rows) -> ahocorasick.Automaton | None:
    """Built once per Python worker."""
    hold("decontaminate", _AUTOMATA.clear)
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        found: dict[str, tuple[int, set]] = {}
        for pattern, n, item in rows:
            found.setdefault(pattern.decode("latin-1"), (n, set()))[1].add(item)
        automaton = ahocorasick.Automaton()
        for pattern, (n, items) in found.items():
            automaton.add_word(pattern, (n, tuple(i for i in items if i is not None)))
        if found:
            automaton.make_automaton()
        _AUTOMATA[name] = automaton if found else None
    return _AUTOMATA[name]


def _scan_text(automaton, text: bytes | None, hit: list[int], items: set[str]) -> None:
    """Add the ranges of words, and the items, that the automaton finds."""
    words = words_of(text)
    if not words or automaton is None:
        return
    joined = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(joined.decode("latin-1")))
    if not found:
        return
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    after = np.searchsorted(spaces, [end for end, _ in found])
    for stop, (_, (n, named)) in zip(after.tolist(), found):
        hit += (stop - n, stop)
        items.update(named)


def _spans(text: bytes, marked: np.ndarray) -> list[dict[str, int]]:
    """Runs of marked words as code point offsets into the text."""
    buffer = np.frombuffer(text.translate(_NORMAL), np.uint8)
    inside = np.concatenate(([False], buffer != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    runs = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return [
        {"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in zip(runs[0::2].tolist(), runs[1::2].tolist())
    ]


def _scan(name: str, broadcast, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, broadcast.value)
        for batch in batches:
            texts = bytes_of(batch)
            hits, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, text in enumerate(texts):
                hit, named = list(hits[i] or ()), set(items[i] or ())
                _scan_text(automaton, text, hit, named)
                hits[i], items[i] = hit, sorted(named)
            if not last:
                columns = [batch.column(0), batch.column(1), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "hits", "items"])
                continue
            n_words, n_hit, spans = [], [], []
            for text, hit in zip(texts, hits):
                count = len(words_of(text))
                n_words.append(count)
                if not hit:
                    n_hit.append(0)
                    spans.append([])
                    continue
                steps = np.zeros(count + 1, np.int64)
                np.add.at(steps, hit[0::2], 1)
                np.add.at(steps, hit[1::2], -1)
                marked = np.cumsum(steps[:-1]) > 0
                n_hit.append(int(marked.sum()))
                spans.append(_spans(text, marked))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array(spans, SPANS),
                    pa.array([n > 0 for n in n_hit], pa.bool_()),
                ],
                names=["id", "n_words", "n_hit", "n_items", "items", "items_sha256", "spans", "contaminated"],
            )

    return run


def _chunks(items: DataFrame, item_id_col: str, item_text_col: str, window: int, chunk_bytes: int) -> Iterator[tuple[str, list, bool]]:
    """Name and patterns of each automaton, and whether it is the last; at most about ``chunk_bytes`` reach the driver at once."""
    patterns = (
        two_columns(items, item_id_col, item_text_col)
        .withColumn("id", F.col("id").cast("string"))
        .mapInArrow(_windows(window), "pattern binary, n int, item string")
        .distinct()
    )
    total = patterns.agg(F.sum(F.length("pattern") + F.coalesce(F.length("item"), F.lit(0)))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    for chunk in range(chunks):
        rows = patterns.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(chunks)) == chunk).collect()
        yield uuid.uuid4().hex, [(bytes(r["pattern"]), r["n"], r["item"]) for r in rows], chunk == chunks - 1


def find_benchmark_passages(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Words, hit words, items met, their digest and hit spans of each document, under ``id``."""
    spark = prepare(docs.sparkSession)
    scanned = two_columns(docs, id_col, text_col)
    kind = scanned.schema["id"].dataType.simpleString()
    scanned = scanned.withColumns({"hits": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>")})
    for name, rows, last in _chunks(items, item_id_col, item_text_col, window, chunk_bytes):
        schema = RESULT.format(id=kind) if last else f"id {kind}, text string, hits array<int>, items array<string>"
        scanned = scanned.mapInArrow(_scan(name, spark.sparkContext.broadcast(rows), last), schema)
    return scanned


def _clean(name: str, broadcast, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, broadcast.value)
        for batch in batches:
            keep = []
            for text in bytes_of(batch, text_col):
                hit: list[int] = []
                _scan_text(automaton, text, hit, set())
                keep.append(not hit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def without_benchmark_passages(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The rows, with all their columns, whose texts hold no window of the benchmark."""
    spark = prepare(docs.sparkSession)
    for name, rows, _ in _chunks(items, item_id_col, item_text_col, window, chunk_bytes):
        docs = docs.mapInArrow(_clean(name, spark.sparkContext.broadcast(rows), text_col), docs.schema)
    return docs
