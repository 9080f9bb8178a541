"""Token ids in Parquet files, laid out for selective reads.

One row per document, in ascending order of its id: the id, the file part it belongs to, the
number of ids before it in that part, its own number of ids and the ids as a list column.
Scalars are delta encoded, ids dictionary encoded within each column chunk (delta encoded past
the dictionary's size), row groups and pages are bounded, and the writer adds page indexes. A
reader of the scalars touches no ids, and a range of documents touches the pages that hold it.

Parts follow the order of ids, so a document's place among all ids is the sum of the parts
before its own, at most a few thousand numbers, plus the place within the part.

* Null texts count as empty; such a document still has the end id.
* Rows with the same id are kept, ordered by their texts; rows without an id come first.
* Further columns are ignored; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.common import hold, prepare, two_columns

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 5_000
CACHED_PIECES = 400_000
SLICE_BYTES = 8 << 20
ODD_SPACES = ("  ", " \n", "\n ")  # the common ones; others are found piece by piece
SPACE_LETTER = "\u0120"  # fixed value: the letter of the space byte
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which may start a contraction
LATIN_END = "\u0250"  # beyond it, letters may be newer to one engine than to another
_ENCODERS: dict[str, PieceEncoder] = {}
_ID = attrgetter("id")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabulary: printable ones themselves, others from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces:
    """Ids by piece, not of long ones: the last ``CACHED_PIECES`` put here at least, and twice as many at most."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, piece: str) -> bytes | None:
        ids = self.young.get(piece)
        if ids is None and (ids := self.old.get(piece)) is not None:
            self.put(piece, ids)
        return ids

    def put(self, piece: str, ids: bytes) -> None:
        if len(piece) < 64:
            if len(self.young) >= CACHED_PIECES:
                self.young, self.old = {}, self.young
            self.young[piece] = ids


def _unspaced(piece: str) -> bool:
    """Not empty, and no white space at its ends."""
    return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()


def _is_word(piece: str) -> bool:
    """A word of Latin letters."""
    return piece.isalpha() and (piece.isascii() or max(piece) < LATIN_END)


class PieceEncoder:
    """Ids by the library, which gets each recurring piece once.

    A space between two characters that are not white space starts a pre-token, so texts whose
    spaces all are of that kind are taken apart there. A piece is taken apart further at line
    feeds between two such characters and before the marks that follow a word. A word of Latin
    letters is one pre-token and goes to the library's model; what is none of this goes to the
    whole tokenizer. Texts with other spaces, or with a special string in them, do so whole.

    Texts are taken apart, and their ids put together, a batch at a time in columns; only the
    distinct pieces of a batch are looked up one by one.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Pieces are kept here; the model's own small cache, soon full, would only be searched in vain.
        self.tokenizer.model._resize_cache(0)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsplit = "|".join(rf"\Q{s}\E" for s in (*self.special, *ODD_SPACES))
        self.letters = byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        self.after_space = Pieces()
        self.at_start = Pieces()
        self.feed = self._library("\n")

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str, space: str) -> bytes:
        """One pre-token, through the model alone."""
        written = (SPACE_LETTER if space else "") + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return array("I", map(_ID, self.tokenize(written))).tobytes()

    def _piece(self, piece: str, space: str) -> bytes:
        """A piece without white space at its ends; remembered."""
        known = self.after_space if space else self.at_start
        if _is_word(piece):
            ids = self._word(piece, space)
        else:
            head = piece.rstrip(MARKS)
            if len(head) < len(piece) and _is_word(head):
                marks = piece[len(head) :]
                ids = (known.get(head) or self._piece(head, space)) + (self.at_start.get(marks) or self._piece(marks, ""))
            elif "\n" in piece and all(map(_unspaced, lines := piece.split("\n"))):
                ids = known.get(lines[0]) or self._piece(lines[0], space)
                for line in lines[1:]:
                    ids += self.feed + (self.at_start.get(line) or self._piece(line, ""))
                return ids
            else:
                ids = self._library(space + piece)
        known.put(piece, ids)
        return ids

    def _start(self, piece: str) -> bytes:
        """What stands before the first space of a text."""
        if not _unspaced(piece):
            return self._library(piece) if piece else b""
        return self.at_start.get(piece) or self._piece(piece, "")

    def _after_space(self, pieces: list[str], wanted: np.ndarray) -> tuple[list[bytes], list[int]]:
        """Ids of the wanted ones of distinct pieces, and the places of those that have other spaces beside them."""
        known = self.after_space
        found, odd = list(map(known.young.get, pieces)), []
        missing = [j for j, (ids, want) in enumerate(zip(found, wanted.tolist())) if ids is None and want]
        # Words one after another, so that the model's tables stay in the processor's caches.
        words = [w for w in map(pieces.__getitem__, missing) if w not in known.old and _is_word(w)]
        new = dict(zip(words, [self._word(w, " ") for w in words]))
        for j in missing:
            piece = pieces[j]
            ids = new.get(piece)
            if ids is not None:
                known.put(piece, ids)
            elif _unspaced(piece):
                ids = known.get(piece) or self._piece(piece, " ")
            else:
                odd.append(j)
            found[j] = ids
        return [ids or b"" for ids in found], odd

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, and the number of each text's ids; a null text has none."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.unsplit).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        coded = split.values.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        opening = index[firsts]
        index[firsts] = len(pieces) + np.arange(len(texts))
        wanted = np.zeros(len(pieces) + len(texts), bool)
        wanted[index] = True
        found, odd = self._after_space(pieces, wanted)
        if odd:
            beside = np.zeros(len(wanted), bool)
            beside[odd] = True
            whole |= np.logical_or.reduceat(beside[index], firsts)
            index = index[~np.repeat(whole, counts) | (index >= len(pieces))]
            counts = np.where(whole, 1, counts)
            firsts = np.cumsum(counts) - counts
        for i, (j, apart) in enumerate(zip(opening.tolist(), (~whole).tolist())):
            found.append(self._start(pieces[j]) if apart else self._library(texts[i].as_py()))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        at = np.repeat(starts[index] - (ends - lengths), lengths) + np.arange(ends[-1])
        return np.frombuffer(b"".join(found), "<u4")[at], np.add.reduceat(lengths, firsts)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.encode_array(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def encode(self, text: str | None) -> bytes:
        """As ``encode_all`` for one text, without the cost of columns."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._library(text)
        first, *parts = text.split(" ")
        found = list(map(self.after_space.young.get, parts))
        for j in [j for j, ids in enumerate(found) if ids is None]:
            if not _unspaced(parts[j]):
                return self._library(text)
            found[j] = self.after_space.get(parts[j]) or self._piece(parts[j], " ")
        return self._start(first) + b"".join(found)


def piece_encoder(path: str) -> PieceEncoder:
    """One per Python worker."""
    hold("token_files", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, in slices of about as many bytes of text, whole texts each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    number = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        before, part = 0, None
        for batch in (s for whole in batches if whole.num_rows for s in _slices(whole)):
            if part is None:
                part = batch.column(2)[0].as_py()
            ids, counts = encoder.encode_array(batch.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            sizes = counts + 1
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(before + ends - sizes), pa.array(sizes), lists],
                names=["id", "part", "place", "n_tokens", "ids"],
            )
            before += int(ends[-1])

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> None:
    """Encode every text, append ``end_id`` and write the files under ``path``, in ascending id order."""
    spark = prepare(docs.sparkSession)
    rows = two_columns(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        rows.repartitionByRange(parts, "id", F.xxhash64("text"))
        .sortWithinPartitions("id", F.xxhash64("text"), "text")
        .withColumn("part", F.spark_partition_id())
    )
    encoded = ordered.mapInArrow(_encode(tokenizer_path, end_id), f"id {kind}, part int, place bigint, n_tokens bigint, ids array<int>")
    (
        encoded.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(path)
    )


def read_token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(id, part, place, n_tokens, start)`` without touching ids; ``start`` counts all ids before."""
    rows = spark.read.parquet(path).select("id", "part", "place", "n_tokens")
    return _with_start(spark, path, rows)


def read_token_ids(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """Documents with their ids, all or those between two document ids (inclusive, pushed to the files)."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("id") >= first)
    if last is not None:
        rows = rows.where(F.col("id") <= last)
    return _with_start(spark, path, rows)


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    # One row per file part: few numbers, whatever the size of the files.
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(bases), "part")
    return joined.withColumn("start", F.col("base") + F.col("place")).drop("base")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"]
        )


def token_checksums(tokens: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` from what ``read_token_ids`` gives."""
    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "start", "n_tokens", "ids").mapInArrow(_digests, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
