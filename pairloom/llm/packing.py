"""Best-fit packing of documents into token sequences, improved by bin completion.

Every document is encoded whole and closed by an end id. One longer than a sequence is cut into
pieces of the sequence's length; its first piece takes what is left over. Pieces of one length
are alike for the packing, so only the number of pieces of each length, ``capacity`` numbers
at most, comes to the driver, whatever the size of the table. There ``complete`` decides which
fillings occur how often:

* Best fit in descending order gives the first solution. It is kept if it needs no more
  sequences than the bound on waste allows at least.
* Else branch and bound: around the largest piece left, the undominated fillings are
  listed, least waste first; a filling is taken as often as the counts allow, then less often. A
  branch whose waste so far and unavoidable waste (Martello and Toth's second bound) leave no room for
  a better solution is pruned, and every node is finished by best fit for a new incumbent.
  ``NODES``, ``FILLINGS`` and ``STEPS`` bound the search; beyond them the incumbent stands, which
  is a whole packing in any case.

Pieces then find their place by their length and their rank among pieces of that length: a
task numbers what it has itself, and counts of (task, length) say where its numbers start.
No piece's ids meet others before ``sequences`` is asked for.

* Null texts count as empty: such a document is its end id alone.
* Texts of any length are encoded whole. Repeated rows, and rows without an id, are packed one by one.
* An empty table gives no pieces. Further columns are ignored.
* Ties between equal lengths are settled by the place in the staged table.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import batch_of, hold, prepare, two_columns
from pairloom.llm.token_files import SLICE_BYTES, PieceEncoder, _slices, byte_letters
from pairloom.sources.staging import staged

CAPACITY = 2048
END_ID = 0
NODES = 2_500
FILLINGS = 24
STEPS = 2_000
_RANK_BITS = 40
#: What the library splits texts by, as long as letters are of a kind every engine knows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_SPACES = r"\t-\r\x1c- \x{85}\x{A0}"
#: Texts that stay whole: beyond Latin letters, or with a space that has white space or nothing after it, or white space before it.
_WHOLE = rf"[^\x00-\x{{24F}}]|[{_SPACES}] | [{_SPACES}]| $"
_ENCODERS: dict[str, TextEncoder] = {}

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


class TextEncoder:
    """Ids as the tokenizers library gives them, by its ranks alone where that is proven to be the same.

    Merging by the rank of what a pair becomes equals merging by the list of pairs if ranks follow
    the list and every token, taken alone, encodes to itself: a pair stands between two
    borders no merge has crossed, so it has come to be as it does in the token alone. Both are
    checked once for the file. Texts beyond Latin letters, or with a special string in them,
    go to the library.

    A space between two characters that are not white space starts a pre-token, and no other token
    holds a space. So the texts of a batch are taken apart at spaces, and the distinct pieces are merged
    in one go: where a token begins with a space, the next piece's ids begin.
    """

    def __init__(self, path: str):
        self.library = PieceEncoder(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, byte_of = told["model"], {letter: b for b, letter in byte_letters().items()}
        special = set(self.library.special)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        made = [model["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
        split = told.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer")
        tokenize = self.library.tokenize
        proven = plain and made == sorted(made) and all(len(t := tokenize(token)) == 1 and t[0].id == i for token, i in model["vocab"].items() if token not in special)
        self.ranked = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if proven else None
        self.whole = "|".join((_WHOLE, *(rf"\Q{s}\E" for s in self.library.special)))
        self.opens = np.zeros(max(ranks.values(), default=0) + 1, bool)
        self.opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.ranked is None or _BEYOND_LATIN.search(text) or any(s in text for s in self.library.special):
            return np.frombuffer(self.library.encode(text), "<u4")
        return self.ranked.encode_to_numpy(text, disallowed_special=())

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, and the number of each text's ids; a null text has none."""
        if self.ranked is None or not len(texts):
            return self.library.encode_array(texts)
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring_regex(texts, self.whole), pc.greater(pc.binary_length(texts), SLICE_BYTES))
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        after_space = np.ones(len(split.values), bool)
        after_space[firsts] = False
        coded = split.values.filter(pa.array(after_space)).dictionary_encode()
        pieces, n = coded.dictionary, len(coded.dictionary)
        ids, starts = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if n:
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pieces), pa.scalar(" ", pieces.type))[0].as_py()
            ids = self.ranked.encode_to_numpy(" " + joined, disallowed_special=())
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != n:
                raise ValueError(f"{n} pieces, but {len(starts)} of their tokens begin with a space")
        # After the pieces, what stands before the first space of each text, or the whole text.
        own = [self.encode(t) for t in pc.if_else(whole, texts, split.values.take(pa.array(firsts))).to_pylist()]
        sizes = np.concatenate((np.diff(starts, append=len(ids)), np.fromiter(map(len, own), np.int64, len(own))))
        ids = np.concatenate((ids, *own))
        starts = np.cumsum(sizes) - sizes
        index = np.empty(len(after_space), np.int64)
        index[after_space] = coded.indices.to_numpy()
        index[firsts] = n + np.arange(len(own))
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        at = np.repeat((starts[index] - (ends - lengths)).astype(np.int32), lengths)
        at += np.arange(ends[-1], dtype=np.int32)
        return ids[at], np.add.reduceat(lengths, firsts)


def text_encoder(path: str) -> TextEncoder:
    """One per Python worker."""
    hold("packing", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` ids; the first may be shorter."""
    first = n - (ceil(n / capacity) - 1) * capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        part, before = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (s for whole in batches if whole.num_rows for s in _slices(whole)):
            row, piece, starts, lengths, nth, ids = [], [], [], [], [], []
            coded, counts = encoder.encode_array(batch.column(1))
            ends = np.cumsum(counts)
            closed = np.insert(coded.astype("<u4", copy=False), ends, end_id)
            for i, found in enumerate(np.split(closed, (ends + np.arange(1, len(ends) + 1))[:-1])):
                for k, (start, length) in enumerate(cuts(len(found), capacity)):
                    row.append(i)
                    piece.append(k)
                    starts.append(start)
                    lengths.append(length)
                    nth.append(int(before[length]))
                    before[length] += 1
                    ids.append(found[start : start + length].tobytes())
            yield batch_of(
                {
                    "id": (batch.column(0).take(pa.array(row, pa.int64())), None),
                    "piece": (piece, pa.int32()),
                    "start": (starts, pa.int64()),
                    "length": (lengths, pa.int64()),
                    "ids": (ids, pa.binary()),
                    "part": (pa.array(np.full(len(row), part, np.int32)), None),
                    "nth": (nth, pa.int64()),
                }
            )

    return run


def cut_into_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, piece, start, length, ids, part, nth)``, staged; ids as little-endian unsigned 32-bit integers.

    ``part`` is the task that wrote the piece, ``nth`` the number of its earlier pieces of that length.
    """
    prepare(docs.sparkSession)
    rows = two_columns(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, piece int, start bigint, length bigint, ids binary, part int, nth bigint"
    return staged(rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity), fields), "pieces", compression="zstd")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit in descending order, by counts: each filling and how often it occurs.

    Pieces of one length go into the fullest sequence they fit into until it is too full for another,
    which is what placing them one by one does.
    """
    open_: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((filling, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, filling, times = capacity, (), left
            else:
                room = rooms[at]
                filling, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            each = room // length
            used = min(times, left // each)
            if used:
                put(room - each * length, (*filling, (length, each)), used)
                left -= used * each
            else:
                used = 1
                put(room - left * length, (*filling, (length, left)), 1)
                left = 0
            if filling and times > used:
                put(room, filling, times - used)
    return [x for room in open_.values() for x in room]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """No packing needs fewer: the total, and Martello and Toth's second bound over all thresholds."""
    if not counts:
        return 0
    number = np.zeros(capacity + 2, np.int64)
    number[list(counts)] = list(counts.values())
    total = number * np.arange(capacity + 2)
    n, s = np.concatenate(([0], np.cumsum(number))), np.concatenate(([0], np.cumsum(total)))  # of lengths below the index
    half = capacity // 2
    k = np.arange(0, half + 1)
    alone = n[-1] - n[capacity - k + 1]
    wide = n[capacity - k + 1] - n[half + 1]
    room = wide * capacity - (s[capacity - k + 1] - s[half + 1])
    small = s[half + 1] - s[k]
    bound = alone + wide + np.maximum(0, -(-(small - room) // capacity))
    return int(max(bound.max(), -(-int(s[-1]) // capacity)))


def _packs_into(items: list[int], rooms: list[int]) -> bool:
    """Whether items, longest first, fit into rooms."""
    if not items:
        return True
    tried = set()
    for i, room in enumerate(rooms):
        if room >= items[0] and room not in tried:
            tried.add(room)
            if _packs_into(items[1:], [*rooms[:i], room - items[0], *rooms[i + 1 :]]):
                return True
    return False


def undominated(counts: dict[int, int], capacity: int, most: int = FILLINGS, steps: int = STEPS) -> list[Filling]:
    """Fillings around the longest piece, least waste first.

    One filling dominates another if the other's pieces can be packed into its own: what the
    other leaves over is then no harder to place.
    """
    lengths = sorted((x for x in counts if counts[x]), reverse=True)
    longest = lengths[0]
    room = capacity - longest
    left = {**counts, longest: counts[longest] - 1}
    if left.get(room, 0) > 0:
        return [as_filling([longest, room])]
    usable = [x for x in lengths if x <= room and left[x] > 0]
    found: list[list[int]] = []
    budget = [steps]

    def walk(at: int, room: int, items: list[int]) -> None:
        if budget[0] <= 0 or len(found) >= 4 * most:
            return
        budget[0] -= 1
        taken = items.count
        if not any(x <= room and taken(x) < left[x] for x in usable):
            found.append(items)
            return
        for i in range(at, len(usable)):
            x = usable[i]
            if x <= room and taken(x) < left[x]:
                walk(i, room - x, [*items, x])

    walk(0, room, [])
    found.sort(key=lambda items: (-sum(items), [-x for x in items]))
    kept: list[list[int]] = []
    for items in found:
        if len(kept) < most and not any(len(k) <= 8 and len(items) <= 8 and _packs_into(items, k) for k in kept):
            kept.append(items)
    return [as_filling([longest, *items]) for items in kept]


def as_filling(items: list[int]) -> Filling:
    number: dict[int, int] = {}
    for x in items:
        number[x] = number.get(x, 0) + 1
    return tuple(sorted(number.items(), reverse=True))


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES, most: int = FILLINGS, steps: int = STEPS) -> list[tuple[Filling, int]]:
    """Fillings and how often each occurs, in as few sequences as the search finds."""
    counts = {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in counts.items())
    best = best_fit(counts, capacity)
    best_size = sum(n for _, n in best)
    floor = least_sequences(counts, capacity)
    seen: dict[tuple, int] = {}
    visited = 0

    def children(left: dict[int, int], used: int, taken: list[tuple[Filling, int]]) -> Iterator[tuple]:
        for filling in undominated(left, capacity, most, steps):
            often = min(left[x] // k for x, k in filling)
            for times in range(often, 0, -1):
                rest = dict(left)
                for x, k in filling:
                    rest[x] -= k * times
                yield {x: n for x, n in rest.items() if n}, used + times, [*taken, (filling, times)]

    stack = [children(counts, 0, [])] if best_size > floor else []
    while stack and visited < nodes and best_size > floor:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        left, used, taken = node
        visited += 1
        # What a better solution may waste, and what this branch wastes at least.
        allowed = (best_size - 1) * capacity - total
        if (used + least_sequences(left, capacity)) * capacity - total > allowed:
            continue
        key = tuple(sorted(left.items()))
        if seen.get(key, used + 1) <= used:
            continue
        seen[key] = used
        rest = best_fit(left, capacity)
        size = used + sum(n for _, n in rest)
        if size < best_size:
            best, best_size = [*taken, *rest], size
        if left:
            stack.append(children(left, used, taken))
    return best


class Places(NamedTuple):
    """Where pieces go, by (length, rank), ascending: at most 63 lengths a filling."""

    key: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int


def places(fillings: list[tuple[Filling, int]]) -> Places:
    rows, rank, first = [], {}, 0
    for filling, times in fillings:
        offset = 0
        for length, each in filling:
            lo = rank.get(length, 0)
            rows.append((length << _RANK_BITS | lo, each, first, offset))
            rank[length] = lo + each * times
            offset += length * each
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Places(*table.T.copy(), first)


def _place(plan, at_length: int, at_rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            at = np.searchsorted(p.key, length << _RANK_BITS | rank, side="right") - 1
            nth = rank - (p.key[at] & ((1 << _RANK_BITS) - 1))
            columns = [pa.array(p.first[at] + nth // p.each[at]), pa.array(p.offset[at] + nth % p.each[at] * length)]
            kept = [c for i, c in enumerate(batch.columns) if i != at_rank]
            names = [c for i, c in enumerate(batch.schema.names) if i != at_rank]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*names, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, counted: DataFrame | None = None) -> DataFrame:
    """Pieces without ``part`` and ``nth``, but with ``sequence_id`` and ``offset``; other columns go along.

    ``counted`` are the same pieces where their ``part`` and ``length`` alone are read with less work.
    """
    spark = pieces.sparkSession
    # One row for each task and length; what a task numbers starts where the tasks before it end.
    counts = staged((pieces if counted is None else counted).groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(places(complete(histogram, capacity, nodes)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    # Merged, not broadcast: the counts grow with the number of tasks.
    ranked = pieces.join(starts.hint("merge"), ["part", "length"]).select(*kept, (F.col("nth") + F.col("before")).alias("rank"))
    fields = [*(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept), "sequence_id bigint", "offset bigint"]
    return ranked.mapInArrow(_place(plan, kept.index("length"), len(kept)), ", ".join(fields))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, piece, start, length, ids, sequence_id, offset)`` of every piece."""
    return place(cut_into_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids, doc_ids)``: whole sequences; pieces of one meet, no more than fit into it."""
    row = F.struct("offset", "id", "length", "ids")
    put = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    joined = F.aggregate("rows", F.lit(b""), lambda done, r: F.concat(done, r["ids"]))
    return put.select("sequence_id", (F.octet_length(joined) / 4).cast("long").alias("n_tokens"), joined.alias("ids"), F.col("rows.id").alias("doc_ids"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        crcs = pa.array([zlib.crc32(b.as_buffer()) for b in batch.column(at)], pa.int64())
        yield batch.set_column(at, "ids_crc32", crcs)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with the unsigned crc32 of their ids in place of the ids."""
    fields = ["ids_crc32 bigint" if f.name == "ids" else f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]
    return pieces.mapInArrow(_checksums, ", ".join(fields))
