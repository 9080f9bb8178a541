"""N-gram Jaccard join: token-combination prefixes, verified exactly, linked into components.

A document is the set of its distinct shingles of ``n`` consecutive words, each a 64-bit hash.
Documents of the same set are one class; only classes are joined. Two classes link when
``100 * intersection >= percent * union``.

*Candidates.* All shingles have one order: rare ones first, frequent ones last, by hash within.
Linked sets differ from each other in at most ``t = n - ceil(percent% of n)`` of their ``n``
shingles. A class is indexed under signatures of a prefix in that order. A rare shingle is a
signature by itself. Frequent shingles are dealt into sub-classes by hash and are indexed by
pairs within a sub-class: a sub-class of m shingles without a common pair shares one at most, so
it proves m - 1 differences. The prefix is extended until its signatures would prove more than
``t`` differences; linked classes therefore share at least one signature. The number of
sub-classes follows the size of the set; sets near a change of it are indexed under both numbers.
Which shingles count as frequent changes how many candidates there are, never the result.

*Links.* A signature's classes are not paired with each other. Each has a representative there, the
class of the fewest rare shingles; a class is compared with the representative it meets most often,
and verified links are joined into components. Only signatures whose classes are still in different components are looked at again.
Of signatures with the same classes one is. Classes of a signature with more than ``BLOCK`` of them are
indexed once more, by prefixes for each band of partners' sizes: two sets of sizes n and m share
``percent * (n + m) / (100 + percent)`` shingles at least, so sets of about the same size need little more than
half the prefix, and texts that share a passage but are too different to link differ in rare shingles
before they come to those of the passage. Then pairs of classes of different components are held against a bound on what they share,
made from counts of their shingles in a few cells, within blocks of bounded size; pairs that the
bound does not rule out are verified like the others. No pair is written that it rules out.

* Words: A-Z lower-cased, white space is space, tab, line feed, vertical tab, form feed, return.
  With fewer than ``n`` words the whole sequence is one shingle. Null texts and texts without
  words have no shingles and link with nothing.
* Null ids take part; a component's id is the least id in it that is not null. Repeated rows are
  one class and appear one by one. Further columns are ignored.
* Nothing is sampled, capped or cut. Texts of classes that are candidates are chosen by a semi-join
  with their hashes, which is a broadcast up to ``BROADCAST_CLASSES`` of them.
* Signatures of very many classes (those of a passage that a third of the texts hold) are known from
  counts within tasks. What a signature's classes have in common is summed up before the shuffle for
  these, and joined back to them where they are; other signatures are windows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import batch_of, bytes_of, fresh, hold, most_frequent, prepare, two_columns
from pairloom.sources.staging import staged

SHINGLE_WORDS = 4
PERCENT = 85
FREQUENT = 32
MOST_FREQUENT = 400_000
CHUNK_SHINGLES = 1_500_000
CHUNK_COUNT = 4
BROADCAST_CLASSES = 1_000_000
CROWD = 2_048
MOST_CROWDED = 100_000
CACHED_WORDS = 300_000
SEEN_CLASSES = 500_000
CELLS = 256
BLOCK = 2_048
FEW = 64
STRIP = 128
LEVELS = 32
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread sums of products over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a whole text, ascending."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * _ODD[4] + hashes[k : k + len(total)] * _ODD[k % 4]
    return np.unique(mixed(total))


def fingerprint(found: np.ndarray) -> int:
    """One number for a set of shingles."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def least_common(size: int, percent: int) -> int:
    """How many of its shingles a set of this size shares with any set it links with, at least."""
    return -(-percent * size // 100)


def _sub_class_number(size: int) -> int:
    return 1 << max(0, (max(size, 8) // 8).bit_length() - 1)


def sub_classes(size: int, percent: int) -> list[int]:
    """The numbers of sub-classes for a set of this size and all sizes it may link with."""
    low, high = _sub_class_number(least_common(size, percent)), _sub_class_number(100 * size // percent)
    found = [low]
    while found[-1] < high:
        found.append(found[-1] * 2)
    return found


def _rare_and_frequent(found: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(frequent, found)
    common = np.zeros(len(found), bool)
    inside = at < len(frequent)
    common[inside] = frequent[at[inside]] == found[inside]
    return found[~common], found[common]


def _pairs_of_frequent(often: np.ndarray, missing: int, number: int, key: int) -> list[np.ndarray]:
    """Signatures of pairs within ``number`` sub-classes, of a prefix that proves ``missing`` differences without a common pair."""
    sub = (often >> np.uint64(40)) & np.uint64(number - 1)
    proves = np.ones(len(often), np.int64)
    proves[np.unique(sub, return_index=True)[1]] = 0
    length = int(np.searchsorted(np.cumsum(proves), missing)) + 1
    order = np.argsort(sub[:length], kind="stable")
    tokens, group = often[:length][order], sub[:length][order]
    parts = []
    for step in range(1, len(tokens)):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        parts.append(mixed(tokens[:-step][same] * _ODD[0] + tokens[step:][same] * _ODD[1] + np.uint64(key)))
    return parts


def _links_with_itself_alone(size: int, percent: int) -> bool:
    """A set that links with another must be able to lose or gain one shingle."""
    return (size + 1) * percent > size * 100


def signatures(found: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """Signatures of a set, and how many of its shingles are rare."""
    size = len(found)
    if _links_with_itself_alone(size, percent):
        return np.zeros(0, np.uint64), size
    need = size - least_common(size, percent) + 1
    rare, often = _rare_and_frequent(found, frequent)
    parts = [rare[:need]]
    if need > len(rare):
        for number in sub_classes(size, percent):
            parts += _pairs_of_frequent(often, need - len(rare), number, number)
    return np.concatenate(parts), len(rare)


def _band_edges() -> list[int]:
    """The least size of each band of sizes: every size below 32, then bands of about a 32nd."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] + max(1, edges[-1] // 32))
    return edges


_EDGES = _band_edges()


def partner_bands(size: int, percent: int) -> list[tuple[int, int]]:
    """``(band, least size in it)`` for all sizes that a set of this size may link with."""
    least, most = least_common(size, percent), 100 * size // percent
    band, found = bisect_right(_EDGES, least) - 1, []
    while least <= most:
        found.append((band, least))
        band += 1
        least = _EDGES[band]
    return found


def banded_signatures(found: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures with a prefix of its own for each band of partners' sizes, and the set's side in each.

    Pairs are signed with both bands; a set of the lower one is on side 1, of the higher one on side 2,
    and only sets of different sides need to meet. Where both are of one band, and under rare shingles,
    which are signed once as far as any band needs them, the side is 0 and all meet.
    """
    size = len(found)
    if _links_with_itself_alone(size, percent):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = bisect_right(_EDGES, size) - 1
    rare, often = _rare_and_frequent(found, frequent)
    parts, sides, most = [], [], 0
    for band, least in partner_bands(size, percent):
        need = size - -(-percent * (size + least) // (100 + percent)) + 1
        most = max(most, need)
        if need > len(rare):
            low, high = min(own, band), max(own, band)
            made = _pairs_of_frequent(often, need - len(rare), _sub_class_number(_EDGES[low]), (1 << 41) + low * len(_EDGES) + high)
            parts += made
            sides += [0 if low == high else 1 if own == low else 2] * sum(map(len, made))
    parts.insert(0, rare[:most])
    return np.concatenate(parts), np.array([0] * len(parts[0]) + sides, np.int64)


def _once(seen: set[int], key: int) -> bool:
    if key in seen:
        return False
    if len(seen) >= SEEN_CLASSES:
        seen.clear()
    seen.add(key)
    return True


MEMBER, COUNT = 0, 1


def _described(n: int):
    """One pass over the texts: each row's class with an outline of its set, and counts of shingles.

    Counts are of the shingles that occur in several classes of one stretch of the task.
    """

    def counted(parts: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = counts >= CHUNK_COUNT
        k = int(keep.sum())
        return batch_of(
            {
                "kind": (pa.array(np.full(k, COUNT, np.int32)), None),
                "id": (pa.nulls(k, id_type), None),
                "n": (pa.array(counts[keep].astype(np.int64)), None),
                "class": (pa.array(values[keep].view(np.int64)), None),
                "hash": (pa.nulls(k, pa.int64()), None),
                "cells": (pa.nulls(k, pa.binary()), None),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard_join", _WORDS.clear)
        seen: set[int] = set()
        parts, held, id_type = [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            sizes, prints, cells = [], [], []
            for text in bytes_of(batch):
                found = shingles(text, n)
                key = fingerprint(found) if len(found) else None
                sizes.append(len(found))
                prints.append(key)
                cells.append(outline(found).tobytes() if len(found) else None)
                if key is not None and _once(seen, key):
                    parts.append(found)
                    held += len(found)
            yield batch_of(
                {
                    "kind": (pa.array(np.full(len(sizes), MEMBER, np.int32)), None),
                    "id": (batch.column(0), None),
                    "n": (sizes, pa.int64()),
                    "class": (prints, pa.int64()),
                    "hash": (batch.column(2), None),
                    "cells": (cells, pa.binary()),
                }
            )
            if held >= CHUNK_SHINGLES:
                yield counted(parts, id_type)
                parts, held = [], 0
        if id_type is not None:
            yield counted(parts, id_type)

    return run


def _signatures(n: int, percent: int, frequent, sign=signatures, last="rare"):
    """Signatures of each class; and, without a class, counts of those that several classes of one stretch of the task have."""

    names = ["sig", "class", "n", last]

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        keep = counts >= CHUNK_COUNT
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), none, pa.array(counts[keep].astype(np.int64)), none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard_join", _WORDS.clear)
        seen: set[int] = set()
        made, held = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            parts, keys, sizes, lasts, counts = [np.zeros(0, np.uint64)], [], [], [np.zeros(0, np.int64)], []
            for text in bytes_of(batch):
                found = shingles(text, n)
                if not len(found):
                    continue
                key = fingerprint(found)
                if _once(seen, key):
                    own, more = sign(found, frequent.value, percent)
                    parts.append(own)
                    keys.append(key)
                    sizes.append(len(found))
                    lasts.append(np.broadcast_to(more, len(own)))
                    counts.append(len(own))
            own = np.concatenate(parts)
            columns = [own.view(np.int64), *(np.repeat(np.array(x, np.int64), counts) for x in (keys, sizes)), np.concatenate(lasts).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            made.append(own)
            held += len(own)
            if held >= CHUNK_SHINGLES:
                yield counted(made)
                made, held = [np.zeros(0, np.uint64)], 0
        yield counted(made)

    return run


def outline(found: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of a fixed number of cells; in one byte each, if they fit."""
    counts = np.bincount((found >> np.uint64(20)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4")


def outlines(column: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(c, np.uint8 if len(c) == CELLS else "<u4") for c in column], np.uint32).reshape(len(column), CELLS)


def _sets(n: int):
    """``(class, shingles)`` of texts, once a task as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard_join", _WORDS.clear)
        seen: set[int] = set()
        for batch in batches:
            keys, made = [], []
            for text in bytes_of(batch):
                found = shingles(text, n)
                if len(found) and _once(seen, key := fingerprint(found)):
                    keys.append(key)
                    made.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(made, pa.binary())], names=["class", "shingles"])

    return run


def _possible(percent: int):
    """Pairs ``(a, b, n, m, x, y)`` whose outlines do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard_join", _WORDS.clear)
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            common = np.minimum(outlines(batch.column(4).to_pylist()), outlines(batch.column(5).to_pylist())).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(100 * common >= percent * (n + m - common)))

    return run


def _near(percent: int):
    """Pairs within groups of rows that their outlines do not rule out.

    What two sets share in a cell is at most the smaller of their counts there, so the sum of
    these bounds the intersection. Rows come sorted by group; a group is a signature, or two
    blocks of a signature with many classes.
    """

    def fits(common, n, m):
        return 100 * common >= percent * (n + m - common)

    def few(starts: np.ndarray, sizes: np.ndarray, n, root, cells):
        for size in np.unique(sizes).tolist():
            i, j = np.triu_indices(size, 1)
            first = starts[sizes == size]
            per = max(1, 200_000 // max(1, len(i)))
            for lo in range(0, len(first), per):
                at = first[lo : lo + per, None]
                x, y = (at + i).ravel(), (at + j).ravel()
                keep = (root[x] != root[y]) & fits(np.minimum(n[x], n[y]), n[x], n[y])
                x, y = x[keep], y[keep]
                for k in range(0, len(x), 20_000):
                    u, v = x[k : k + 20_000], y[k : k + 20_000]
                    common = np.minimum(cells[u], cells[v]).sum(axis=1, dtype=np.int64)
                    keep = fits(common, n[u], n[v])
                    yield u[keep], v[keep]

    def many(x: np.ndarray, y: np.ndarray, n, root, cells):
        # A strip of rows at a time, so that no more than a strip of the products is held.
        b = cells[y]
        high = np.flatnonzero(b.max(axis=1) > LEVELS)
        for lo in range(0, len(x), STRIP):
            u = x[lo : lo + STRIP]
            a = cells[u]
            # Products count the first levels: whole numbers below 2**24, which 32 bits hold exactly.
            common = np.zeros((len(u), len(y)), np.float32)
            for level in range(1, min(LEVELS, int(min(a.max(), b.max()))) + 1):
                common += (a >= level).astype(np.float32) @ (b >= level).astype(np.float32).T
            common = common.astype(np.int64)
            for i in np.flatnonzero(a.max(axis=1) > LEVELS) if len(high) else ():
                common[i, high] += (np.maximum(np.minimum(a[i], b[high]), LEVELS) - LEVELS).sum(axis=1, dtype=np.int64)
            keep = fits(common, n[u][:, None], n[y][None, :])
            keep &= root[u][:, None] != root[y][None, :]
            i, j = np.nonzero(keep)
            # Each pair once within a block.
            i, j = (i[u[i] != y[j]], j[u[i] != y[j]])
            yield u[i], y[j]

    def pairs(keys, own, n, root, cells):
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts = np.concatenate(([0], change))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        small = (sizes <= FEW) & (keys[starts, 1] == keys[starts, 2])
        yield from few(starts[small], sizes[small], n, root, cells)
        for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
            at = np.arange(start, start + size)
            if keys[start, 1] == keys[start, 2]:
                yield from many(at, at, n, root, cells)
            else:
                yield from many(at[own[at] == keys[start, 1]], at[own[at] == keys[start, 2]], n, root, cells)

    def links(rows: list[pa.RecordBatch], last: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
        """Pairs of the complete groups, and the rows of the group that may go on."""
        table = pa.Table.from_batches(rows).combine_chunks()
        keys = np.stack([table[c].to_numpy() for c in ("sig", "lo", "hi")], axis=1)
        stop = len(keys)
        if not last:
            stop = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0])
        if not stop:
            return rows, None
        done, rest = table.slice(0, stop), table.slice(stop)
        cells = outlines(done["cells"].to_pylist())
        classes, n, root, own = (done[c].to_numpy() for c in ("class", "n", "root", "own"))
        found = list(pairs(keys[:stop], own, n, root, cells))
        x = classes[np.concatenate([x for x, _ in found])] if found else np.zeros(0, np.int64)
        y = classes[np.concatenate([y for _, y in found])] if found else np.zeros(0, np.int64)
        unique = np.unique(np.stack((np.maximum(x, y), np.minimum(x, y)), axis=1), axis=0)
        out = pa.RecordBatch.from_arrays([pa.array(unique[:, 0]), pa.array(unique[:, 1])], names=["a", "b"])
        return rest.to_batches(), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard_join", _WORDS.clear)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= BLOCK:
                    held, out = links(held, False)
                    if out is not None:
                        yield out
        if held:
            yield links(held, True)[1]

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard_join", _WORDS.clear)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                # Where the batch has them, not copied.
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the least node reachable from each, by alternating large and small stars.

    Each round joins neighbours to a node's least neighbour; edges never become more, and the
    rounds needed grow with the logarithm of the longest path.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if before == tuple(state):
            # Unchanged: every edge leads to its component's least node.
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = tuple(state)


def _texts_of(wanted: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The texts of the distinct classes ``wanted``, as often as they occur."""
    names = wanted.join(classes.select("class", "hash"), "class")
    names = staged(names.select("hash").distinct(), "wanted")
    # A text's own hash tells whether it is wanted, before anything is made of it; 8 MB of them are broadcast at most.
    small = names.count() <= BROADCAST_CLASSES
    return texts.join(F.broadcast(names) if small else names, "hash", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets link, by the sets of one text of each class."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), texts, classes).select("id", "text")
    # The same text may come from several tasks: one set of a class is enough, where the join wants it anyway.
    sets = texts.mapInArrow(_sets(n), "class bigint, shingles binary").groupBy("class").agg(F.first("shingles").alias("shingles"))
    left = pairs.join(sets.selectExpr("class as a", "shingles as x"), "a")
    both = left.join(sets.selectExpr("class as b", "shingles as y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_linked(percent), "a bigint, b bigint").distinct()


def _undecided(apart: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of classes of different components under one signature that may still link.

    A signature of more than BLOCK classes is dealt into blocks; each pair of blocks is a group of
    its own, so no task holds all classes of a signature. Where a signature has two sides, blocks of
    one side meet blocks of the other (numbered from -1 down) and none of their own.
    """
    apart = apart.join(classes.select("class", "cells"), "class")
    sided, low = (F.col("side") > 0) & (F.col("rows") > FEW), F.col("side") == 1
    mine = F.when(~sided, F.col("rows")).when(low, F.col("lows")).otherwise(F.col("rows") - F.col("lows"))
    theirs = F.when(~sided, F.col("rows")).when(low, F.col("rows") - F.col("lows")).otherwise(F.col("lows"))
    apart = apart.withColumns({"sided": sided, "own": F.pmod(F.xxhash64("class"), F.ceil(mine / BLOCK)), "blocks": F.ceil(theirs / BLOCK)})
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo = F.when(~F.col("sided"), F.least("own", "other")).when(low, F.col("own")).otherwise(F.col("other"))
    hi = F.when(~F.col("sided"), F.greatest("own", "other")).when(low, -1 - F.col("other")).otherwise(-1 - F.col("own"))
    apart = apart.withColumns({"lo": lo, "hi": hi}).withColumn("own", F.when(F.col("sided") & ~low, F.col("hi")).otherwise(F.col("own")))
    groups = apart.select("sig", "lo", "hi", "own", "class", "n", "root", "cells").repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    return groups.mapInArrow(_near(percent), "a bigint, b bigint").distinct()


def frequent_shingles(counts: DataFrame, least: int | None = None, most: int = MOST_FREQUENT) -> np.ndarray:
    """Shingles of many classes, ascending; the most frequent ones, ``most`` at most, should there be more."""
    totals = staged(counts.groupBy("shingle").agg(F.sum("count").alias("count")).where(F.col("count") >= (least or FREQUENT)), "frequent")
    rows = most_frequent(totals, "count", most).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def _crowded(signed: DataFrame) -> DataFrame:
    """Signatures of very many classes, the ``MOST_CROWDED`` most frequent at most; which these are never changes the result."""
    counts = signed.where("class is null").groupBy("sig").agg(F.sum("n").alias("count")).where(F.col("count") >= CROWD)
    return staged(most_frequent(staged(counts, "crowded"), "count", MOST_CROWDED).select("sig"), "crowded")


def _by_signature(rows: DataFrame, crowded: DataFrame, known: dict[str, Column]) -> DataFrame:
    """``rows`` with aggregates over each one's signature; no task holds all rows of a crowded signature."""
    same = Window.partitionBy("sig")
    calm = rows.join(F.broadcast(crowded), "sig", "left_anti").withColumns({name: value.over(same) for name, value in known.items()})
    busy = rows.join(F.broadcast(crowded), "sig", "left_semi")
    totals = busy.groupBy("sig").agg(*(value.alias(name) for name, value in known.items()))
    return calm.unionByName(busy.join(F.broadcast(totals), "sig"))


def _apart(placed: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows ``(sig, class, n, root, side)`` of signatures that may still join components, with how many each has, and on side 1.

    Signatures of the same classes (those of a shared passage) say the same: one of them is looked at.
    """
    known = {
        "low": F.min("root"), "high": F.max("root"), "rows": F.count(F.lit(1)), "first": F.min("class"),
        "x": F.bit_xor(F.xxhash64("class")), "y": F.bit_xor(F.xxhash64("class", F.lit(1))),
        "lows": F.count_if(F.col("side") == 1), "highs": F.count_if(F.col("side") == 2),
    }
    apart = _by_signature(placed, crowded, known).where("low <> high and (lows > 0) = (highs > 0)")
    one = apart.where("class = first").groupBy("rows", "x", "y", F.col("lows") > 0).agg(F.min("sig").alias("sig")).select("sig")
    return staged(apart.join(one, "sig", "left_semi").select("sig", "class", "n", "root", "side", "rows", "lows"), "apart")


def _refined(busy: DataFrame, texts: DataFrame, classes: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """As ``_apart``, for the classes of ``busy`` under their banded signatures.

    Any two of them that link share a banded signature, whatever they share besides.
    """
    roots = staged(busy.select("class", "root").distinct(), "busy")
    texts = _texts_of(roots.select("class"), texts, classes)
    signed = texts.mapInArrow(_signatures(n, percent, frequent, banded_signatures, "side"), "sig bigint, class bigint, n bigint, side bigint")
    signed = staged(signed, "signed")
    rows = signed.where("class is not null").distinct()
    return _apart(staged(rows.join(roots, "class"), "met"), _crowded(signed))


def _placed(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, class, root)`` of every row; root: the component, as its least class."""
    spark: SparkSession = prepare(docs.sparkSession)
    texts = two_columns(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    kind = texts.schema["id"].dataType.simpleString()
    fields = f"kind int, id {kind}, n bigint, class bigint, hash bigint, cells binary"
    described = staged(texts.mapInArrow(_described(n), fields), "described")
    members = described.where(F.col("kind") == MEMBER).select("id", "n", "class")
    counts = described.where(F.col("kind") == COUNT).selectExpr("class as shingle", "n as count")
    frequent = spark.sparkContext.broadcast(frequent_shingles(counts))
    # One text and outline of each class.
    classes = described.where((F.col("kind") == MEMBER) & F.col("class").isNotNull()).select("class", "hash", "cells").groupBy("class")
    classes = classes.agg(F.min(F.struct("hash", "cells")).alias("one")).select("class", "one.hash", "one.cells")

    signed = staged(texts.mapInArrow(_signatures(n, percent, frequent), "sig bigint, class bigint, n bigint, rare bigint"), "signed")
    crowded = _crowded(signed)
    known = {"low": F.min("class"), "high": F.max("class"), "rep": F.min(F.struct("rare", "class", "n"))}
    shared = _by_signature(signed.where("class is not null"), crowded, known).where("low <> high")
    shared = shared.select("sig", "class", "n", F.col("rep.class").alias("rep"), F.col("rep.n").alias("rep_n"))
    shared = staged(shared, "shared")
    fits = f"100 * least(n, rep_n) >= {percent} * greatest(n, rep_n)"
    # Each class with the one it meets under most signatures, if their outlines allow a link.
    met = shared.where("class <> rep").where(fits).groupBy("class", "n", "rep", "rep_n").agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("class", "n").agg(F.max(F.struct("times", "rep", "rep_n")).alias("best")).select("class", "n", "best.rep", "best.rep_n")
    classes = staged(classes.join(shared.select("class").distinct(), "class", "left_semi"), "classes")
    drawn = best.join(classes.select("class", "cells"), "class")
    drawn = drawn.join(classes.select(F.col("class").alias("rep"), F.col("cells").alias("rep_cells")), "rep")
    first = drawn.select(F.col("class").alias("a"), F.col("rep").alias("b"), "n", F.col("rep_n").alias("m"), F.col("cells").alias("x"), F.col("rep_cells").alias("y"))
    first = staged(first.mapInArrow(_possible(percent), "a bigint, b bigint"), "pairs")
    links = staged(_verified(first, texts, classes, n, percent), "links")
    roots = staged(components(links), "roots")

    # Signatures that still join different components.
    placed = shared.select("sig", "class", "n").join(roots, shared["class"] == roots["node"], "left")
    placed = placed.select("sig", "class", "n", F.coalesce("root", "class").alias("root"))
    apart = _apart(staged(placed.distinct(), "met").withColumn("side", F.lit(0)), crowded)
    busy = apart.where(F.col("rows") > BLOCK)
    if not busy.isEmpty():
        apart = apart.where(F.col("rows") <= BLOCK).unionByName(_refined(busy, texts, classes, n, percent, frequent))
    rest = staged(_undecided(apart, classes, percent), "rest")
    tried = first.union(first.selectExpr("b as a", "a as b"))
    more = staged(_verified(staged(rest.join(tried, ["a", "b"], "left_anti"), "rest"), texts, classes, n, percent), "links")
    joins = more.join(roots.selectExpr("node as a", "root as ra"), "a", "left").join(roots.selectExpr("node as b", "root as rb"), "b", "left")
    joins = joins.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    again = components(joins)
    final = roots.join(again.selectExpr("node as root", "root as top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = again.selectExpr("node", "root").join(roots, "node", "left_anti")
    final = staged(final.unionByName(alone), "roots")

    placed = members.join(final, members["class"] == final["node"], "left").select("id", "n", "class", F.coalesce("root", "class").alias("root"))
    return staged(placed, "placed")


def similar_components(
    docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row; component_id: the least id reachable by links."""
    placed = _placed(docs, n, percent, id_col, text_col)
    least = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(least, "root", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _with_class(n: int, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard_join", _WORDS.clear)
        for batch in batches:
            sets = [shingles(text, n) for text in bytes_of(batch, text_col)]
            prints = pa.array([fingerprint(x) if len(x) else None for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, name])

    return run


def keep_one_of_each(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the least id of each component, with all its columns; rows without words all stay.

    A null id counts as larger than any other. Of rows with the same id and the same set, one stays.
    """
    placed = _placed(docs, n, percent, id_col, text_col)
    key = fresh(docs.columns, "class")
    row = fresh([*docs.columns, key], "row")

    def name_of(id_value, class_value):
        return F.xxhash64(id_value.isNull(), F.coalesce(id_value.cast("string"), F.lit("")), class_value)

    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "class")).alias("first")
    kept = placed.where("root is not null").groupBy("root").agg(first).select(name_of(F.col("first.id"), F.col("first.class")).alias(row))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    rows = docs.mapInArrow(_with_class(n, text_col, key), f"{', '.join(fields)}, `{key}` bigint")
    worded = rows.where(F.col(f"`{key}`").isNotNull()).withColumn(row, name_of(F.col(f"`{id_col}`"), F.col(f"`{key}`")))
    worded = worded.dropDuplicates([row]).join(kept, row, "left_semi").drop(row)
    return worded.unionByName(rows.where(F.col(f"`{key}`").isNull())).select(*(F.col(f"`{c}`") for c in docs.columns))
