"""Ranked lexical search without random access: impact-sorted reads with score intervals.

One pass over the documents counts their terms and keeps, of each, the terms that some item
holds. Sums over all documents give the statistics. A second pass reads these short rows in
blocks of documents; a block's postings become one list for each term, in descending order of impact,
and every item is answered from the lists by NRA:

* All lists of an item are read on together, in slices that double. What a document has been
  seen with is the lower end of its score; what it may still get, at most the next impact of
  each list it has not been seen in, makes the upper end.
* A document not seen at all can get the sum of the next impacts. Once that is below the k-th largest lower
  end, no further document is admitted.
* Of those admitted, documents whose upper end is below that threshold go. Reading goes on, in lists where a
  document that stays is yet unseen, until every interval is closed: members, their ties and their scores
  are then final. A document equal to the threshold stays, so ties are settled by ids.

The k best so far of a task, and 1, are where the threshold of its next block starts. Tasks hand on
k rows for each item at most.

* Terms: A-Z lower-cased, all but ASCII letters and digits and what is beyond ASCII separates.
  Null and empty texts have none; such documents are found by no item and do not count. Such items find nothing.
* Documents whose terms all have weight 0 are not found (that of a term in all of 500 documents or more).
* Repeated documents are ranked one by one; among equal scores a null id comes last. Items are
  told apart by their row, so items of the same or a null id each get their own ranks.
* Texts are read whole, whatever their length. Empty tables give no rows. Further columns are ignored.
* Items go through the driver in blocks of bounded size; each block passes over the documents once.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairloom.llm.common import batch_of, bytes_of, hold, nothing_kept, prepare, two_columns
from pairloom.sources.staging import staged

BEST = 10
BLOCK_TERMS = 200_000
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 2_000_000
BLOCK_CELLS = 1 << 26
FIRST_SLICE = 64
SALTS = 64
_IMPACT_BITS = 20  # an impact is below 1,000,000
_TERMS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


class Item(NamedTuple):
    number: int
    item_id: object
    terms: list[tuple[int, int]]  # (term, how often)


class Posting(NamedTuple):
    """One term's list within a block: descending impacts."""

    gain: int
    docs: np.ndarray
    impacts: np.ndarray


def _described(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ranked_search", nothing_kept)
        number = vocabulary.value
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in bytes_of(batch):
                words = terms_of(text)
                found = Counter(map(number.get, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.append(np.fromiter(found, "<i4", len(found)).tobytes())
                times.append(np.fromiter(found.values(), "<i8", len(found)).tobytes())
            yield batch_of({"id": (batch.column(0), None), "n": (sizes, pa.int64()), "terms": (terms, pa.binary()), "times": (times, pa.binary())})

    return run


def _values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), dtype), np.array([len(p) for p in packed], np.int64) // np.dtype(dtype).itemsize


N_DOCS, N_TERMS = -1, -2


def _statistics(size: int):
    """A task's sums: documents with a term, their terms, and documents for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = words = 0
        held = np.zeros(size, np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy()
            docs, words = docs + int((n > 0).sum()), words + int(n.sum())
            held += np.bincount(_values(batch.column(1), "<i4")[0], minlength=size)
        met = np.flatnonzero(held)
        keys, values = [N_DOCS, N_TERMS, *met.tolist()], [docs, words, *held[met].tolist()]
        yield batch_of({"term": (keys, pa.int64()), "n": (values, pa.int64())})

    return run


def weight(documents: int, holding: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * holding + 1)))


def impacts(times: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What one occurrence in an item of a term is worth, but for the term's weight."""
    if int(lengths.max(initial=0)) * 75 * documents < 1 << 62:
        m = 25 + 75 * lengths * documents // terms
    else:
        m = np.array([25 + 75 * int(n) * documents // terms for n in lengths], np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def best_documents(lists: list[Posting], n_docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """NRA over the lists of one item: documents whose score may be among the k best, and their scores.

    ``least``: the score from which on a document counts. Of all documents with such a score, those returned
    hold every one that is as good as the k-th; all scores are final.
    """
    lower = np.zeros(n_docs, np.int64)
    read = [0] * len(lists)
    step, threshold = FIRST_SLICE, least

    def following(t: int) -> int:
        """The most that the unread rest of a list may give."""
        p = lists[t]
        return p.gain * int(p.impacts[read[t]]) if read[t] < len(p.docs) else 0

    def kth(scores: np.ndarray) -> int:
        return max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else least

    # Documents are admitted while one that was never seen could still reach the threshold.
    while True:
        unseen = sum(following(t) for t in range(len(lists)))
        if not unseen or unseen < threshold:
            break
        for t, p in enumerate(lists):
            a, read[t] = read[t], min(len(p.docs), read[t] + step)
            lower[p.docs[a : read[t]]] += p.gain * p.impacts[a : read[t]]
        step *= 2
        threshold = kth(lower)

    docs = np.flatnonzero((lower > 0) & (lower + unseen >= threshold))
    place = np.full(n_docs, -1, np.int64)
    place[docs] = np.arange(len(docs))
    seen = np.zeros((len(lists), len(docs)), bool)
    for t, p in enumerate(lists):
        at = place[p.docs[: read[t]]]
        seen[t, at[at >= 0]] = True
    while True:
        rest = np.array([following(t) for t in range(len(lists))], np.int64)
        scores = lower[docs]
        upper = scores + rest @ ~seen
        stays = upper >= kth(scores)
        if not stays.all():
            place[docs[~stays]] = -1
            docs, seen, upper, scores = docs[stays], seen[:, stays], upper[stays], scores[stays]
            place[docs] = np.arange(len(docs))
        if (upper == scores).all():
            return docs, scores
        for t, p in enumerate(lists):
            if rest[t] and not seen[t].all():
                a, read[t] = read[t], min(len(p.docs), read[t] + step)
                at = place[p.docs[a : read[t]]]
                met = at >= 0
                lower[p.docs[a : read[t]][met]] += p.gain * p.impacts[a : read[t]][met]
                seen[t, at[met]] = True
        step *= 2


def _postings(terms: np.ndarray, times: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``(documents, impacts)`` of each term, impacts descending."""
    docs = np.repeat(np.arange(len(sizes)), sizes)
    worth = impacts(times, np.repeat(lengths, sizes), documents, total)
    order = np.argsort(terms.astype(np.int64) << _IMPACT_BITS | ((1 << _IMPACT_BITS) - 1 - worth), kind="stable")
    terms, docs, worth = terms[order], docs[order], worth[order]
    starts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
    ends = [*starts[1:].tolist(), len(terms)]
    return {int(terms[a]): (docs[a:b], worth[a:b]) for a, b in zip(starts.tolist(), ends)}


def _searched(plan, k: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ranked_search", nothing_kept)
        items, weights, documents, total = plan.value
        widest = max((len(item.terms) for item in items), default=1)
        most_docs = max(64, min(BLOCK_DOCS, BLOCK_CELLS // max(1, widest)))
        best: dict[int, list[tuple]] = {}
        block: list[pa.RecordBatch] = []
        id_type = None

        def answer() -> None:
            table = pa.Table.from_batches(block).combine_chunks()
            block.clear()
            ids, lengths = table["id"].to_pylist(), table["n"].to_numpy()
            terms, sizes = _values(table["terms"], "<i4")
            lists = _postings(terms, _values(table["times"], "<i8")[0], sizes, lengths, documents, total)
            for item in items:
                mine = [Posting(often * weights[t], *lists[t]) for t, often in item.terms if t in lists and weights[t] > 0]
                if not mine:
                    continue
                held = best.setdefault(item.number, [])
                docs, scores = best_documents(mine, len(ids), k, -held[-1][0] if len(held) == k else 1)
                for d, score in zip(docs.tolist(), scores.tolist()):
                    # Ids of one column compare; a null id comes after all others.
                    insort(held, (-score, ids[d] is None, ids[d] if ids[d] is not None else 0))
                    del held[k:]

        rows = postings = 0
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, most_docs):
                part = batch.slice(at, most_docs)
                size = sum(len(b) for b in part.column(2).to_pylist()) // 4
                if block and (rows + part.num_rows > most_docs or postings + size > BLOCK_POSTINGS):
                    answer()
                    rows = postings = 0
                block.append(part)
                rows, postings = rows + part.num_rows, postings + size
        if block:
            answer()
        found = [(item, score, none, doc) for item in items for score, none, doc in best.get(item.number, [])]
        if found:
            yield batch_of(
                {
                    "item": ([f[0].number for f in found], pa.int64()),
                    "item_id": ([f[0].item_id for f in found], item_type),
                    "doc_id": ([None if f[2] else f[3] for f in found], id_type),
                    "score": ([-f[1] for f in found], pa.int64()),
                }
            )

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple], dict[bytes, int]]]:
    """Items with their terms, as many at a time as have a bounded number of terms."""
    held, size, vocabulary = [], 0, {}
    for number, (item_id, text) in enumerate(items.toLocalIterator()):
        counts = Counter(terms_of(text.encode() if text else None))
        if held and size + len(counts) > BLOCK_TERMS:
            yield held, vocabulary
            held, size, vocabulary = [], 0, {}
        if counts:
            held.append(Item(number, item_id, [(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in counts.items()]))
            size += len(counts)
    if held:
        yield held, vocabulary


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k best documents with a score above 0, equal scores by id."""
    spark = prepare(docs.sparkSession)
    rows, asked = two_columns(docs, id_col, text_col), two_columns(items, item_col, item_text_col)
    kind, item_kind = rows.schema["id"].dataType.simpleString(), asked.schema["id"].dataType
    fields = f"item bigint, item_id {item_kind.simpleString()}, doc_id {kind}, score bigint"
    found = None
    for block, vocabulary in _blocks(asked):
        number = spark.sparkContext.broadcast(vocabulary)
        held = staged(rows.mapInArrow(_described(number), f"id {kind}, n bigint, terms binary, times binary"), "terms")
        sums = held.select("n", "terms").mapInArrow(_statistics(len(vocabulary)), "term bigint, n bigint")
        # As many rows as the block of items has terms, and two.
        counts = {r["term"]: r["n"] for r in sums.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        documents, total = counts.pop(N_DOCS, 0), counts.pop(N_TERMS, 0)
        weights = [weight(documents, counts.get(t, 0)) for t in range(len(vocabulary))]
        plan = spark.sparkContext.broadcast((block, weights, documents, total))
        # Documents without any of the terms are told nothing about.
        some = held.where(F.octet_length("terms") > 0).mapInArrow(_searched(plan, k, to_arrow_type(item_kind)), fields)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], fields)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
    first = F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))
    near = salted.withColumn("rank", first).where(F.col("rank") <= k)
    last = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return near.withColumn("rank", last).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
