"""Exact nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised to int8 with a scale of their own. The product of a tile of queries and
a tile of candidates is exact for the integers and, times both scales, differs from the true
inner product by at most a bound made of the quantisation errors' norms. In each tile, a pair
survives when its upper bound reaches the k-th largest lower bound of its query; survivors are
computed again in double precision and merged by heaps, per tile stream and then per query.

* Nearness is the inner product of the original vectors, larger first, ties to the smaller id.
* Vectors that are null or zero, or hold null or non-finite components, take no part.
* A query is not its own candidate; other rows with the same vector are.
* With fewer candidates than k, all are returned; an empty table gives no rows.
* Rows repeating an id are candidates each; as queries the least of their vectors stands for them.
* Queries are cut into blocks of ``QUERY_BLOCK`` rows. Each candidate partition passes all
  blocks; only its k best per query leave it, so the shuffle holds k rows per query and partition.
* Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import prepare
from pairloom.sources.staging import staged

QUERY_BLOCK = 16_384
TILE = 1_024
BROADCAST_BYTES = 8_000_000


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integers from -127 to 127 (held as float32), scales, norms, and norms of the errors."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    whole = np.rint(vectors / scale[:, None]).astype(np.int8)
    errors = vectors - whole * scale[:, None]
    return whole, scale, np.sqrt((vectors**2).sum(axis=1)), np.sqrt((errors**2).sum(axis=1))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in the same order for every pair of equal rows."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class TopPairs:
    """The k best candidates of each query, met tile by tile."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.whole, self.scale, self.norm, self.error = quantise(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def tile(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        whole, scale, norm, error = quantise(vectors)
        columns = whole.astype(np.float32).T
        for lo in range(0, len(self.ids), TILE):
            rows = slice(lo, lo + TILE)
            # Sums of int8 products stay below 2^24 up to 1,040 components; longer vectors are added in parts.
            products = np.zeros((len(self.ids[rows]), len(ids)))
            for c in range(0, vectors.shape[1], 1_024):
                products += self.whole[rows, c : c + 1_024].astype(np.float32) @ columns[c : c + 1_024]
            products *= self.scale[rows, None] * scale[None, :]
            bound = self.norm[rows, None] * error[None, :] + self.error[rows, None] * (norm + error)[None, :]
            bound = bound * (1 + 1e-9) + 1e-300
            same = self.ids[rows, None] == ids[None, :]
            lower = np.where(same, -np.inf, products - bound)
            upper = np.where(same, -np.inf, products + bound)
            floor = self.least[rows]
            if len(ids) > self.k:
                floor = np.maximum(floor, np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            q, c = np.nonzero((upper >= floor[:, None]) & ~same)
            for part in range(0, len(q), 200_000):
                self._merge(q[part : part + 200_000] + lo, c[part : part + 200_000], ids, vectors)

    def _merge(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = _exact(self.vectors[q], vectors[c])
        # The best k of each query in this tile, ties to the smaller id, before they reach its heap.
        order = np.lexsort((ids[c], -scores, q))
        q, c, scores = q[order], c[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = (rank < self.k) & (scores >= self.least[q])
        k, heaps = self.k, self.heaps
        for i, score, vec_id in zip(q[keep].tolist(), scores[keep].tolist(), ids[c[keep]].tolist()):
            heap = heaps[i]
            if len(heap) < k:
                heapq.heappush(heap, (score, -vec_id))
            elif (score, -vec_id) > heap[0]:
                heapq.heapreplace(heap, (score, -vec_id))
            if len(heap) == k:
                self.least[i] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        found = [(int(i), -v, s) for i, heap in zip(self.ids, self.heaps) for s, v in heap]
        q, v, s = map(list, zip(*found)) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, values.reshape(len(ids), -1)


def _search(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = queries.value
        top = TopPairs(ids, vectors, k)
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                part = batch.slice(lo, TILE)
                top.tile(*_matrix(part))
        yield top.rows()

    return run


def nearest(
    table: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows of each row that ``queries`` selects."""
    spark = prepare(table.sparkSession)
    usable = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    chosen = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks"))
    chosen = chosen.where(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
    asking = chosen.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    shape = asking.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.size("v"))).first()
    n, width = shape[0], shape[1] or 0
    if width != (shape[2] or 0):
        raise ValueError("query vectors differ in length")
    candidates = chosen.where(F.size("v") == width).select("id", "v")
    # A block of queries is sent to all tasks: its bytes are bounded whatever the number of queries.
    per_block = max(1, min(query_block, BROADCAST_BYTES // max(1, width * 8)))
    blocks = -(-n // per_block)
    block = F.pmod(F.xxhash64("id", "v"), F.lit(max(1, blocks)))
    found = None
    for b in range(blocks):
        rows = asking.where(block == b).collect()
        ids = np.array([r["id"] for r in rows], np.int64)
        vectors = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), width)
        held = spark.sparkContext.broadcast((ids, vectors))
        part = candidates.mapInArrow(_search(held, k), "query_id bigint, vec_id bigint, score double")
        part = part if blocks == 1 else staged(part, "neighbours")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    kind = "query_id bigint, rank int, vec_id bigint, score double"
    return found.groupBy("query_id").applyInArrow(_best(k), kind)


def _best(k: int):
    """Merge the best of all candidate partitions: k rows of each at most."""

    def run(rows: pa.Table) -> pa.Table:
        pairs = zip(rows["score"].to_pylist(), rows["vec_id"].to_pylist())
        best = heapq.nsmallest(k, ((-score, vec_id) for score, vec_id in pairs))
        return pa.table(
            {
                "query_id": pa.array(rows["query_id"].to_pylist()[: len(best)], pa.int64()),
                "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([v for _, v in best], pa.int64()),
                "score": pa.array([-s for s, _ in best], pa.float64()),
            }
        )

    return run
