"""Centroid clustering over whole numbers, with a table of distances to fixed pivots (LAESA).

Every vector is turned into integers and stored once, with its exact squared distances to the
pivots, which are the starting centroids. They stay where they are while the centroids move. In each round a
vector's distance to a centroid is at least the difference of their distances to any one
pivot. A vector first gets the exact distance to the centroid of the smallest such bound; centroids
whose bound is above it are ruled out, the others get exact integer distances. Bounds are roots
in doubles, lowered by more than their rounding error, so nothing within reach is ever ruled out.

A round is one pass over the table; tasks hand on sums for each centroid and component. Only
these, ``k * dimensions`` numbers, and the centroids come to the driver.

* Vectors that are null, have another number of components, or a null or non-finite one are left out.
* Fewer vectors than centroids: as many centroids as vectors. An empty table gives no rows.
* A null id is clustered like any other, but starts no centroid. Repeated rows each count; where
  they start centroids, equal hashes are ordered by their components.
* Ties go to the smaller centroid. An empty centroid stays where it is.
* Components beyond ``limit(dimensions)`` (2**27 for 64) are handled as Python's integers, without bounds.
  A squared distance, or a sum of them, that does not fit 64 bits is null.
* Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import batch_of, hold, nothing_kept, prepare
from pairloom.sources.staging import staged

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
MARGIN = 1e-12
_LIMB = 40
_LONG = 1 << 63


def limit(dimensions: int) -> int:
    """Squared distances of components up to this fit 64 bits with room to spare."""
    return isqrt((1 << 60) // dimensions)


def whole(x: float, scale: int) -> int:
    """``floor(scale * x)`` for a finite x of any size."""
    return scale * int(x) if abs(x) >= 1 << 53 else int(np.floor(scale * x))


def exact(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances, in the integers of the arrays."""
    apart = points - centroid
    return (apart * apart).sum(axis=1)


def from_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([exact(points, p) for p in pivots], axis=1) if len(pivots) else np.zeros((len(points), 0), np.int64)


def nearest(points: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each point's centroid and squared distance, and how many exact distances that took.

    ``table``: squared distances of points to pivots.
    """
    ours, theirs = np.sqrt(table), np.sqrt(from_pivots(centroids, pivots))
    lower = np.zeros((len(points), len(centroids)))
    for p in range(table.shape[1]):
        apart = np.abs(ours[:, p, None] - theirs[None, :, p]) - MARGIN * (ours[:, p, None] + theirs[None, :, p])
        np.maximum(lower, apart, out=lower)
    label = lower.argmin(axis=1)
    first = label.copy()
    best = exact(points, centroids[label])
    computed = len(points)
    for c in range(len(centroids)):
        near = np.flatnonzero((first != c) & (lower[:, c] <= np.sqrt(best) * (1 + MARGIN)))
        found = exact(points[near], centroids[c])
        computed += len(near)
        better = (found < best[near]) | (found == best[near]) & (c < label[near])
        best[near[better]] = found[better]
        label[near[better]] = c
    return label, best, computed


def nearest_exact(points: list[list[int]], centroids: list[list[int]]) -> tuple[list[int], list[int]]:
    """The same without bounds, for integers of any size."""
    pairs = [min((sum((a - b) ** 2 for a, b in zip(p, q)), c) for c, q in enumerate(centroids)) for p in points]
    return [c for _, c in pairs], [d for d, _ in pairs]


def fits(rows: list[list[int]], dimensions: int) -> bool:
    return all(abs(x) <= limit(dimensions) for row in rows for x in row)


def _pivoted(pivots: list[list[int]], scale: int, dimensions: int):
    """``(id, point, wide, table)``: whole numbers as packed 32-bit integers, or as text where they are too large."""
    narrow = fits(pivots, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("clustering", nothing_kept)
        fixed = np.array(pivots, np.int64) if narrow else None
        for batch in batches:
            vectors = batch.column(1).values.to_numpy(zero_copy_only=False)
            first = batch.column(1).offsets[0].as_py()
            vectors = vectors[first : first + batch.num_rows * dimensions].astype(np.float64).reshape(batch.num_rows, dimensions)
            small = (np.abs(vectors) * scale < limit(dimensions)).all(axis=1) if narrow else np.zeros(batch.num_rows, bool)
            points = np.floor(np.where(small[:, None], vectors, 0) * scale).astype(np.int64)
            far = from_pivots(points, fixed) if narrow else None
            point, wide, table = [], [], []
            for i, own in enumerate(small.tolist()):
                point.append(points[i].astype("<i4").tobytes() if own else None)
                table.append(far[i].astype("<i8").tobytes() if own else None)
                wide.append(None if own else ",".join(str(whole(float(x), scale)) for x in vectors[i]))
            yield batch_of({"id": (batch.column(0), None), "point": (point, pa.binary()), "wide": (wide, pa.string()), "table": (table, pa.binary())})

    return run


def _parts(batch: pa.RecordBatch, dimensions: int, centroids: list[list[int]], pivots: list[list[int]]):
    """``(rows, labels, distances, points)`` of the narrow and of the wide rows."""
    point, wide, table = (batch.column(batch.schema.get_field_index(c)) for c in ("point", "wide", "table"))
    small = np.flatnonzero(~np.asarray(point.is_null()))
    large = np.flatnonzero(np.asarray(point.is_null()))
    if len(small):
        points = np.frombuffer(b"".join(point.drop_null().to_pylist()), "<i4").reshape(len(small), dimensions).astype(np.int64)
        if fits(centroids, dimensions) and fits(pivots, dimensions):
            known = np.frombuffer(b"".join(table.drop_null().to_pylist()), "<i8").reshape(len(small), len(pivots))
            label, best, _ = nearest(points, known, np.array(centroids, np.int64), np.array(pivots, np.int64))
            yield small, label.tolist(), best.tolist(), points
        else:
            label, best = nearest_exact(points.tolist(), centroids)
            yield small, label, best, points
    if len(large):
        rows = [[int(x) for x in w.split(",")] for w in wide.drop_null().to_pylist()]
        label, best = nearest_exact(rows, centroids)
        yield large, label, best, rows


def limbs(value: int) -> list[int]:
    """A number as signed digits of 40 bits, lowest first."""
    sign, value, found = (-1 if value < 0 else 1), abs(value), []
    while value or not found:
        found.append(sign * (value & ((1 << _LIMB) - 1)))
        value >>= _LIMB
    return found


def _sums(dimensions: int, state):
    """A task's sums ``(cluster, component, limb, value)``; component -1 counts vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("clustering", nothing_kept)
        centroids, pivots = state.value
        total = [[0] * (dimensions + 1) for _ in centroids]
        for batch in batches:
            for _, label, _, points in _parts(batch, dimensions, centroids, pivots):
                label = np.array(label)
                for c in np.unique(label).tolist():
                    at = np.flatnonzero(label == c)
                    own = points[at].sum(axis=0).tolist() if isinstance(points, np.ndarray) else [sum(x) for x in zip(*(points[i] for i in at))]
                    total[c] = [a + b for a, b in zip(total[c], [*own, len(at)])]
        rows = [(c, j if j < dimensions else -1, i, x) for c, values in enumerate(total) if values[-1] for j, v in enumerate(values) for i, x in enumerate(limbs(v))]
        yield batch_of({name: ([r[i] for r in rows], pa.int64()) for i, name in enumerate(("cluster", "component", "limb", "value"))})

    return run


def _assigned(dimensions: int, state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("clustering", nothing_kept)
        centroids, pivots = state.value
        for batch in batches:
            label, distance = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for at, own, best, _ in _parts(batch, dimensions, centroids, pivots):
                label[at] = own
                for i, d in zip(at.tolist(), best):
                    distance[i] = d if d < _LONG else None
            yield batch_of({"id": (batch.column(0), None), "cluster": (pa.array(label), None), "distance": (distance, pa.int64())})

    return run


def moved(sums: dict[tuple[int, int], int], centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after a round: exact floors of the means; empty ones stay."""
    return [
        [sums.get((c, j), 0) // sums[c, -1] for j in range(len(old))] if sums.get((c, -1)) else old
        for c, old in enumerate(centroids)
    ]


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, dimensions: int) -> DataFrame:
    """``(id, vec)`` of the vectors that take part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("vec") == dimensions) & ~odd)


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector, and the centroids."""
    spark = prepare(vectors.sparkSession)
    rows = kept_vectors(vectors, id_col, vec_col, dimensions)
    kind = rows.schema["id"].dataType.simpleString()
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    starts = rows.where(F.col("id").isNotNull()).orderBy(hashed, "vec").limit(k).select("vec").collect()
    pivots = centroids = [[whole(x, scale) for x in r["vec"]] for r in starts]
    fields = f"id {kind}, cluster int, distance bigint"
    if not centroids:
        empty = spark.createDataFrame([], f"{fields}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return empty, []
    held = staged(rows.mapInArrow(_pivoted(pivots, scale, dimensions), f"id {kind}, point binary, wide string, table binary"), "pivots")
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((centroids, pivots))
        found = held.mapInArrow(_sums(dimensions, state), "cluster bigint, component bigint, limb bigint, value bigint")
        found = found.groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        sums: dict[tuple[int, int], int] = {}
        for r in found.collect():
            at = (r["cluster"], r["component"])
            sums[at] = sums.get(at, 0) + (int(r["value"]) << _LIMB * r["limb"])
        centroids = moved(sums, centroids)
    state = spark.sparkContext.broadcast((centroids, pivots))
    placed = staged(held.mapInArrow(_assigned(dimensions, state), fields), "placed")
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    inertia: dict[int, int | None] = {
        r["cluster"]: int(r["total"]) if r["known"] == r["n"] else None
        for r in placed.groupBy("cluster").agg(total, F.count("distance").alias("known"), F.count(F.lit(1)).alias("n")).collect()
    }
    known = list(inertia.values())
    overall = sum(known) if None not in known else None

    def of(values: list[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("cluster") + 1)

    def long(value: int | None) -> Column:
        return F.lit(value if value is not None and value < _LONG else None).cast("bigint")

    digest = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]
    result = placed.select(
        "id", "cluster", "distance", of([long(inertia.get(c, 0)) for c in range(len(centroids))]).alias("cluster_inertia"), long(overall).alias("inertia"), of(digest).alias("centroid_sha256")
    )
    return result, centroids
