"""Clustering against plain rounds over Python's integers."""

from __future__ import annotations

import hashlib
from collections import Counter
from math import floor

import numpy as np
import pytest
from oracle_check import connect, difference

from pairloom.llm import clustering, queries


def brute(rows, k, rounds, dims, scale):
    kept = [(i, [scale * int(x) if abs(x) > 2**60 else floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in starts]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    own = assign() if centroids else []
    total = Counter()
    for d, j in own:
        total[j] += d

    def long(x):
        return x if x < 2**63 else None

    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, long(d), long(total[j]), long(sum(total.values())), hashes[j]) for (i, _), (d, j) in zip(kept, own))


def vectors(dims, n=200, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).astype(np.float32).astype(float).tolist()) for i in range(n)]
    return [(i, rows[n // 5][1] if n // 5 <= i < n // 2 else v) for i, v in rows]  # a hot vector


ODD = [(900, None), (901, []), (902, [1.0] * 3), (903, [float("nan")] + [0.0] * 7), (904, [float("-inf")] + [0.0] * 7), (905, [None] + [0.0] * 7), (906, [0.0] * 8)]


def test_clusters(spark):
    rows = vectors(8) + ODD + [(None, [0.5] * 8), (12, vectors(8)[12][1]), (12, [2.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(5)
    found, centroids = clustering.cluster(df, k=6, rounds=3, dimensions=8)
    assert Counter(tuple(r) for r in found.collect()) == brute(rows, 6, 3, 8, 64)
    assert len(centroids) == 6


@pytest.mark.parametrize("far", [3.0e7, 1e30, -1.5e300])
def test_large_components(spark, far):
    """Beyond 32 bits, and distances beyond 64."""
    rows = vectors(8, 30) + [(500, [far] + [0.25] * 7), (501, [far, -far] + [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (3, 32):
        found, _ = clustering.cluster(df, k=k, rounds=2, dimensions=8)
        got = Counter((r["id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in found.collect())
        assert got == Counter({(i, j, d, h): n for (i, j, d, _, _, h), n in brute(rows, k, 2, 8, 64).items()})


def test_few_and_no_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, centroids = clustering.cluster(df, dimensions=2)
    assert len(centroids) == 2 and Counter(map(tuple, found.collect())) == brute(rows, 16, 3, 2, 64)
    assert clustering.cluster(df.limit(0), dimensions=2)[0].count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bounds_rule_nothing_out_that_is_near(seed):
    rng = np.random.default_rng(seed)
    spread = int(rng.choice([2, 50, clustering.limit(16)]))
    middles = rng.integers(-spread, spread + 1, (6, 16))
    points = np.clip(middles[rng.integers(0, 6, 500)] + rng.integers(-1, 2, (500, 16)), -clustering.limit(16), clustering.limit(16))
    centroids = points[rng.permutation(500)[:9]]
    pivots = points[rng.permutation(500)[:4]]
    label, best, computed = clustering.nearest(points, clustering.from_pivots(points, pivots), centroids, pivots)
    expected = clustering.nearest_exact(points.tolist(), centroids.tolist())
    assert (label.tolist(), best.tolist()) == expected
    if spread > 2:
        assert computed < 0.6 * 500 * 9  # most distances are ruled out where vectors lie in groups


@pytest.mark.parametrize("value", [0, 5, -5, 1 << 40, -(1 << 40) - 3, 7 << 200, -(3 << 119) + 1])
def test_limbs(value):
    assert sum(x << 40 * i for i, x in enumerate(clustering.limbs(value))) == value


def test_op13(spark, data_dir):
    with connect(data_dir) as con:
        assert difference(queries.op13_clustering(spark, data_dir), con, queries.ORACLES["op13_clustering"]) is None
