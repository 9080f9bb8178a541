from __future__ import annotations

import hashlib

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairloom import operators as op


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def keys(spark, n):
    return spark.range(n).select(F.col("id").alias("k"))


def test_rank_is_the_global_hash_order(spark):
    want = {k: i for i, k in enumerate(sorted(range(3000), key=lambda k: md5(f"42:{k}")))}
    for digits in (1, 2, 4):
        got = {r["k"]: r["rank"] for r in op.exact_rank(keys(spark, 3000), "k", digits=digits).collect()}
        assert got == want


def test_rank_by_value_with_a_hot_value(spark):
    # A third of the rows share one value, and one value is null.
    df = keys(spark, 3000).withColumn("v", F.when(F.col("k") % 3 == 0, 7).when(F.col("k") != 1, F.col("k") % 11))
    values = {r["k"]: r["v"] for r in df.collect()}
    order = sorted(range(3000), key=lambda k: (values[k] is not None, values[k] or 0, md5(f"42:{k}")))
    got = {r["k"]: r["rank"] for r in op.exact_rank(df, "k", by=F.col("v")).collect()}
    assert got == {k: i for i, k in enumerate(order)}


def test_rank_within_groups_with_a_hot_group(spark):
    df = keys(spark, 2000).withColumn("g", F.when(F.col("k") % 2 == 0, "hot").when(F.col("k") % 7 != 0, "cool"))
    rows = op.exact_rank(df, "k", within="g", total="n").collect()
    for group in ("hot", "cool", None):
        mine = [r for r in rows if r["g"] == group]
        order = sorted((r["k"] for r in mine), key=lambda k: md5(f"42:{k}"))
        assert {r["k"]: r["rank"] for r in mine} == {k: i for i, k in enumerate(order)}
        assert {r["n"] for r in mine} == {len(mine)}


def test_rank_by_value_within_groups(spark):
    df = keys(spark, 1000).select("k", (F.col("k") % 3).alias("g"), (F.col("k") % 10).alias("v"))
    rows = op.exact_rank(df, "k", by=-F.col("v"), within=["g"], total="n").collect()
    for group in range(3):
        mine = [r for r in rows if r["g"] == group]
        order = sorted(mine, key=lambda r: (-r["v"], md5(f"42:{r['k']}")))
        assert [r["rank"] for r in order] == list(range(len(mine)))
        assert {r["n"] for r in mine} == {len(mine)}


@pytest.mark.parametrize(("n", "test"), [(233, 10), (234, 10), (50, 50), (51, 50), (20, 0), (1, 1)])
def test_split_sizes(spark, n, test):
    rows = op.random_split(keys(spark, n), "k", 42, test).collect()
    by_split = {s: {r["k"] for r in rows if r["split"] == s} for s in ("rm", "ppo", "test")}
    order = sorted(range(n), key=lambda k: md5(f"42:{k}"))
    half = (n - test) // 2
    assert by_split == {"rm": set(order[:half]), "ppo": set(order[half : n - test]), "test": set(order[n - test :])}
    assert len(rows) == n


def test_split_is_stable_under_repartitioning(spark):
    df = keys(spark, 500)
    split = lambda d: {r["k"]: r["split"] for r in op.random_split(d, "k", 1, 100).collect()}
    assert split(df) == split(df.repartition(13))


def test_split_of_composite_keys(spark):
    df = keys(spark, 100).select((F.col("k") % 10).alias("a"), F.floor(F.col("k") / 10).cast("string").alias("b"))
    counts = {r["split"]: r["count"] for r in op.random_split(df, ["a", "b"], 5, 9).groupBy("split").count().collect()}
    assert counts == {"rm": 45, "ppo": 46, "test": 9}


def test_split_of_too_few_rows(spark):
    with pytest.raises((PySparkException, Py4JJavaError), match="cannot hold out 11 test rows of 10"):
        op.random_split(keys(spark, 10), "k", 42, 11).collect()


def test_shuffle(spark):
    want = sorted(range(300), key=lambda k: md5(f"9:{k}"))
    shuffled = op.seeded_shuffle(keys(spark, 300).repartition(7), "k", 9, ordered=True)
    assert [r["k"] for r in shuffled.collect()] == want


def test_head_keeps_n(spark):
    assert sorted(r["k"] for r in op.head_examples(keys(spark, 1000).repartition(5), 7, "k").collect()) == list(range(7))
    assert op.head_examples(keys(spark, 5), 7, "k").count() == 5


def test_batches_by_length(spark):
    df = keys(spark, 103).withColumn("len", (F.col("k") * 37 % 50 + 1).cast("int"))
    rows = op.assign_batches(df, "k", "len", 8, by="length").collect()
    order = sorted(rows, key=lambda r: (r["len"], md5(f"42:{r['k']}")))
    for i, r in enumerate(order):
        batch = order[i // 8 * 8 : i // 8 * 8 + 8]
        padded = -(-max(b["len"] for b in batch) // 8) * 8
        assert (r["batch_rank"], r["batch_id"], r["padded_length"]) == (i, i // 8, padded)
        assert r["pad_waste"] == padded - r["len"]


def test_batches_by_given_order_leave_no_empty_batch(spark):
    df = keys(spark, 16).withColumn("len", F.lit(3))
    rows = op.assign_batches(df, "k", "len", 8, order="k").collect()
    assert {r["batch_id"] for r in rows} == {0, 1}
    assert all(r["batch_id"] == r["k"] // 8 and r["padded_length"] == 8 for r in rows)
    with pytest.raises(ValueError):
        op.plan_batches(df, "k", "len", 8, by="colour")


@pytest.mark.parametrize("n", [1, 499, 500, 2000, 5000])
def test_head_by_ranges(spark, monkeypatch, n):
    """Beyond a few keys, only the range with the cut is sorted."""
    from pairloom.operators import ranking

    monkeypatch.setattr(ranking, "HEAD_KEYS", 100)
    df = spark.range(2000).select(((F.col("id") * 7919) % 2000).alias("k"), F.lit("x").alias("v"))
    assert sorted(r["k"] for r in op.head_examples(df, n, "k").collect()) == list(range(min(n, 2000)))
    assert op.head_examples(df.limit(0), n, "k").count() == 0


@pytest.mark.parametrize("n, size, groups", [(1003, 8, 50), (1003, 8, 3), (17, 4, 50), (3, 8, 50), (640, 1, 2)])
def test_grouped_batches(spark, n, size, groups):
    """A shuffle, sorted by length inside groups of batches, the longest example first of all."""
    df = keys(spark, n).withColumn("len", (F.col("k") * 37 % 50 + 1).cast("int"))
    lengths = {r["k"]: r["len"] for r in df.collect()}
    shuffled = sorted(lengths, key=lambda k: (md5(f"42:{k}"), k))
    width = max(1, min(n // (4 * size), groups)) * size
    parts = [sorted(shuffled[i : i + width], key=lambda k: -lengths[k]) for i in range(0, n, width)]
    top = max(range(len(parts)), key=lambda g: (lengths[parts[g][0]], -g))
    parts[0][0], parts[top][0] = parts[top][0], parts[0][0]
    rows = op.plan_batches(df, "k", "len", size, by="grouped", group_batches=groups).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["batch_rank"])] == [k for part in parts for k in part]
    assert sorted(r["batch_rank"] for r in rows) == list(range(n)) and all(r["batch_id"] == r["batch_rank"] // size for r in rows)


def test_grouped_batches_of_no_rows(spark):
    df = keys(spark, 5).withColumn("len", F.lit(1)).limit(0)
    assert op.plan_batches(df, "k", "len", 8, by="grouped").count() == 0
