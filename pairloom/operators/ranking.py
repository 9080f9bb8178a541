"""Exact ranks, splits, shuffles and batches with no single-task sort.

A global order is cut into buckets that are monotone in it (the leading hex digits of a
keyed hash, below a sort value where there is one). Row numbers are taken inside each
bucket, in parallel, and the bucket's starting rank is added. Only the bucket *counts*
ever meet in one task: at most ``16 ** digits`` rows for a hash order.

The input is read twice, once for the counts (key columns only). It must therefore be
deterministic: read from files or staged, never fed by ``rand()`` or ``limit``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.fixed_values import GROUP_BATCHES, PAD_MULTIPLE, TEST_ROWS
from pairloom.functions.hashing import order_hash
from pairloom.sources.staging import staged

HASH_DIGITS = 4  # 65,536 buckets: about 1.5 million rows each at 10^11 rows
GROUPED_DIGITS = 3  # 4,096 buckets for every group or sort value

HEAD_KEYS = 10_000  # keys a task may hold for a top-n

# Counts of a hash order have at most 16 ** 4 rows of two numbers, so they may be broadcast.
MAX_BROADCAST_BUCKETS = 16**4


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def exact_rank(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str = 42,
    by: Column | None = None,
    within: str | Sequence[str] = (),
    out: str = "rank",
    total: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Add the 0-based rank of every row in the order (``by``, md5(seed:key), key).

    ``key`` must identify rows. ``within`` restarts the rank for each combination of
    those columns; ``total`` names an optional column for the number of rows ranked
    together. ``by`` ascends: negate it for a descending order. A group or a sort value
    that holds a third of all rows is still spread over ``16 ** digits`` buckets.
    """
    keys, groups = _names(key), _names(within)
    plain = by is None and not groups
    digits = digits or (HASH_DIGITS if plain else GROUPED_DIGITS)
    work = df.withColumn("_hash", order_hash(seed, *keys))
    # One struct is the join key on both sides. Nulls inside structs compare equal, so
    # a null group is a group, and the join reuses the window's partitioning.
    bucket = [F.col(g) for g in groups]
    if by is not None:
        bucket.append(by.alias("_by"))
    bucket.append(F.substring("_hash", 1, digits).alias("_prefix"))
    work = work.withColumn("_bucket", F.struct(*bucket))

    counts = work.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    starts = _bucket_starts(counts, groups, by is not None, total is not None)
    if plain and 16**digits <= MAX_BROADCAST_BUCKETS:
        starts = F.broadcast(starts)

    inside = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    ranked = work.withColumn("_local", F.row_number().over(inside) - 1).join(starts, "_bucket")
    added = [(F.col("_start") + F.col("_local")).cast("long").alias(out)]
    if total is not None:
        added.append(F.col("_total").cast("long").alias(total))
    return ranked.select(*df.columns, *added)


def _bucket_starts(counts: DataFrame, groups: list[str], by: bool, total: bool) -> DataFrame:
    """Rank of the first row of each bucket (and the size of its group, if asked for)."""
    before = (Window.unboundedPreceding, -1)
    group = [F.col("_bucket")[g] for g in groups]
    prefix = F.col("_bucket")["_prefix"]
    if not by:
        running = Window.partitionBy(*group).orderBy(prefix).rowsBetween(*before)
        starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
        if total:
            starts = starts.withColumn("_total", F.sum("_rows").over(Window.partitionBy(*group)))
        return starts.drop("_rows")

    # Two levels: the start of each sort value, then of each bucket in it. The first sees
    # one row per distinct value. Distinct lengths are bounded by the longest text, and
    # distinct frequencies f by f(f+1)/2 <= number of tokens.
    value = F.struct(*[g.alias(n) for g, n in zip(group, groups)], F.col("_bucket")["_by"].alias("_by"))
    in_value = Window.partitionBy("_value").orderBy(prefix).rowsBetween(*before)
    in_value_starts = counts.withColumn("_value", value).select(
        "_bucket",
        "_value",
        F.coalesce(F.sum("_rows").over(in_value), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy("_value")).alias("_value_rows"),
    )
    values = in_value_starts.where(F.col("_start") == 0).select("_value", "_value_rows")
    value_group = [F.col("_value")[g] for g in groups]
    over_values = Window.partitionBy(*value_group).orderBy(F.col("_value")["_by"]).rowsBetween(*before)
    value_starts = values.select(
        "_value",
        F.coalesce(F.sum("_value_rows").over(over_values), F.lit(0)).alias("_value_start"),
        F.sum("_value_rows").over(Window.partitionBy(*value_group)).alias("_total"),
    )
    starts = in_value_starts.join(value_starts, "_value").withColumn(
        "_start", F.col("_start") + F.col("_value_start")
    )
    return starts.select("_bucket", "_start", *(["_total"] if total else []))


def random_split(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str = 42,
    test: int = TEST_ROWS,
    out: str = "split",
) -> DataFrame:
    """Label rows ``rm``, ``ppo`` or ``test`` in a seeded order, with exact sizes.

    The last ``test`` rows of the order are the test split, the first
    ``(n - test) // 2`` are ``rm`` and the rest ``ppo``. ``key`` must identify rows;
    fewer than ``test`` rows raise an error when the plan runs.

    No row is shuffled: two cut points are found from bucket counts and from the keys of
    the two buckets they fall in, and come back as a one-row scalar subquery. Labelling
    is then a comparison in the scan's own stage, whatever the size of the table. The
    key columns are read twice more; stage an expensive input first.
    """
    keys = _names(key)
    position = F.struct(order_hash(seed, *keys).alias("_hash"), *[F.col(k) for k in keys])
    prefixed = df.select(position.alias("_position")).withColumn(
        "_prefix", F.substring(F.col("_position")["_hash"], 1, HASH_DIGITS)
    )
    running = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = (
        prefixed.groupBy("_prefix")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_prefix",
            "_rows",
            F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_start"),
            F.sum("_rows").over(everything).alias("_total"),
        )
    )
    enough = F.when(
        F.col("_total") < test,
        F.raise_error(F.concat(F.lit(f"cannot hold out {test} test rows of "), F.col("_total").cast("string"))),
    ).otherwise(F.col("_total"))
    kept = enough.cast("long") - test
    targets = F.array(
        F.struct(F.lit("ppo").alias("_from"), F.floor(kept / 2).alias("_at")),
        F.struct(F.lit("test").alias("_from"), kept.alias("_at")),
    )
    boundary = (
        counts.select("_prefix", "_rows", "_start", F.explode(targets).alias("_cut"))
        .where(
            (F.col("_cut")["_at"] >= F.col("_start"))
            & (F.col("_cut")["_at"] < F.col("_start") + F.col("_rows"))
        )
        .groupBy("_prefix")
        .agg(
            *[
                F.max(F.when(F.col("_cut")["_from"] == name, F.col("_cut")["_at"] - F.col("_start"))).alias(name)
                for name in ("ppo", "test")
            ]
        )
    )
    # At most two buckets hold a cut, so this side has at most two rows.
    inside = Window.partitionBy("_prefix").orderBy("_position")
    near = prefixed.join(F.broadcast(boundary), "_prefix").withColumn("_local", F.row_number().over(inside) - 1)

    cuts = near.agg(
        F.struct(
            *[F.max(F.when(F.col("_local") == F.col(name), F.col("_position"))).alias(name) for name in ("ppo", "test")]
        )
    ).scalar()
    ppo_from, test_from = cuts["ppo"], cuts["test"]
    # A cut past the last row has no first row and leaves its split empty. The position
    # is a column of its own so that each row is hashed once for both comparisons.
    label = (
        F.when(test_from.isNotNull() & (F.col("_position") >= test_from), "test")
        .when(ppo_from.isNotNull() & (F.col("_position") >= ppo_from), "ppo")
        .otherwise("rm")
    )
    return df.withColumn("_position", position).select(*df.columns, label.alias(out))


def concat_examples(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both tables (duplicates kept), columns matched by name.

    For two branches of one source, ``preference_branches`` reads that source once.
    """
    return first.unionByName(second)


def seeded_shuffle(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str = 42,
    out: str = "shuffle_rank",
    ordered: bool = False,
) -> DataFrame:
    """Reproducible random order, as a rank column.

    Files have no row order, so the rank *is* the shuffle; ``ordered=True`` also lays the
    rows out by it, at the price of a range shuffle.
    """
    shuffled = exact_rank(df, key, seed, out=out)
    return shuffled.orderBy(out) if ordered else shuffled


def head_examples(df: DataFrame, n: int, key: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows in key order. ``key`` must identify rows.

    The last key to keep comes from the key columns alone; the rows themselves only pass a
    filter. A small ``n`` is a top-``n``; for a large one the keys are dealt into ranges first,
    and only the range that the cut falls into is sorted.
    """
    position = F.struct(*[F.col(k) for k in _names(key)])
    keys, left = df.select(position.alias("_position")), n
    if n > HEAD_KEYS:
        keys, left = _range_of_cut(keys, n)
    last = keys.orderBy("_position").limit(left).agg(F.max("_position")).scalar()
    return df.where(position <= last)


def _range_of_cut(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The range of keys that holds the ``n``-th, and its place there; all keys, should there be fewer."""
    ranges = staged(keys.repartitionByRange("_position").withColumn("_range", F.spark_partition_id()), "head_keys")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(F.col("_start") < n)
    cut = starts.orderBy(F.desc("_start")).first()
    if cut is None:
        return ranges.select("_position"), n
    return ranges.where(F.col("_range") == cut["_range"]).select("_position"), n - cut["_start"]


def _grouped_order(narrow: DataFrame, keys: list[str], seed: int | str, size: int, group_batches: int) -> DataFrame:
    """``narrow`` with the rank that sorting by length inside groups of a seeded shuffle gives.

    No global sort: the shuffle is an exact rank, and a group is a window of bounded size.
    """
    shuffled = staged(exact_rank(narrow, keys, seed, out="_at", total="_n"), "shuffled")
    width = F.greatest(F.least(F.floor(F.col("_n") / (4 * size)), F.lit(group_batches)), F.lit(1)) * size
    grouped = shuffled.withColumn("_width", width).withColumn("_group", F.floor(F.col("_at") / F.col("_width")))
    inside = Window.partitionBy("_group").orderBy(F.desc("_length"), "_at")
    placed = grouped.withColumn("_place", F.row_number().over(inside) - 1)
    # The first of the longest heads changes places with the head of the first group.
    top = -placed.where("_place = 0").agg(F.max(F.struct("_length", (-F.col("_group")).alias("_first")))).scalar()["_first"]
    head = F.col("_place") == 0
    rank = (
        F.when(head & (F.col("_group") == top), F.lit(0))
        .when(head & (F.col("_group") == 0), top * F.col("_width"))
        .otherwise(F.col("_group") * F.col("_width") + F.col("_place"))
    )
    return placed.select(*narrow.columns, rank.cast("long").alias("batch_rank"))


def plan_batches(
    df: DataFrame,
    key: str | Sequence[str],
    length: str,
    size: int,
    by: str = "order",
    order: str | None = None,
    seed: int | str = 42,
    multiple: int = PAD_MULTIPLE,
    group_batches: int = GROUP_BATCHES,
) -> DataFrame:
    """Narrow table (key, rank, batch_id, padded_length, pad_waste), one row per example.

    ``by="order"`` slices the dense 0-based rank in column ``order`` (a shuffle's, say),
    or a seeded shuffle when none is named; ``by="length"`` puts similar lengths together.
    ``by="grouped"`` shuffles first and sorts by length, longest first, only inside groups of
    ``group_batches`` batches (fewer for a small table), so that batches stay random; the
    longest example of all is in the first batch, where it shows at once whether it fits into memory.
    ``padded_length`` is the batch's longest example rounded up to ``multiple``.
    """
    keys = _names(key)
    narrow = df.select(*keys, F.col(length).alias("_length"), *([order] if order else []))
    if by == "length":
        ranked = exact_rank(narrow, keys, seed, by=F.col("_length"), out="batch_rank")
    elif by == "grouped":
        ranked = _grouped_order(narrow, keys, seed, size, group_batches)
    elif by != "order":
        raise ValueError(f"by must be 'order', 'length' or 'grouped', not {by!r}")
    elif order is None:
        ranked = exact_rank(narrow, keys, seed, out="batch_rank")
    else:
        ranked = narrow.withColumn("batch_rank", F.col(order).cast("long"))
    batch = F.floor(F.col("batch_rank") / F.lit(size)).alias("batch_id")
    # A batch has at most ``size`` rows of a few numbers: a window over it cannot skew.
    longest = F.max("_length").over(Window.partitionBy("batch_id"))
    padded = (F.ceil(longest / F.lit(multiple)) * multiple).cast("long")
    return (
        ranked.select(*keys, "_length", "batch_rank", batch)
        .withColumn("padded_length", padded)
        .select(*keys, "batch_rank", "batch_id", "padded_length", (F.col("padded_length") - F.col("_length")).alias("pad_waste"))
    )


def assign_batches(
    df: DataFrame,
    key: str | Sequence[str],
    length: str,
    size: int,
    by: str = "order",
    order: str | None = None,
    seed: int | str = 42,
    multiple: int = PAD_MULTIPLE,
    group_batches: int = GROUP_BATCHES,
) -> DataFrame:
    """Add batch columns to every row. Wide rows move once, to meet their narrow plan."""
    return df.join(plan_batches(df, key, length, size, by, order, seed, multiple, group_batches), _names(key))
