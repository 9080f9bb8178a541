"""Steering targets and distances over activation vectors in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.arrays import euclidean_norm
from pairloom.functions.fixed_values import STEERING_ALPHA, STEERING_LAYERS

POSITION = ("example_id", "layer", "pos")


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def steering_targets(
    acts: DataFrame,
    alpha: float = STEERING_ALPHA,
    layers: Sequence[int] = STEERING_LAYERS,
    keys: Sequence[str] = POSITION,
    placed: bool = False,
) -> DataFrame:
    """``target = mask * (base + alpha * (pos - neg))`` per (example, layer, position).

    The layer and variant filters sit directly on the input, so they reach a file scan.
    Positions lacking any of the three variants are left out. ``placed`` says that the input is
    a table of ``write_placed``: then nothing is shuffled.
    """
    wide = _variants(acts, ("base", "pos", "neg"), layers, keys, placed)
    return wide.select(*keys, "mask", _target(alpha).alias("target"))


def _target(alpha: float) -> Column:
    direction = F.zip_with(_doubles(F.col("_pos")), _doubles(F.col("_neg")), lambda p, n: p - n)
    return F.zip_with(_doubles(F.col("_base")), direction, lambda b, d: (b + F.lit(float(alpha)) * d) * F.col("mask"))


def _variants(acts: DataFrame, variants: Sequence[str], layers: Sequence[int], keys: Sequence[str], placed: bool) -> DataFrame:
    """A row per position with the vectors of all its variants; positions that lack one are left out."""
    used = acts.where(F.col("layer").isin(*layers) & F.col("variant").isin(*variants))

    def of(variant: str, column: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(column)))

    # A few rows make a group, so combining before the shuffle would sort the vectors for
    # nothing: place them first, and both halves of the aggregation run after the shuffle.
    together = used if placed else used.repartition(*keys)
    wide = together.groupBy(*keys).agg(of("base", "mask").alias("mask"), *[of(v, "vec").alias(f"_{v}") for v in variants])
    complete = F.lit(True)
    for v in variants:
        complete = complete & F.col(f"_{v}").isNotNull()
    return wide.where(complete)


def write_placed(acts: DataFrame, table: str, buckets: int, keys: Sequence[str] = POSITION) -> DataFrame:
    """Save activations, or targets, as a table bucketed by position, and read it back.

    Vectors are shuffled once, here; whatever groups them by position later, or joins two such tables, does
    so where they lie. The number of buckets should be that of the tasks wanted.
    """
    spread = acts.repartition(buckets, *keys)
    spread.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return acts.sparkSession.table(table)


def steered_distance(
    acts: DataFrame,
    by: Sequence[str] = (),
    alpha: float = STEERING_ALPHA,
    layers: Sequence[int] = STEERING_LAYERS,
    keys: Sequence[str] = POSITION,
    placed: bool = False,
) -> DataFrame:
    """``alignment_distance`` of the model's vectors from the targets of the same table, in one grouping.

    Every vector is read, and moved, once; targets are never written nor joined.
    """
    wide = _variants(acts, ("base", "pos", "neg", "model"), layers, keys, placed)
    gap = F.zip_with(_doubles(F.col("_model")), _target(alpha), lambda v, t: v * F.col("mask") - t)
    return _mean_distance(wide.select(*keys, "mask", euclidean_norm(gap).alias("distance")), by)


def activation_distances(acts: DataFrame, targets: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """Euclidean distance of each masked model vector from its target."""
    model = acts.where(F.col("variant") == "model").select(*keys, "vec")
    gap = F.zip_with(_doubles(F.col("vec")), "target", lambda v, t: v * F.col("mask") - t)
    return targets.join(model, list(keys)).select(*keys, "mask", euclidean_norm(gap).alias("distance"))


def alignment_distance(
    acts: DataFrame, targets: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = POSITION
) -> DataFrame:
    """Mean distance, overall or ``by`` (say) layer.

    NaN distances are left out of the mean; masked positions are 0 and stay in it.
    """
    return _mean_distance(activation_distances(acts, targets, keys), by)


def _mean_distance(distances: DataFrame, by: Sequence[str]) -> DataFrame:
    distance = F.when(~F.isnan("distance"), F.col("distance"))
    return distances.groupBy(*by).agg(F.avg(distance).alias("distance"), F.count(F.lit(1)).alias("positions"))
