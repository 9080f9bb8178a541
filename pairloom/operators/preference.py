"""Contrastive preference score from per-token losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.fixed_values import CONTRAST_EPSILON, CONTRAST_FLOOR, IGNORE_LABEL


def contrastive_preference(
    token_loss: DataFrame, eps: float = CONTRAST_EPSILON, key: str = "id", ignore: int = IGNORE_LABEL
) -> DataFrame:
    """Per example: mean losses, ``pos_lp``, ``neg_lp`` and ``score``.

    With P = exp(-mean loss) under each condition, ``pos_lp = -ln(P+ / (P+ + P-) + 1e-8)``
    and the score is ``(1 - eps) pos_lp + eps neg_lp``. The mean divides by all
    positions; ignored ones count as 0. The ratio is taken as a logistic of the difference
    of means, which cannot divide zero by zero.
    """
    counted = F.when(F.col("label") == ignore, 0.0).otherwise(F.col("loss"))

    def mean_loss(condition: str) -> Column:
        return F.avg(F.when(F.col("cond") == condition, counted))

    def lp(own: str, other: str) -> Column:
        share = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col(own) - F.col(other)))
        return -F.ln(share + F.lit(CONTRAST_FLOOR))

    return (
        token_loss.groupBy(key)
        .agg(mean_loss("pos").alias("pos_loss"), mean_loss("neg").alias("neg_loss"))
        .withColumns({"pos_lp": lp("pos_loss", "neg_loss"), "neg_lp": lp("neg_loss", "pos_loss")})
        .withColumn("score", (1 - eps) * F.col("pos_lp") + eps * F.col("neg_lp"))
    )


def contrastive_loss(token_loss: DataFrame, eps: float = CONTRAST_EPSILON, key: str = "id") -> DataFrame:
    """One row: the mean score over the table, and the examples it covers."""
    return contrastive_preference(token_loss, eps, key).agg(
        F.avg("score").alias("score"), F.count("score").alias("examples")
    )
