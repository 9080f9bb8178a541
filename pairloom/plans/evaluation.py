"""Multiple-choice sets and token scores -> one accuracy per set."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.choices import assert_no_nan, eval_report, score_questions, sequence_logprob


def evaluate_sets(sets: Mapping[str, tuple[DataFrame, DataFrame]], key: str = "q") -> DataFrame:
    """(eval_set, metric, value) from ``{set: (exploded choices, token scores)}``; NaN scores are refused."""
    scored = [
        score_questions(choices, assert_no_nan(sequence_logprob(scores, [key, "choice"]), ["logprob"]), key).withColumn(
            "eval_set", F.lit(name)
        )
        for name, (choices, scores) in sets.items()
    ]
    return eval_report(reduce(DataFrame.unionByName, scored))
