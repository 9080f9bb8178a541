"""Model completions: pairing them with their requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.prompts import format_prompts


def completion_requests(instructions: DataFrame, style: str = "dialogue") -> DataFrame:
    """Add the ``prompt`` a model is asked to complete."""
    return format_prompts(instructions, style, col="instruction", out="prompt")


def clean_completions(requests: DataFrame, completions: DataFrame, generator: str, key: str = "id") -> DataFrame:
    """(key, instruction, output, generator): the decoded text with the prompt taken out.

    Every occurrence of the prompt goes. A request with no completion has a null output.
    """
    return requests.join(completions.select(key, "completion"), key, "left").select(
        key,
        "instruction",
        F.replace(F.col("completion"), F.col("prompt"), F.lit("")).alias("output"),
        F.lit(generator).alias("generator"),
    )
