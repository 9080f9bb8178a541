"""Instructions and model completions -> records for a judge."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairloom.operators.completions import clean_completions, completion_requests
from pairloom.sources.writers import write_completions


def export_completions(
    instructions: DataFrame, completions: DataFrame, generator: str, path: str, style: str = "dialogue"
) -> None:
    """Pair completions with their requests, drop the prompts, write JSON Lines."""
    write_completions(clean_completions(completion_requests(instructions, style), completions, generator), path)
