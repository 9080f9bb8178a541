"""Raw preference pairs -> budgeted, split training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.functions.fixed_values import PROMPT_BUDGET, TEST_ROWS, TOTAL_BUDGET
from pairloom.functions.text import Tokenizer
from pairloom.operators.lengths import filter_pair_budget, token_lengths
from pairloom.operators.prompts import append_eos, extract_responses, format_prompts
from pairloom.operators.ranking import random_split
from pairloom.sources.readers import read_examples
from pairloom.sources.staging import staged
from pairloom.sources.writers import split_manifest, write_splits


def prepare_pairs(
    pairs: DataFrame,
    prompt_budget: int = PROMPT_BUDGET,
    total_budget: int = TOTAL_BUDGET,
    tokens: Tokenizer | None = None,
) -> DataFrame:
    """Responses out of their messages, dialogue prompts, lengths, and the length budget.

    One stage: a scan, expressions and a filter. Works on a stream as well.
    """
    closed = append_eos(extract_responses(pairs), ["chosen_response", "rejected_response"])
    measured = token_lengths(
        format_prompts(closed, "dialogue"),
        {
            "prompt_length": "prompt",
            "chosen_response_length": ("prompt", "chosen_response"),
            "rejected_response_length": ("prompt", "rejected_response"),
        },
        tokens,
    )
    return filter_pair_budget(measured, prompt_budget, total_budget)


def split_pairs(prepared: DataFrame, key: str, seed: int | str = 42, test: int = TEST_ROWS) -> DataFrame:
    """Stage the prepared table, then label its splits.

    Splitting reads the keys again; staging makes that a read of one column rather than
    another pass of tokenizing.
    """
    return random_split(staged(prepared, "prepared_pairs"), key, seed, test)


def preparation_manifest(
    pairs: DataFrame,
    key: str,
    prompt_budget: int = PROMPT_BUDGET,
    total_budget: int = TOTAL_BUDGET,
    test: int = TEST_ROWS,
    seed: int | str = 42,
) -> DataFrame:
    """Rows and bytes of each split after the length budget."""
    labelled = split_pairs(prepare_pairs(pairs, prompt_budget, total_budget), key, seed, test)
    return split_manifest(labelled, ["prompt", "chosen_response", "rejected_response"])


def prepare_and_save(
    spark: SparkSession, source: str, out: str, key: str, seed: int | str = 42, test: int = TEST_ROWS
) -> None:
    """The whole preparation, file to files."""
    write_splits(split_pairs(prepare_pairs(read_examples(spark, source)), key, seed, test), out)
