"""Preference tables -> contrast-encoded training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.fixed_values import PROMPT_BUDGET, RESPONSE_LENGTH
from pairloom.functions.text import Tokenizer
from pairloom.operators.encoding import Limits, encode_contrast
from pairloom.operators.lengths import filter_prompt_budget, token_lengths
from pairloom.operators.prompts import (
    append_eos,
    format_prompts,
    mark_turn_boundaries,
    preference_branches,
    random_preference_swap,
    summary_preferences,
)


KINDS = ("preference", "transcript", "summary")


def _measured(source: DataFrame, kind: str, tokens: Tokenizer | None) -> DataFrame:
    """Prompt, its length, and closed ``chosen_response`` / ``rejected_response`` of one record kind."""
    if kind == "preference":
        return token_lengths(format_prompts(source, "dialogue"), {"prompt_length": "prompt"}, tokens)
    if kind == "transcript":
        # Measured before the leading newlines come back.
        marked = token_lengths(mark_turn_boundaries(source), {"prompt_length": "prompt"}, tokens)
        closed = append_eos(marked, ["chosen", "rejected"]).withColumn("prompt", F.concat(F.lit("\n\n"), "prompt"))
        return closed.withColumnsRenamed({"chosen": "chosen_response", "rejected": "rejected_response"})
    if kind == "summary":
        worse = summary_preferences(source, "rejected").withColumnRenamed("chosen", "rejected_response")
        both = summary_preferences(worse, "chosen").withColumnRenamed("chosen", "chosen_response")
        return token_lengths(both, {"prompt_length": "prompt"}, tokens)
    raise ValueError(f"unknown record kind {kind!r}; one of {KINDS}")


def alignment_examples(
    source: DataFrame,
    key: str,
    data_type: str = "all",
    prompt_budget: int = PROMPT_BUDGET,
    seed: int | str = 42,
    tokens: Tokenizer | None = None,
    kind: str = "preference",
) -> DataFrame:
    """(key, branch, prompt, chosen, prompt_length) within the prompt budget.

    ``kind`` is the record kind of the source: prepared ``preference`` pairs,
    ``transcript`` pairs or ``summary`` comparisons. ``data_type`` is ``chosen``,
    ``rejected``, ``all`` for both, or (for preference pairs) ``random`` for one of the
    two by a seeded draw. Random examples are measured before wrapping, in the style that
    has no leading newlines.
    """
    if data_type == "random":
        if kind != "preference":
            raise ValueError("random examples are drawn from preference pairs only")
        swapped = random_preference_swap(source, key, seed, tokens=tokens).withColumn("branch", F.lit("random"))
        kept = filter_prompt_budget(swapped, prompt_budget)
    else:
        # Measured and filtered before the branches double the rows.
        measured = filter_prompt_budget(_measured(source, kind, tokens), prompt_budget)
        kept = preference_branches(measured, data_type, out="chosen")
    return kept.select(key, "branch", "prompt", "chosen", "prompt_length")


def alignment_rows(
    source: DataFrame,
    key: str,
    vocab: DataFrame,
    data_type: str = "all",
    prompt_budget: int = PROMPT_BUDGET,
    max_res_len: int = RESPONSE_LENGTH,
    seed: int | str = 42,
    tokens: Tokenizer | None = None,
    limits: Limits = Limits(),
    kind: str = "preference",
) -> DataFrame:
    """Three fixed-width rows (orig, pos, neg) for every example."""
    examples = alignment_examples(source, key, data_type, prompt_budget, seed, tokens, kind)
    return encode_contrast(
        examples,
        [key, "branch"],
        vocab,
        prompt_len=prompt_budget,
        max_res_len=max_res_len,
        tokens=tokens,
        limits=limits,
    )
