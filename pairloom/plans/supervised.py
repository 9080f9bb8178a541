"""Preference pairs or transcripts -> budgeted training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.fixed_values import PROMPT_BUDGET, TOTAL_BUDGET
from pairloom.functions.text import Tokenizer, joined_token_count, token_count
from pairloom.operators.lengths import filter_text_budget, token_lengths
from pairloom.operators.prompts import build_training_text, format_prompts, preference_side


def supervised_texts(
    source: DataFrame,
    kind: str = "preference",
    data_type: str = "chosen",
    prompt_budget: int = PROMPT_BUDGET,
    total_budget: int = TOTAL_BUDGET,
    tokens: Tokenizer | None = None,
) -> DataFrame:
    """``text`` with ``prompt_length`` and ``text_length``, within both budgets. One stage.

    ``kind`` is ``preference``, whose prompt is measured as wrapped, or ``sft`` for
    transcripts, whose prompt is measured as it stands.
    """
    if kind == "preference":
        response = F.col(preference_side(data_type) + "_response")
        wrapped = token_lengths(format_prompts(source, "dialogue", out="_prompt"), {"prompt_length": "_prompt"}, tokens)
        length = joined_token_count(
            F.col("_prompt"), F.col("prompt_length"), response, token_count(response, tokens), tokens
        )
        measured = wrapped.withColumn("text_length", length.cast("long"))
        kept = filter_text_budget(measured, prompt_budget, total_budget).drop("_prompt")
        return build_training_text(kept, kind, data_type)
    if kind == "sft":
        text = build_training_text(source, kind)
        measured = token_lengths(text, {"prompt_length": "prompt", "text_length": "text"}, tokens)
        return filter_text_budget(measured, prompt_budget, total_budget)
    raise ValueError(f"kind must be 'preference' or 'sft', not {kind!r}")
