"""Token measurement and length-budget filters. Stateless: streams are welcome."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.fixed_values import PROMPT_BUDGET, TOTAL_BUDGET
from pairloom.functions.text import Tokenizer, fits_tokens, joined_token_count, token_count


def token_lengths(
    df: DataFrame,
    lengths: Mapping[str, str | tuple[str, str]],
    tokens: Tokenizer | None = None,
) -> DataFrame:
    """Add token counts.

    ``lengths`` maps an output column to a text column, or to a ``(head, tail)`` pair of
    text columns whose concatenation is measured. A part with its own entry is counted
    once and reused.
    """
    singles = {out: source for out, source in lengths.items() if isinstance(source, str)}
    pairs = {out: source for out, source in lengths.items() if not isinstance(source, str)}
    measured = df.withColumns({out: token_count(F.col(c), tokens).cast("long") for out, c in singles.items()})
    known = {source: out for out, source in singles.items()}
    joined = {}
    for out, (head, tail) in pairs.items():
        head_count, tail_count = (
            F.col(known[part]) if part in known else token_count(F.col(part), tokens) for part in (head, tail)
        )
        joined[out] = joined_token_count(F.col(head), head_count, F.col(tail), tail_count, tokens).cast("long")
    return measured.withColumns(joined) if joined else measured


def filter_pair_budget(
    df: DataFrame,
    prompt_budget: int = PROMPT_BUDGET,
    total_budget: int = TOTAL_BUDGET,
    prompt: str = "prompt_length",
    chosen: str = "chosen_response_length",
    rejected: str = "rejected_response_length",
) -> DataFrame:
    """Keep pairs whose prompt and both full texts fit (limits included)."""
    return df.where(
        (F.col(prompt) <= prompt_budget) & (F.col(chosen) <= total_budget) & (F.col(rejected) <= total_budget)
    )


def filter_text_budget(
    df: DataFrame,
    prompt_budget: int = PROMPT_BUDGET,
    total_budget: int = TOTAL_BUDGET,
    prompt: str = "prompt_length",
    text: str = "text_length",
) -> DataFrame:
    """Keep rows whose prompt and full text fit."""
    return df.where((F.col(prompt) <= prompt_budget) & (F.col(text) <= total_budget))


def filter_prompt_budget(
    df: DataFrame, prompt_budget: int = PROMPT_BUDGET, prompt: str = "prompt_length"
) -> DataFrame:
    """Keep rows whose prompt fits. On a stored length this reaches the file scan."""
    return df.where(F.col(prompt) <= prompt_budget)


def filter_token_budget(df: DataFrame, budgets: Mapping[str | tuple[str, str], int], tokens: Tokenizer | None = None) -> DataFrame:
    """Keep rows whose texts all fit, without length columns.

    ``budgets`` maps a text column, or a ``(head, tail)`` pair whose concatenation is meant, to the
    most tokens it may have. A text is read no further than its budget. Null texts do not fit.
    """
    keep = F.lit(True)
    for source, budget in budgets.items():
        text = F.col(source) if isinstance(source, str) else F.concat(*[F.col(c) for c in source])
        keep = keep & (fits_tokens(text, budget) if tokens is None else token_count(text, tokens) <= budget)
    return df.where(keep)
