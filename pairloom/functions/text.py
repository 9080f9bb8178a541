"""Text expressions. Everything here is a native column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.fixed_values import (
    PROMPT_STYLES,
    TOKEN_BREAKS,
    TOKEN_PATTERN,
    WHITESPACE,
)

# A token with the breaks that follow it.
TOKEN_RUN = f"{TOKEN_PATTERN}[{TOKEN_BREAKS}]*"
PATTERN_TOKENS = 256

Tokenizer = Callable[[Column], Column]
"""A function from a text column to an array-of-strings column."""


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` alone drops spaces only)."""
    return F.trim(text, F.lit(WHITESPACE))


def word_tokens(text: Column) -> Column:
    """Whitespace-separated tokens as an array."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column, tokens: Tokenizer | None = None) -> Column:
    """Number of tokens in ``text``.

    Word tokens are counted without being made: every run of a token and the breaks behind it becomes one letter.
    """
    if tokens is not None:
        return F.size(tokens(text))
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(TOKEN_BREAKS)), TOKEN_RUN, "x"))


def fits_tokens(text: Column, budget: int) -> Column:
    """Whether ``text`` has at most ``budget`` word tokens. Reading stops at the first token beyond it (for
    budgets up to 65,791 tokens; larger ones are counted)."""
    blocks, rest = divmod(budget, PATTERN_TOKENS)
    if blocks > PATTERN_TOKENS:
        return token_count(text) <= budget
    run = TOKEN_RUN.replace("+", "++").replace("*", "*+")
    # The pattern's engine recurses once for each repetition, and comes back at the end of an atomic group.
    whole = f"(?>(?:{run}){{{PATTERN_TOKENS}}}){{{blocks}}}" if blocks else ""
    return ~F.ltrim(text, F.lit(TOKEN_BREAKS)).rlike(f"^{whole}(?:{run}){{{rest}}}[^{TOKEN_BREAKS}]")


def joined_token_count(
    left: Column,
    left_count: Column,
    right: Column,
    right_count: Column,
    tokens: Tokenizer | None = None,
) -> Column:
    """Number of tokens in ``left || right`` from the counts of the two.

    Word tokens add up, less one where the last word of ``left`` runs into the first of
    ``right``; so a prompt is tokenized once although several lengths contain it. A
    plugged-in tokenizer gives no such guarantee and gets the whole concatenation.
    """
    if tokens is not None:
        return token_count(F.concat(left, right), tokens)
    last, first = F.substring(left, -1, 1), F.substring(right, 1, 1)
    touching = (
        (last != "")
        & (first != "")
        & (F.instr(F.lit(TOKEN_BREAKS), last) == 0)
        & (F.instr(F.lit(TOKEN_BREAKS), first) == 0)
    )
    return left_count + right_count - touching.cast("int")


def apply_style(prompt: Column, style: str) -> Column:
    """Wrap a prompt in one of the named dialogue styles."""
    if style not in PROMPT_STYLES:
        raise ValueError(f"unknown prompt style {style!r}; one of {sorted(PROMPT_STYLES)}")
    before, after, stripped = PROMPT_STYLES[style]
    return F.concat(F.lit(before), strip(prompt) if stripped else prompt, F.lit(after))


def mark_turns(text: Column) -> Column:
    """Strip, then close every turn that a human marker follows."""
    closed = F.replace(strip(text), F.lit("\n\nHuman:"), F.lit(" </s>\n\nHuman:"))
    return F.replace(closed, F.lit("\n\nhuman:"), F.lit(" </s>\n\nhuman:"))
