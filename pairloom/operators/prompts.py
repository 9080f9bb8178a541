"""Prompt and response construction.

Every operator is a projection of native expressions over the whole table: no shuffle,
no Python workers, and it applies to streaming DataFrames unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.fixed_values import (
    BAD_INSTRUCTION,
    CONTROL_TEMPLATE,
    EOS_TEXT,
    GOOD_INSTRUCTION,
    NEGATIVE_TYPE,
    ORIGINAL_TYPE,
    POSITIVE_TYPE,
)
from pairloom.functions.hashing import unit_interval
from pairloom.functions.text import apply_style, mark_turns, token_count, Tokenizer


def extract_responses(df: DataFrame, turn: int = 1) -> DataFrame:
    """Add ``chosen_response`` and ``rejected_response``: the message at ``turn`` (0-based).

    A conversation too short to have that message gives null.
    """
    return df.withColumns(
        {f"{side}_response": F.get(F.col(side), F.lit(turn))["content"] for side in ("chosen", "rejected")}
    )


def format_prompts(df: DataFrame, style: str, col: str = "prompt", out: str | None = None) -> DataFrame:
    """Wrap a prompt column in a named dialogue style."""
    return df.withColumn(out or col, apply_style(F.col(col), style))


def append_eos(df: DataFrame, cols: Sequence[str], spaced: bool = True) -> DataFrame:
    """Suffix the end marker, after a space unless ``spaced`` is false."""
    marker = F.lit((" " if spaced else "") + EOS_TEXT)
    return df.withColumns({c: F.concat(F.col(c), marker) for c in cols})


def mark_turn_boundaries(
    df: DataFrame, col: str = "prompt", out: str | None = None, leading: bool = False
) -> DataFrame:
    """Strip a transcript and close each turn before a human marker.

    Stripping comes first, so the first marker gets no end marker; ``leading`` puts the
    two newlines back in front of it.
    """
    marked = mark_turns(F.col(col))
    return df.withColumn(out or col, F.concat(F.lit("\n\n"), marked) if leading else marked)


def preference_side(data_type: str) -> str:
    """``chosen`` or ``rejected``, whichever word the data type contains (chosen first)."""
    for side in ("chosen", "rejected"):
        if side in data_type:
            return side
    raise ValueError(f"data_type must contain 'chosen' or 'rejected', got {data_type!r}")


def select_by_preference(df: DataFrame, data_type: str, out: str = "output", suffix: str = "_response") -> DataFrame:
    """Take the chosen or the rejected response as the output column."""
    return df.withColumn(out, F.col(preference_side(data_type) + suffix))


def preference_branches(df: DataFrame, data_type: str = "all", out: str = "output", suffix: str = "_response") -> DataFrame:
    """One row per selected branch: ``chosen``, ``rejected``, or ``all`` for both.

    Both branches come from one pass over the source. Adds ``branch`` and ``out``.
    """
    sides = ["chosen", "rejected"] if data_type == "all" else [preference_side(data_type)]
    branches = F.array(*[F.struct(F.lit(s).alias("branch"), F.col(s + suffix).alias("output")) for s in sides])
    exploded = df.withColumn("_branch", F.explode(branches))
    return exploded.withColumns({"branch": F.col("_branch")["branch"], out: F.col("_branch")["output"]}).drop("_branch")


TEXT_KINDS = ("sft", "preference", "transcript", "summary")


def build_training_text(
    df: DataFrame, kind: str, data_type: str = "chosen", prompt: str = "prompt", response: str = "response"
) -> DataFrame:
    """Add ``text``, the full training string, for one of four record kinds.

    * ``sft``: marked transcript + response + spaced end marker.
    * ``preference``: dialogue prompt + the selected (already closed) response.
    * ``transcript``: as ``sft`` with leading newlines, response column named by ``data_type``.
    * ``summary``: summary prompt + the selected summary + end marker.
    """
    if kind == "sft":
        text = F.concat(mark_turns(F.col(prompt)), F.col(response), F.lit(f" {EOS_TEXT}"))
    elif kind == "preference":
        text = F.concat(apply_style(F.col(prompt), "dialogue"), F.col(preference_side(data_type) + "_response"))
    elif kind == "transcript":
        text = F.concat(F.lit("\n\n"), mark_turns(F.col(prompt)), F.col(data_type), F.lit(f" {EOS_TEXT}"))
    elif kind == "summary":
        text = F.concat(
            apply_style(F.col("info")["post"], "summary"), _picked_summary(preference_side(data_type)), F.lit(EOS_TEXT)
        )
    else:
        raise ValueError(f"unknown text kind {kind!r}; one of {TEXT_KINDS}")
    return df.withColumn("text", text)


def hindsight_examples(
    df: DataFrame, good_instruction: str = GOOD_INSTRUCTION, bad_instruction: str = BAD_INSTRUCTION
) -> DataFrame:
    """Two rows per pair: the chosen text under the good instruction, the rejected under the bad.

    ``neg_prompt`` is the same prompt under the opposite instruction. Reads its input
    once; ``prompt`` is replaced, and ``chosen``, ``rejected``, ``text``, ``type`` added.
    """
    bare = apply_style(F.col("prompt"), "bare_stripped")

    def variant(side: str, own: str, opposite: str) -> Column:
        return F.struct(
            F.concat(F.lit(own + "\n\n"), bare).alias("prompt"),
            F.col(f"{side}_response").alias("text"),
            F.lit(side).alias("type"),
            F.concat(F.lit(opposite + "\n\n"), bare).alias("neg_prompt"),
        )

    both = F.array(
        variant("chosen", good_instruction, bad_instruction),
        variant("rejected", bad_instruction, good_instruction),
    )
    kept = [c for c in df.columns if c not in {"prompt", "text", "type", "neg_prompt", "chosen", "rejected"}]
    exploded = df.select(*kept, F.explode(both).alias("_example"))
    return exploded.select(
        *kept,
        F.col("chosen_response").alias("chosen"),
        F.col("rejected_response").alias("rejected"),
        "_example.*",
    )


def _picked_summary(side: str) -> Column:
    choice = F.col("choice") if side == "chosen" else 1 - F.col("choice")
    return F.get(F.col("summaries"), choice)["text"]


def summary_preferences(df: DataFrame, data_type: str = "chosen") -> DataFrame:
    """Summary comparison -> ``prompt``, ``chosen`` (the selected summary, closed) and ``text``."""
    picked = F.concat(_picked_summary(preference_side(data_type)), F.lit(EOS_TEXT))
    return df.withColumns({"prompt": apply_style(F.col("info")["post"], "summary"), "chosen": picked}).withColumn(
        "text", F.concat("prompt", "chosen")
    )


VARIANTS = ("orig", "pos", "neg")


def contrast_variants(
    prompt: Column,
    ori_type: str = ORIGINAL_TYPE,
    pos_type: str = POSITIVE_TYPE,
    neg_type: str = NEGATIVE_TYPE,
    control_template: str = CONTROL_TEMPLATE,
) -> dict[str, Column]:
    """The three variants of a prompt. Only the positive one joins with nothing between."""
    return {
        name: F.concat(F.lit(control_template.replace("{type}", kind) + separator), prompt)
        for name, kind, separator in (
            ("orig", ori_type, "\n\n"),
            ("pos", pos_type, ""),
            ("neg", neg_type, "\n\n"),
        )
    }


def contrast_prompts(
    df: DataFrame,
    ori_type: str = ORIGINAL_TYPE,
    pos_type: str = POSITIVE_TYPE,
    neg_type: str = NEGATIVE_TYPE,
    control_template: str = CONTROL_TEMPLATE,
    col: str = "prompt",
) -> DataFrame:
    """Three rows per input row: ``variant`` in orig, pos, neg and its ``col``."""
    variants = contrast_variants(F.col(col), ori_type, pos_type, neg_type, control_template)
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), p.alias("prompt")) for v, p in variants.items()])
    exploded = df.withColumn("_variant", F.explode(rows))
    return exploded.withColumns({"variant": F.col("_variant")["variant"], col: F.col("_variant")["prompt"]}).drop("_variant")


def random_preference_swap(
    df: DataFrame,
    key: str,
    seed: int | str = 42,
    p: float = 0.5,
    tokens: Tokenizer | None = None,
) -> DataFrame:
    """With probability ``p`` put the rejected response in place of the chosen one.

    The draw depends on (seed, key) alone. ``base`` keeps the original chosen response,
    ``random`` the draw. ``prompt_length`` is measured before the prompt is wrapped.
    """
    swapped = (
        df.withColumns(
            {
                "prompt_length": token_count(F.col("prompt"), tokens).cast("long"),
                "base": F.col("chosen_response"),
                "random": unit_interval(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))),
                "chosen_length": token_count(F.col("chosen_response"), tokens).cast("long"),
                "rejected": F.col("rejected_response"),
            }
        )
        .withColumns(
            {
                "prompt": apply_style(F.col("prompt"), "bare"),
                "chosen": F.when(F.col("random") < p, F.col("rejected")).otherwise(F.col("base")),
            }
        )
    )
    return swapped.withColumn("text", F.concat("prompt", "chosen"))


def split_turns(df: DataFrame, col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Transcript -> one row per turn: ``keep``, ``turn``, ``human``, ``assistant``.

    Upper-case markers win when the word occurs at all, as lower-case ones do otherwise.
    Only a literal leading marker is removed. A turn without an assistant marker has a
    null ``assistant``.
    """
    text = F.col(col)
    human = F.when(F.contains(text, F.lit("Human")), "Human").otherwise("human")
    body = F.regexp_replace(text, "^(\n\n)?[Hh]uman: ", "")
    by_case = lambda word, upper, lower: F.when(word == "Human", upper).otherwise(lower)
    turns = by_case(human, F.split(body, "\n\nHuman: "), F.split(body, "\n\nhuman: "))
    exploded = df.select(*keep, F.posexplode(turns).alias("turn", "_turn"))
    turn = F.col("_turn")
    parts = F.when(F.contains(turn, F.lit("Assistant")), F.split(turn, "\n\nAssistant: ")).otherwise(
        F.split(turn, "\n\nassistant: ")
    )
    return exploded.withColumn("_parts", parts).select(
        *keep, "turn", F.get("_parts", F.lit(0)).alias("human"), F.get("_parts", F.lit(1)).alias("assistant")
    )


ENCODED_COLUMNS = ("input_ids", "attention_mask", "labels", "input_ids_neg")
TEXT_COLUMNS = ("text", "prompt", "chosen")


def project_training_columns(df: DataFrame, kind: str = "encoded", keep: Sequence[str] = ()) -> DataFrame:
    """Only the columns a model reads: the ``encoded`` arrays, or the ``text`` columns."""
    columns = {"encoded": ENCODED_COLUMNS, "text": TEXT_COLUMNS}[kind]
    return df.select(*keep, *columns)
