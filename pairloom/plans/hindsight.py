"""Prepared pairs -> shuffled, encoded, batched hindsight examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.fixed_values import BAD_INSTRUCTION, GOOD_INSTRUCTION, PAD_MULTIPLE, TOTAL_BUDGET
from pairloom.functions.text import Tokenizer
from pairloom.operators.encoding import Limits, encode_hindsight, encode_hindsight_pairs
from pairloom.operators.prompts import hindsight_examples
from pairloom.operators.ranking import assign_batches
from pairloom.sources.staging import staged


def hindsight_batches(
    prepared: DataFrame,
    key: str,
    vocab: DataFrame,
    batch_size: int,
    max_len: int = TOTAL_BUDGET,
    seed: int | str = 42,
    by: str = "order",
    multiple: int = PAD_MULTIPLE,
    good_instruction: str = GOOD_INSTRUCTION,
    bad_instruction: str = BAD_INSTRUCTION,
    tokens: Tokenizer | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Encoded examples with their place in a seeded shuffle and their batch.

    The encoded table is staged: batching then reads ids and lengths only, and the wide
    arrays move once. ``batch_rank`` is the shuffle.
    """
    if tokens is None:
        encoded = encode_hindsight_pairs(prepared, key, vocab, good_instruction, bad_instruction, max_len, (), limits)
    else:  # other tokens may merge where the texts meet
        examples = hindsight_examples(prepared, good_instruction, bad_instruction)
        encoded = encode_hindsight(examples, [key, "type"], vocab, max_len, (), tokens, limits)
    ready = staged(encoded.withColumn("length", F.size("input_ids")), "hindsight_encoded")
    return assign_batches(ready, [key, "type"], "length", batch_size, by, None, seed, multiple)
