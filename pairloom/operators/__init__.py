"""Operators: every function takes and returns DataFrames."""

from pairloom.operators.activations import activation_distances, alignment_distance, steered_distance, steering_targets, write_placed
from pairloom.operators.choices import (
    assert_no_nan,
    eval_report,
    explode_keyed_choices,
    explode_mc1,
    array_logprob,
    logprob_from_arrays,
    logprob_from_logits,
    logprob_from_tensor,
    mc_accuracy,
    nan_report,
    score_questions,
    sequence_logprob,
)
from pairloom.operators.completions import clean_completions, completion_requests
from pairloom.operators.encoding import (
    Limits,
    build_vocab,
    decode,
    encode,
    encode_contrast,
    encode_counter_condition,
    encode_hindsight,
    encode_hindsight_pairs,
    pad_batches,
    encode_qa_batch,
    encode_texts,
    mask_prompt_labels,
    position_ids,
)
from pairloom.operators.lengths import (
    filter_pair_budget,
    filter_prompt_budget,
    filter_text_budget,
    filter_token_budget,
    token_lengths,
)
from pairloom.operators.preference import contrastive_loss, contrastive_preference
from pairloom.operators.prompts import (
    append_eos,
    build_training_text,
    contrast_prompts,
    extract_responses,
    format_prompts,
    hindsight_examples,
    mark_turn_boundaries,
    preference_branches,
    project_training_columns,
    random_preference_swap,
    select_by_preference,
    split_turns,
    summary_preferences,
)
from pairloom.operators.ranking import (
    assign_batches,
    concat_examples,
    exact_rank,
    head_examples,
    plan_batches,
    random_split,
    seeded_shuffle,
)

__all__ = [name for name in dir() if not name.startswith("_")]
