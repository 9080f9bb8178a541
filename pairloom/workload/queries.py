"""Registered queries: one per operator, and one per end-to-end job.

Each reads whole tables. Arrays are joined into text and floats rounded to six places,
so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom import plans, sources
from pairloom.functions.arrays import as_text
from pairloom.functions.fixed_values import PROMPT_BUDGET, PROMPT_STYLES, TOTAL_BUDGET
from pairloom.functions.hashing import unit_interval
from pairloom.functions.text import apply_style
from pairloom.sources import derived as inputs
from pairloom.sources.schemas import COMPLETION_RECORDS

Query = Callable[[SparkSession, str], DataFrame]

# Conversation replies are short, so their budgets are as well.
PAIR_PROMPT_BUDGET, PAIR_TOTAL_BUDGET = 48, 192
SPLIT_TEST_ROWS = 10
ENCODE_LENGTH = 96
CONTRAST_PROMPT_LENGTH, CONTRAST_RESPONSE_LENGTH = 32, 64
BATCH_SIZE = 8
ARRAY_FILES = 4
VOCAB_SIZE = 2_000
ACTIVATION_BUCKETS = 8


def _rounded(value: str | Column) -> Column:
    return F.round(value, 6)


def _arrays_as_text(df: DataFrame) -> DataFrame:
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return df.withColumns({c: as_text(F.col(c)) for c in arrays})


# --- sources and sinks -------------------------------------------------------------


def read_examples_parquet(spark, sf_dir):
    return sources.read_examples(spark, f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")


def read_examples_json(spark, sf_dir):
    path = sources.staging_path(spark, "pairs") + ".jsonl"
    pairs = inputs.pairs(spark, sf_dir)
    pairs.write.json(path)
    read = sources.read_examples(spark, path, pairs.schema)
    return op.extract_responses(read).select("pair_id", "prompt", "chosen_response", "rejected_response")


def read_examples_json_array(spark, sf_dir):
    """The pairs as a few JSON arrays."""
    path = sources.staging_path(spark, "pairs") + ".json"
    pairs = inputs.pairs(spark, sf_dir)
    # Records on lines become an array as text: the first line of a file opens it, the last closes it.
    record = F.to_json(F.struct(*pairs.columns), {"ignoreNullFields": "false"}).alias("record")
    order = Window.partitionBy("bin").orderBy("pair_id")
    lines = pairs.select("pair_id", (F.pmod("pair_id", F.lit(ARRAY_FILES))).alias("bin"), record)
    opens = F.when(F.lag("pair_id").over(order).isNull(), "[").otherwise(",")
    closes = F.when(F.lead("pair_id").over(order).isNull(), "]").otherwise("")
    texts = lines.select("bin", "pair_id", F.concat(opens, "record", closes).alias("value"))
    texts.repartition("bin").sortWithinPartitions("bin", "pair_id").select("value", "bin").write.partitionBy("bin").text(path)
    read = sources.read_examples(spark, path, pairs.schema)
    return op.extract_responses(read).select("pair_id", "prompt", "chosen_response", "rejected_response")


def read_examples_saved(spark, sf_dir):
    path = sources.staging_path(spark, "saved")
    pairs = inputs.pairs(spark, sf_dir)
    sources.write_saved(pairs, path)
    read = sources.read_examples(spark, path, pairs.schema)
    return op.extract_responses(read).select("pair_id", "prompt", "chosen_response", "rejected_response")


def read_split_saved(spark, sf_dir):
    path = sources.staging_path(spark, "saved_splits")
    labelled = op.random_split(inputs.pair_responses(spark, sf_dir), "pair_id", test=SPLIT_TEST_ROWS)
    sources.write_saved_splits(sources.staged(labelled, "labelled"), path)
    return sources.read_split(spark, path, "ppo").select("pair_id", "prompt")


def write_sized_splits(spark, sf_dir):
    """What the writing tasks counted, as ``split_manifest`` counts it in a pass of its own."""
    path = sources.staging_path(spark, "sized_splits")
    labelled = op.random_split(inputs.pair_responses(spark, sf_dir), "pair_id", test=SPLIT_TEST_ROWS)
    manifest = sources.write_sized_splits(labelled, path, ["prompt", "chosen_response", "rejected_response"])
    rows = [(name, m["num_examples"], m["num_bytes"]) for name, m in manifest.items()]
    return spark.createDataFrame(rows, "split string, num_examples long, num_bytes long")


def read_split_sized(spark, sf_dir):
    path = sources.staging_path(spark, "sized_splits")
    labelled = op.random_split(inputs.pair_responses(spark, sf_dir), "pair_id", test=SPLIT_TEST_ROWS)
    sources.write_sized_splits(labelled, path, ["prompt"])
    return sources.read_split(spark, path, "ppo").select("pair_id", "prompt")


def _saved_splits(spark, sf_dir) -> str:
    path = sources.staging_path(spark, "splits")
    labelled = op.random_split(inputs.pair_responses(spark, sf_dir), "pair_id", test=SPLIT_TEST_ROWS)
    sources.write_splits(labelled, path)
    return path


def write_splits(spark, sf_dir):
    return spark.read.parquet(_saved_splits(spark, sf_dir)).select("pair_id", "prompt", "chosen_response", "split")


def read_split(spark, sf_dir):
    return sources.read_split(spark, _saved_splits(spark, sf_dir), "ppo").select("pair_id", "prompt")


def write_completions(spark, sf_dir):
    path = sources.staging_path(spark, "completions") + ".json"
    plans.export_completions(inputs.instructions(spark, sf_dir), inputs.completions(spark, sf_dir), "model-a", path)
    return sources.read_examples(spark, path, COMPLETION_RECORDS)


def split_manifest(spark, sf_dir):
    labelled = op.random_split(inputs.pair_responses(spark, sf_dir), "pair_id", test=SPLIT_TEST_ROWS)
    return sources.split_manifest(labelled, ["prompt", "chosen_response", "rejected_response"])


# --- prompts and responses ---------------------------------------------------------


def extract_responses(spark, sf_dir):
    return op.extract_responses(inputs.pairs(spark, sf_dir)).select("pair_id", "chosen_response", "rejected_response")


def format_prompts(spark, sf_dir):
    base = inputs.pairs(spark, sf_dir)
    return base.select("pair_id", *[apply_style(F.col("prompt"), s).alias(s) for s in PROMPT_STYLES])


def append_eos(spark, sf_dir):
    base = inputs.transcript_pairs(spark, sf_dir)
    spaced = op.append_eos(base, ["chosen"])
    return op.append_eos(spaced, ["rejected"], spaced=False).select("pair_id", "chosen", "rejected")


def mark_turn_boundaries(spark, sf_dir):
    base = inputs.transcripts(spark, sf_dir)
    marked = op.mark_turn_boundaries(base, out="marked")
    return op.mark_turn_boundaries(marked, out="marked_leading", leading=True).select(
        "conv_id", "marked", "marked_leading"
    )


def training_text_sft(spark, sf_dir):
    return op.build_training_text(inputs.transcripts(spark, sf_dir), "sft").select("conv_id", "text")


def training_text_preference(spark, sf_dir):
    return op.build_training_text(inputs.pair_responses(spark, sf_dir), "preference", "rejected").select("pair_id", "text")


def training_text_transcript(spark, sf_dir):
    return op.build_training_text(inputs.transcript_pairs(spark, sf_dir), "transcript", "rejected").select(
        "pair_id", "text"
    )


def training_text_summary(spark, sf_dir):
    return op.build_training_text(inputs.summaries(spark, sf_dir), "summary", "rejected").select("doc_id", "text")


def select_by_preference(spark, sf_dir):
    base = inputs.pair_responses(spark, sf_dir)
    chosen = op.select_by_preference(base, "chosen", "from_chosen")
    return op.select_by_preference(chosen, "only_rejected", "from_rejected").select(
        "pair_id", "from_chosen", "from_rejected"
    )


def hindsight_examples(spark, sf_dir):
    return op.hindsight_examples(inputs.pair_responses(spark, sf_dir)).select(
        "pair_id", "type", "prompt", "neg_prompt", "text"
    )


def summary_preferences(spark, sf_dir):
    base = inputs.summaries(spark, sf_dir)
    rejected = op.summary_preferences(base, "rejected").withColumnRenamed("chosen", "rejected").drop("text")
    return op.summary_preferences(rejected, "chosen").select("doc_id", "prompt", "chosen", "rejected", "text")


def contrast_prompts(spark, sf_dir):
    wrapped = op.format_prompts(inputs.pair_responses(spark, sf_dir), "dialogue")
    return op.contrast_prompts(wrapped).select("pair_id", "variant", "prompt")


def random_preference_swap(spark, sf_dir):
    swapped = op.random_preference_swap(inputs.pair_responses(spark, sf_dir), "pair_id", 42)
    return swapped.select("pair_id", "prompt_length", "prompt", "base", "chosen", _rounded("random").alias("random"))


def split_turns(spark, sf_dir):
    whole = inputs.transcripts(spark, sf_dir).withColumn("text", F.concat("prompt", "response"))
    return op.split_turns(whole, "text", ["conv_id"])


def clean_completions(spark, sf_dir):
    requests = op.completion_requests(inputs.instructions(spark, sf_dir))
    return op.clean_completions(requests, inputs.completions(spark, sf_dir), "model-a")


def project_training_columns(spark, sf_dir):
    swapped = op.random_preference_swap(inputs.pair_responses(spark, sf_dir), "pair_id", 42)
    return op.project_training_columns(swapped, "text", ["pair_id"])


# --- lengths and filters -----------------------------------------------------------

_DOC_LENGTHS = {
    "prompt_length": "prompt",
    "chosen_response_length": ("prompt", "chosen_response"),
    "rejected_response_length": ("prompt", "rejected_response"),
}


def token_lengths(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    lengths = {"tokens": "text", "with_lang": ("lang", "text"), "twice": ("text", "text")}
    return op.token_lengths(sources.spread(documents, "doc_id"), lengths).drop("text", "lang")


def filter_pair_budget(spark, sf_dir):
    measured = op.token_lengths(inputs.doc_pairs(spark, sf_dir), _DOC_LENGTHS)
    return op.filter_pair_budget(measured).select("pair_id", *_DOC_LENGTHS)


def filter_text_budget(spark, sf_dir):
    measured = op.token_lengths(
        inputs.doc_pairs(spark, sf_dir), {"prompt_length": "prompt", "text_length": ("prompt", "chosen_response")}
    )
    return op.filter_text_budget(measured).select("pair_id", "prompt_length", "text_length")


def filter_prompt_budget(spark, sf_dir):
    measured = op.token_lengths(inputs.transcripts(spark, sf_dir), {"prompt_length": "prompt"})
    return op.filter_prompt_budget(measured).select("conv_id", "prompt_length")


def filter_token_budget(spark, sf_dir):
    """The pairs within the budgets, without any length."""
    budgets = {"prompt": PROMPT_BUDGET, ("prompt", "chosen_response"): TOTAL_BUDGET, ("prompt", "rejected_response"): TOTAL_BUDGET}
    return op.filter_token_budget(inputs.doc_pairs(spark, sf_dir), budgets).select("pair_id", "prompt")


# --- vocabulary and encoding -------------------------------------------------------


def build_vocab(spark, sf_dir):
    return op.build_vocab(inputs.documents(spark, sf_dir), ["text"])


def build_vocab_sized(spark, sf_dir):
    return op.build_vocab(inputs.documents(spark, sf_dir), ["text"], size=VOCAB_SIZE)


def encode(spark, sf_dir):
    return _arrays_as_text(
        op.encode(inputs.pair_text(spark, sf_dir), "pair_id", "text", inputs.pair_vocab(spark, sf_dir), ENCODE_LENGTH)
    )


def encode_documents(spark, sf_dir):
    vocab = inputs.document_vocab(spark, sf_dir)
    encoded = op.encode(inputs.documents(spark, sf_dir), "doc_id", "text", vocab)
    return encoded.select("doc_id", as_text(F.col("input_ids")).alias("input_ids"))


def encode_large_vocab(spark, sf_dir):
    """``encode_documents`` the way a vocabulary too large to be sent whole is looked up."""
    limits = op.Limits(broadcast_rows=1_000, head_rows=500)
    docs, vocab = inputs.documents(spark, sf_dir), inputs.document_vocab(spark, sf_dir)
    return op.encode(docs, "doc_id", "text", vocab, 768, limits=limits).select("doc_id", as_text(F.col("input_ids")).alias("input_ids"))


def mask_prompt_labels(spark, sf_dir):
    text = op.token_lengths(inputs.pair_text(spark, sf_dir), {"prompt_length": "prompt"})
    encoded = op.encode(text, "pair_id", "text", inputs.pair_vocab(spark, sf_dir), 40, keep=["prompt_length"])
    return op.mask_prompt_labels(encoded).select("pair_id", as_text(F.col("labels")).alias("labels"))


def encode_counter_condition(spark, sf_dir):
    examples = op.hindsight_examples(inputs.pair_responses(spark, sf_dir), "good", "bad")
    encoded = op.encode_counter_condition(examples, ["pair_id", "type"], inputs.pair_vocab(spark, sf_dir), ENCODE_LENGTH)
    return _arrays_as_text(encoded)


def project_training_columns_encoded(spark, sf_dir):
    examples = op.hindsight_examples(inputs.pair_responses(spark, sf_dir), "good", "bad")
    encoded = op.encode_hindsight(examples, ["pair_id", "type"], inputs.pair_vocab(spark, sf_dir), ENCODE_LENGTH)
    return _arrays_as_text(op.project_training_columns(encoded, "encoded", ["pair_id", "type"]))


def _contrast_input(spark, sf_dir) -> DataFrame:
    return op.format_prompts(inputs.pair_responses(spark, sf_dir), "dialogue")


def encode_contrast(spark, sf_dir):
    return _arrays_as_text(
        op.encode_contrast(
            _contrast_input(spark, sf_dir),
            "pair_id",
            inputs.pair_vocab(spark, sf_dir),
            response="rejected_response",
            prompt_len=CONTRAST_PROMPT_LENGTH,
            max_res_len=CONTRAST_RESPONSE_LENGTH,
        )
    )


def _single_contrast(spark, sf_dir) -> DataFrame:
    return op.encode_contrast(
        _contrast_input(spark, sf_dir),
        "pair_id",
        inputs.pair_vocab(spark, sf_dir),
        response="chosen_response",
        variants=False,
        prompt_len=CONTRAST_PROMPT_LENGTH,
        max_res_len=CONTRAST_RESPONSE_LENGTH,
    )


def encode_contrast_single(spark, sf_dir):
    return _arrays_as_text(_single_contrast(spark, sf_dir))


def position_ids(spark, sf_dir):
    return op.position_ids(_single_contrast(spark, sf_dir)).select(
        "pair_id", as_text(F.col("position_ids")).alias("position_ids")
    )


def encode_qa_batch(spark, sf_dir):
    asked = op.format_prompts(inputs.pair_responses(spark, sf_dir), "bare_tight").withColumn(
        "batch_id", F.col("pair_id") % 10
    )
    encoded = op.encode_qa_batch(
        asked, "pair_id", "batch_id", inputs.pair_vocab(spark, sf_dir), prompt="prompt", target="chosen_response"
    )
    return _arrays_as_text(encoded)


def decode(spark, sf_dir):
    vocab = inputs.pair_vocab(spark, sf_dir)
    rejected = inputs.pair_responses(spark, sf_dir)
    encoded = op.encode(rejected, "pair_id", "rejected_response", vocab, ENCODE_LENGTH)
    return op.decode(encoded, "pair_id", "input_ids", vocab)


def decode_large_vocab(spark, sf_dir):
    """``decode`` the way a vocabulary too large to be sent whole is looked up."""
    limits = op.Limits(broadcast_rows=100, head_rows=50)
    vocab = inputs.pair_vocab(spark, sf_dir)
    encoded = op.encode(inputs.pair_responses(spark, sf_dir), "pair_id", "rejected_response", vocab, ENCODE_LENGTH)
    return op.decode(encoded, "pair_id", "input_ids", vocab, limits=limits)


# --- order, splits, batches --------------------------------------------------------


def exact_rank(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    ranked = op.exact_rank(documents, "doc_id", 42)
    return op.exact_rank(ranked, "doc_id", 42, by=-F.col("n_chars"), out="size_rank")


def exact_rank_within(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    ranked = op.exact_rank(documents, "doc_id", 42, within="lang", total="n")
    return op.exact_rank(ranked, "doc_id", 42, by=F.col("n_chars"), within="lang", out="size_rank")


def random_split(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return op.random_split(documents, "doc_id", 42, 100)


def concat_examples(spark, sf_dir):
    base = inputs.pair_responses(spark, sf_dir)
    sides = [
        op.select_by_preference(base, side).select("pair_id", F.lit(side).alias("branch"), "output")
        for side in ("chosen", "rejected")
    ]
    return op.concat_examples(*sides)


def preference_branches(spark, sf_dir):
    return op.preference_branches(inputs.pair_responses(spark, sf_dir)).select("pair_id", "branch", "output")


def seeded_shuffle(spark, sf_dir):
    return op.seeded_shuffle(inputs.pair_responses(spark, sf_dir), "pair_id", 42).select(
        "pair_id", "prompt", "shuffle_rank"
    )


def head_examples(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return op.head_examples(documents, 150, "doc_id")


def assign_batches_by_length(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "source")
    return op.assign_batches(documents, "doc_id", "n_chars", BATCH_SIZE, by="length")


def assign_batches_by_order(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "source")
    return op.assign_batches(documents, "doc_id", "n_chars", BATCH_SIZE, by="order")


def assign_batches_grouped(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "source")
    return op.assign_batches(documents, "doc_id", "n_chars", BATCH_SIZE, by="grouped")


def batch_padding(spark, sf_dir):
    """Batches, examples and padding of the three ways to make batches."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    parts = [
        op.plan_batches(documents, "doc_id", "n_chars", BATCH_SIZE, by=by)
        .agg(F.count_distinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("examples"), F.sum("pad_waste").alias("padding"))
        .select(F.lit(by).alias("by"), "batches", "examples", "padding")
        for by in ("order", "length", "grouped")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- scores ------------------------------------------------------------------------


def explode_mc1(spark, sf_dir):
    return op.explode_mc1(inputs.mc1(spark, sf_dir))


def explode_keyed_choices(spark, sf_dir):
    return op.explode_keyed_choices(inputs.keyed_choices(spark, sf_dir))


def sequence_logprob(spark, sf_dir):
    scores = op.sequence_logprob(inputs.token_scores(spark, sf_dir))
    return scores.withColumn("logprob", _rounded("logprob"))


def logprob_from_logits(spark, sf_dir):
    return op.logprob_from_logits(inputs.logits(spark, sf_dir)).withColumn("logprob", _rounded("logprob"))


def logprob_from_arrays(spark, sf_dir):
    scored = op.logprob_from_arrays(inputs.logit_arrays(spark, sf_dir))
    return scored.select("id", "pos", _rounded("logprob").alias("logprob"))


def logprob_from_tensor(spark, sf_dir):
    """A row per answer: logits by position and class, and labels, of which the logits before are for."""
    whole = inputs.logit_tensors(spark, sf_dir)
    return op.logprob_from_tensor(whole).select("id", "pos", _rounded("logprob").alias("logprob"))


def nan_report(spark, sf_dir):
    drawn = unit_interval(F.concat(F.lit("nan:"), F.col("q").cast("string"), F.lit(":"), F.col("pos").cast("string")))
    scores = inputs.token_scores(spark, sf_dir).withColumn(
        "spoiled", F.when(drawn < 0.01, F.lit(float("nan"))).otherwise(F.col("logprob"))
    )
    return op.nan_report(scores, ["logprob", "spoiled"])


def assert_no_nan(spark, sf_dir):
    checked = op.assert_no_nan(inputs.token_scores(spark, sf_dir), ["logprob"])
    return checked.select("q", "choice", "pos", _rounded("logprob").alias("logprob"))


def score_questions(spark, sf_dir):
    choices = op.explode_mc1(inputs.mc1(spark, sf_dir))
    return op.score_questions(choices, op.sequence_logprob(inputs.token_scores(spark, sf_dir)))


def mc_accuracy(spark, sf_dir):
    choices = op.explode_mc1(inputs.mc1(spark, sf_dir))
    accuracy = op.mc_accuracy(choices, op.sequence_logprob(inputs.token_scores(spark, sf_dir)))
    return accuracy.withColumns({c: _rounded(c) for c in ("acc", "acc_norm")})


def eval_report(spark, sf_dir):
    scores = inputs.token_scores(spark, sf_dir)
    report = plans.evaluate_sets(
        {
            "tqa": (op.explode_mc1(inputs.mc1(spark, sf_dir)), scores),
            "arc-e": (op.explode_keyed_choices(inputs.keyed_choices(spark, sf_dir)), scores),
        }
    )
    return report.withColumn("value", _rounded("value"))


def contrastive_preference(spark, sf_dir):
    scored = op.contrastive_preference(inputs.token_loss(spark, sf_dir))
    return scored.select("id", *[_rounded(c).alias(c) for c in ("pos_lp", "neg_lp", "score")])


def contrastive_loss(spark, sf_dir):
    return op.contrastive_loss(inputs.token_loss(spark, sf_dir)).withColumn("score", _rounded("score"))


def steering_targets(spark, sf_dir):
    targets = op.steering_targets(inputs.activations(spark, sf_dir), layers=(10, 12, 14))
    at = [F.get("target", F.lit(i)) for i in (0, 31, 63)]
    total = F.aggregate("target", F.lit(0.0), lambda a, b: a + b)
    return targets.select(
        "example_id", "layer", "pos", "mask",
        *[_rounded(a).alias(f"target_{i}") for a, i in zip(at, (0, 31, 63))],
        _rounded(total).alias("target_sum"),
    )


def alignment_distance(spark, sf_dir):
    acts = inputs.activations(spark, sf_dir)
    return op.alignment_distance(acts, op.steering_targets(acts)).withColumn("distance", _rounded("distance"))


def alignment_distance_by_layer(spark, sf_dir):
    acts = inputs.activations(spark, sf_dir)
    by_layer = op.alignment_distance(acts, op.steering_targets(acts), by=["layer"])
    return by_layer.withColumn("distance", _rounded("distance"))


def _placed_activations(spark, sf_dir):
    # A table of its own for each run; it lies in the session's warehouse.
    return op.write_placed(inputs.activations(spark, sf_dir), f"activations_{uuid.uuid4().hex}", ACTIVATION_BUCKETS)


def steering_targets_placed(spark, sf_dir):
    targets = op.steering_targets(_placed_activations(spark, sf_dir), layers=(10, 12, 14), placed=True)
    at = [F.get("target", F.lit(i)) for i in (0, 31, 63)]
    total = F.aggregate("target", F.lit(0.0), lambda a, b: a + b)
    return targets.select(
        "example_id", "layer", "pos", "mask",
        *[_rounded(a).alias(f"target_{i}") for a, i in zip(at, (0, 31, 63))],
        _rounded(total).alias("target_sum"),
    )


def steered_distance_by_layer(spark, sf_dir):
    by_layer = op.steered_distance(_placed_activations(spark, sf_dir), by=["layer"], placed=True)
    return by_layer.withColumn("distance", _rounded("distance"))


# --- end to end --------------------------------------------------------------------


def preparation_manifest(spark, sf_dir):
    return plans.preparation_manifest(
        inputs.pairs(spark, sf_dir), "pair_id", PAIR_PROMPT_BUDGET, PAIR_TOTAL_BUDGET, test=SPLIT_TEST_ROWS
    )


def document_preparation(spark, sf_dir):
    """The full-size budgets, over documents: rows and bytes that survive, by split."""
    measured = op.token_lengths(op.format_prompts(inputs.doc_pairs(spark, sf_dir), "dialogue"), _DOC_LENGTHS)
    labelled = plans.split_pairs(op.filter_pair_budget(measured), "pair_id", 42, SPLIT_TEST_ROWS)
    return sources.split_manifest(labelled, ["prompt", "chosen_response", "rejected_response"])


def hindsight_batches(spark, sf_dir):
    batches = plans.hindsight_batches(
        inputs.pair_responses(spark, sf_dir), "pair_id", inputs.pair_vocab(spark, sf_dir), BATCH_SIZE, max_len=192
    )
    return _arrays_as_text(batches)


def pad_batches(spark, sf_dir):
    batches = plans.hindsight_batches(
        inputs.pair_responses(spark, sf_dir), "pair_id", inputs.pair_vocab(spark, sf_dir), BATCH_SIZE, max_len=192
    )
    return _arrays_as_text(op.pad_batches(batches).drop("length", "batch_rank", "pad_waste"))


def alignment_rows(spark, sf_dir):
    rows = plans.alignment_rows(
        inputs.pair_responses(spark, sf_dir), "pair_id", inputs.pair_vocab(spark, sf_dir), "all",
        PAIR_PROMPT_BUDGET, CONTRAST_RESPONSE_LENGTH,
    )
    return _arrays_as_text(rows)


def alignment_rows_random(spark, sf_dir):
    rows = plans.alignment_rows(
        inputs.pair_responses(spark, sf_dir), "pair_id", inputs.pair_vocab(spark, sf_dir), "random",
        PAIR_PROMPT_BUDGET, CONTRAST_RESPONSE_LENGTH,
    )
    return _arrays_as_text(rows)


def alignment_rows_transcript(spark, sf_dir):
    rows = plans.alignment_rows(
        inputs.transcript_pairs(spark, sf_dir), "pair_id", inputs.pair_vocab(spark, sf_dir), "all",
        PAIR_PROMPT_BUDGET, CONTRAST_RESPONSE_LENGTH, kind="transcript",
    )
    return _arrays_as_text(rows)


def alignment_rows_summary(spark, sf_dir):
    vocab = inputs.document_vocab(spark, sf_dir)
    rows = plans.alignment_rows(
        inputs.summaries(spark, sf_dir), "doc_id", vocab, "rejected", max_res_len=CONTRAST_RESPONSE_LENGTH, kind="summary"
    )
    return _arrays_as_text(rows)


def supervised_texts_preference(spark, sf_dir):
    texts = plans.supervised_texts(inputs.doc_pairs(spark, sf_dir), "preference", "rejected")
    return texts.select("pair_id", "prompt_length", "text_length", "text")


def supervised_texts_transcript(spark, sf_dir):
    texts = plans.supervised_texts(inputs.transcripts(spark, sf_dir), "sft")
    return texts.select("conv_id", "prompt_length", "text_length", "text")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        read_examples_parquet, read_examples_json, read_examples_json_array, read_examples_saved, read_split, read_split_saved,
        read_split_sized, write_splits, write_sized_splits, write_completions, split_manifest,
        extract_responses, format_prompts, append_eos, mark_turn_boundaries,
        training_text_sft, training_text_preference, training_text_transcript, training_text_summary,
        select_by_preference, hindsight_examples, summary_preferences, contrast_prompts, random_preference_swap,
        split_turns, clean_completions, project_training_columns,
        token_lengths, filter_pair_budget, filter_text_budget, filter_prompt_budget, filter_token_budget,
        build_vocab, build_vocab_sized, encode, encode_documents, encode_large_vocab, mask_prompt_labels, encode_counter_condition,
        project_training_columns_encoded,
        encode_contrast, encode_contrast_single, position_ids, encode_qa_batch, decode, decode_large_vocab,
        exact_rank, exact_rank_within, random_split, concat_examples, preference_branches, seeded_shuffle,
        head_examples, assign_batches_by_length, assign_batches_by_order, assign_batches_grouped, batch_padding,
        explode_mc1, explode_keyed_choices, sequence_logprob, logprob_from_logits, logprob_from_arrays, logprob_from_tensor, nan_report, assert_no_nan,
        score_questions, mc_accuracy, eval_report, contrastive_preference, contrastive_loss,
        steering_targets, alignment_distance, alignment_distance_by_layer, steering_targets_placed, steered_distance_by_layer,
        preparation_manifest, document_preparation, hindsight_batches, pad_batches, alignment_rows, alignment_rows_random,
        alignment_rows_transcript, alignment_rows_summary, supervised_texts_preference, supervised_texts_transcript,
    )
}
