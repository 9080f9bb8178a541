"""What the plans look like: what is scanned, what is shuffled, what meets in one task."""

from __future__ import annotations

import re

import pytest
from conftest import final_plan, main_and_subqueries
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom import plans, sources
from pairloom.operators.encoding import Limits


@pytest.fixture(scope="module")
def pairs_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "pairs")
    spark.range(2000).select(
        F.col("id").alias("pair_id"),
        F.concat(F.lit("ask "), F.col("id").cast("string")).alias("prompt"),
        F.lit("yes of course </s>").alias("chosen_response"),
        F.lit("no </s>").alias("rejected_response"),
        (F.col("id") % 300).alias("prompt_length"),
    ).write.parquet(path)
    return path


def pairs(spark, path):
    return spark.read.parquet(path)


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+)", plan.replace("BroadcastExchange ", "Broadcast "))


def test_hindsight_scans_once(spark, pairs_path):
    plan = final_plan(op.hindsight_examples(pairs(spark, pairs_path)).select("pair_id", "prompt", "text"))
    assert plan.count("FileScan") == 1 and not exchanges(plan)
    assert "prompt_length" not in re.search(r"ReadSchema: (.*)", plan).group(1)


def test_stored_length_filter_reaches_the_scan(spark, pairs_path):
    plan = final_plan(op.filter_prompt_budget(pairs(spark, pairs_path)))
    assert "LessThanOrEqual(prompt_length,256)" in plan


def test_filter_passes_below_the_branch_explode(spark, pairs_path):
    plan = final_plan(op.filter_prompt_budget(op.preference_branches(pairs(spark, pairs_path))))
    assert "LessThanOrEqual(prompt_length,256)" in plan


def test_preparation_is_one_stage(spark, pairs_path):
    messages = pairs(spark, pairs_path).select(
        "pair_id",
        "prompt",
        *[
            F.array(*[F.struct(F.col(c).alias("content"), F.lit("x").alias("role"))] * 2).alias(c.split("_")[0])
            for c in ("chosen_response", "rejected_response")
        ],
    )
    assert not exchanges(final_plan(plans.prepare_pairs(messages)))


def test_split_shuffles_no_row(spark, pairs_path):
    main, cuts = main_and_subqueries(op.random_split(pairs(spark, pairs_path), "pair_id", 42, 100))
    assert "Exchange" not in main and "chosen_response:string" in main
    # Reading for the cuts touches the key column alone.
    scans = re.findall(r"ReadSchema: struct<([^>\n]*)", cuts)
    assert scans and set(scans) == {"pair_id:bigint"}


def test_head_shuffles_no_row(spark, pairs_path):
    main, cut = main_and_subqueries(op.head_examples(pairs(spark, pairs_path), 10, "pair_id"))
    assert "Exchange" not in main and "TakeOrderedAndProject" in cut
    assert set(re.findall(r"ReadSchema: struct<([^>\n]*)", cut)) == {"pair_id:bigint"}


def test_rank_puts_no_row_in_one_task(spark, pairs_path):
    plan = final_plan(op.exact_rank(pairs(spark, pairs_path), "pair_id"))
    for single in re.findall(r"Exchange SinglePartition.*?\n.*", plan):
        assert "Aggregate" in single or "_rows" in single or "Query" in single
    assert plan.count("chosen_response:string") == 1


def test_vocab_counts_its_text_once(spark, pairs_path):
    plan = final_plan(op.build_vocab(pairs(spark, pairs_path), ["prompt", "chosen_response"]))
    assert plan.count("ReusedExchange") >= 1
    assert plan.count("FileScan") == 1


def test_encoding_shuffles_once(spark, pairs_path):
    df = pairs(spark, pairs_path)
    table = sources.staged(op.build_vocab(df, ["prompt", "chosen_response"]), "plan_vocab")
    examples = op.hindsight_examples(df, "g", "b")
    plan = final_plan(op.encode_hindsight(examples, ["pair_id", "type"], table, 16))
    assert exchanges(plan) == ["hashpartitioning"]
    # Input already partitioned by the key is regrouped where it is.
    placed = op.encode(df.repartition(4, "pair_id"), "pair_id", "prompt", table, 16)
    assert exchanges(final_plan(placed)) == ["hashpartitioning"]


def test_large_vocab_is_not_broadcast_whole(spark, pairs_path, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    df = pairs(spark, pairs_path)
    table = sources.staged(op.build_vocab(df, ["prompt"]), "plan_vocab")
    limits = Limits(broadcast_rows=100, head_rows=50)
    encoded = op.encode(df, "pair_id", "prompt", table, 16, limits=limits)
    assert "SortMergeJoin" in final_plan(encoded)
    # The texts were read once, for the head; what is left are places and tokens.
    assert {re.search(r"(head_ids|plan_vocab)-", f)[1] for f in encoded.inputFiles()} == {"head_ids", "plan_vocab"}


def test_hot_token_is_split_in_the_shuffled_join(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    # Half of all tokens are one that the vocabulary lacks.
    df = spark.range(20000).select(
        F.col("id").alias("k"), F.concat(F.lit("zz w"), (F.col("id") % 500).cast("string")).alias("text")
    ).repartition(8)
    table = sources.staged(
        spark.range(500).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"), (F.col("id") + 3).alias("id")),
        "skew_vocab",
    )
    encoded = op.encode(df, "k", "text", table, 9, False, limits=Limits(broadcast_rows=10, head_rows=5))
    plan = final_plan(encoded)
    assert "skew=true" in plan
    wrong = encoded.where(
        (F.size("input_ids") != 2) | (F.get("input_ids", F.lit(0)) != 0) | (F.get("input_ids", F.lit(1)) != F.col("k") % 500 + 3)
    )
    assert wrong.count() == 0 and encoded.count() == 20000


def test_steering_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "acts")
    spark.range(40).select(
        F.col("id").alias("example_id"),
        (F.col("id") % 20).cast("int").alias("layer"),
        F.lit(0).alias("pos"),
        F.lit("base").alias("variant"),
        F.lit(1).alias("mask"),
        F.array(F.lit(1.0).cast("float")).alias("vec"),
    ).write.parquet(path)
    plan = final_plan(op.steering_targets(spark.read.parquet(path), layers=(10, 12)))
    pushed = re.search(r"PushedFilters: \[(.*?)\]\s*,? *ReadSchema", plan).group(1)
    assert "In(layer, [10,12])" in pushed and "In(variant, [base,neg,pos])" in pushed


def test_scores_combine_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "logits")
    spark.range(1000).select(
        F.floor(F.col("id") / 50).alias("id"),
        F.lit(0).alias("pos"),
        (F.col("id") % 50).cast("int").alias("token"),
        F.rand(1).alias("logit"),
        F.lit(3).alias("target"),
    ).write.parquet(path)
    plan = final_plan(op.logprob_from_logits(spark.read.parquet(path)))
    assert "partial_sum" in plan and "Window" not in plan and "Join" not in plan


def test_scores_are_neither_listed_nor_sorted(spark, tmp_path):
    path = str(tmp_path / "logits")
    rows = spark.range(1000).select(F.floor(F.col("id") / 50).alias("id"), F.lit(0).alias("pos"), (F.col("id") % 50).cast("int").alias("token"))
    rows.select("*", (F.col("token") * 100.0).alias("logit"), F.lit(3).alias("target")).write.parquet(path)
    plan = final_plan(op.logprob_from_logits(spark.read.parquet(path)))
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "Sort" not in plan
