"""Derived inputs on tables with one giant conversation and one giant language."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pairloom.sources import derived


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    turn = F.col("id") % 2500
    conversations = spark.range(4000).select(
        F.when(F.col("id") < 2500, 0).otherwise(F.floor(F.col("id") / 5)).alias("conv_id"),
        F.when(F.col("id") < 2500, turn).otherwise(F.col("id") % 5).alias("turn"),
    )
    conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("text"),
    ).write.parquet(f"{folder}/conversations.parquet")
    documents = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 10 != 0, "en").otherwise("fr").alias("lang"),
    )
    documents.write.parquet(f"{folder}/documents.parquet")
    # One bad English document for all the good ones.
    documents.select("doc_id", F.when(F.col("doc_id").isin(1, 10, 20), 0).otherwise(1).alias("quality")).write.parquet(
        f"{folder}/labels.parquet"
    )
    return str(folder)


def test_pairs_of_a_giant_conversation(spark, skewed_dir):
    base = derived.pair_base(spark, skewed_dir)
    rows = base.collect()
    assert len(rows) == 1250 + 300 * 2 == rows[0]["n"]
    assert sorted(r["rk"] for r in rows) == list(range(len(rows)))
    assert len({r["pair_id"] for r in rows}) == len(rows)
    assert derived.pairs(spark, skewed_dir).count() == len(rows)


def test_transcripts_hold_every_turn(spark, skewed_dir):
    rows = {r["conv_id"]: r for r in derived.transcripts(spark, skewed_dir).collect()}
    told = rows[0]["prompt"] + rows[0]["response"]
    assert rows[0]["response"] == "t2499" and re.findall(r"t(\d+)", told) == [str(t) for t in range(2500)]


def test_transcript_with_a_system_opener(spark, tmp_path):
    """User turns are odd; the last one, without an answer, is all that is left out."""
    spark.range(3002).select(
        F.lit(7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    ).write.parquet(f"{tmp_path}/conversations.parquet")
    row = derived.transcripts(spark, str(tmp_path)).collect()
    assert len(row) == 1
    assert re.findall(r"t(\d+)", row[0]["prompt"] + row[0]["response"]) == [str(t) for t in range(1, 3001)]


def test_good_documents_share_a_rare_bad_one(spark, skewed_dir):
    rows = derived.doc_pairs(spark, skewed_dir).collect()
    assert len(rows) == 597
    assert {r["rejected_response"] for r in rows if r["pair_id"] % 10} == {"word 1"}
    assert {r["rejected_response"] for r in rows if r["pair_id"] % 10 == 0} == {"word 10", "word 20"}
    # Every good text is the prompt of one pair of its language, and of no pair of its own.
    assert len({r["prompt"] for r in rows}) == 597 and all(r["prompt"] != r["chosen_response"] for r in rows)


def test_summaries_are_whole_documents_of_the_language(spark, skewed_dir):
    rows = derived.summaries(spark, skewed_dir).collect()
    posts = {r["doc_id"]: r["info"]["post"] for r in rows}
    texts = {r["doc_id"]: [s["text"] for s in r["summaries"]] for r in rows}
    assert posts == {i: f"word {i}" for i in range(600)} and len(rows) == 600
    for own in ({i for i in posts if i % 10}, {i for i in posts if i % 10 == 0}):
        for k in (0, 1):
            # Each document is the first summary of one other and the second of another.
            assert sorted(texts[i][k] for i in own) == sorted(posts[i] for i in own)
            assert all(texts[i][k] != posts[i] for i in own)


def test_summaries_without_a_language(spark, tmp_path):
    docs = [(1, "a", None), (2, "b", None), (3, "alone", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["doc_id"]: [s["text"] for s in r["summaries"]] for r in derived.summaries(spark, str(tmp_path)).collect()}
    assert rows == {1: ["b", "a"], 2: ["a", "b"], 3: ["alone", "alone"]}


def test_logits_meet_per_position_without_a_shuffle_of_each(spark, tmp_path):
    """Repeated turns with equal and other replies, a null one and one without tokens, against the long table."""
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a b a"), (1, 1, "assistant", "a b a"), (1, 1, "assistant", "a c"), (2, 0, "user", "q"), (2, 1, "assistant", None)]
    turns += [(3, 0, "user", "q"), (3, 1, "assistant", ""), (4, 0, "user", "q"), (4, 1, "assistant", " ".join(f"w{i}" for i in range(50)))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    at = str(tmp_path)
    by_place = F.array_sort(F.collect_list(F.struct("token", "logit")))
    plain = derived.logits(spark, at).groupBy("id", "pos", "target").agg(F.transform(by_place, lambda x: x["logit"]).alias("logits"))
    arrays = derived.logit_arrays(spark, at)
    assert arrays.columns == plain.columns and sorted(map(tuple, arrays.collect())) == sorted(map(tuple, plain.collect()))
    assert max(len(r["logits"]) for r in plain.collect()) == 48
    rows = F.array_sort(F.collect_list(F.struct("pos", "logits", "target")))
    whole = plain.groupBy("id").agg(rows.alias("rows")).select("id", F.col("rows.logits").alias("logits"), F.col("rows.target").alias("labels"))
    tensors = derived.logit_tensors(spark, at)
    assert tensors.columns == whole.columns and sorted(map(tuple, tensors.collect())) == sorted(map(tuple, whole.collect()))
    # Responses are gathered, once, and nothing longer than they are.
    for made in (arrays, tensors):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") == 1 and "collect_list(good" in plan


def test_hashed_text_of_a_position_is_made_before_its_classes(spark, tmp_path):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a b"), (None, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "c")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = derived.logits(spark, str(tmp_path))
    for r in made.collect():
        digest = hashlib.md5(f"lg:{r['id']}:{r['pos']}:{r['token']}".encode()).hexdigest()
        assert r["logit"] == 10 * (int(digest[:8], 16) / 2**32)
    assert made.count() == 3 * derived.LOGIT_CLASSES
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("explode(") :]
    assert "concat_ws(:, lg" in below and "concat_ws(:, lg" not in plan[: plan.index("explode(")]
