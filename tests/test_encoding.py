from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.operators.encoding import Limits, encode_texts

SMALL = Limits(broadcast_rows=3, head_rows=4)  # forces the lookup for large vocabularies


def vocab(spark, words):
    return spark.createDataFrame([(w, i + 3) for i, w in enumerate(words.split())], "token string, id long")


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "k long, text string")


def ids(df, col="input_ids"):
    return {r["k"]: r[col] for r in df.collect()}


def test_vocab_order_and_counts(spark):
    df = texts(spark, "b a a", None, "", "c a b d")
    rows = sorted(op.build_vocab(df, ["text"]).collect(), key=lambda r: r["id"])
    assert [r["id"] for r in rows] == [3, 4, 5, 6]
    assert [(r["token"], r["count"]) for r in rows[:2]] == [("a", 3), ("b", 2)]
    assert {r["token"] for r in rows[2:]} == {"c", "d"}


def test_encode_closes_when_there_is_room(spark):
    df = texts(spark, "a b", "a b c d", "a zz", "", " \n", None)
    encoded = op.encode(df, "k", "text", vocab(spark, "a b c d"), 3)
    assert ids(encoded) == {0: [3, 4, 2], 1: [3, 4, 5], 2: [3, 0, 2], 3: [2], 4: [2], 5: [2]}
    row = encoded.where("k = 2").first()
    assert row["attention_mask"] == [1, 1, 1] and row["labels"] == row["input_ids"]


def test_special_tokens_keep_their_ids(spark):
    df = texts(spark, "b </s>", "b <unk> a </s> </s>", "b <s>")
    table = op.build_vocab(df, ["text"])
    rows = {r["token"]: (r["count"], r["id"]) for r in table.collect()}
    assert rows == {"b": (3, 3), "a": (1, 4), "</s>": (3, 2), "<s>": (1, 1), "<unk>": (1, 0)}
    encoded = op.encode(df, "k", "text", table, 9)
    assert ids(encoded) == {0: [3, 2], 1: [3, 0, 4, 2, 2], 2: [3, 1, 2]}
    assert ids(op.decode(encoded, "k", "input_ids", table), "decoded") == {0: "b", 1: "b a", 2: "b"}
    # Known without an entry in the vocabulary, too.
    assert ids(op.encode(df, "k", "text", vocab(spark, "q b"), 9)) == {0: [4, 2], 1: [4, 0, 0, 2, 2], 2: [4, 1, 2]}


def test_encode_does_not_close_twice(spark):
    end = spark.createDataFrame([("</s>", 2), ("a", 3)], "token string, id long")
    assert ids(op.encode(texts(spark, "a </s>"), "k", "text", end, 9)) == {0: [3, 2]}


@pytest.mark.parametrize("limits", [Limits(), SMALL, Limits(broadcast_bytes=0)])
def test_encode_against_brute_force(spark, limits):
    rng = random.Random(5)
    # "w0" is more than a third of all tokens; a long token and unknown ones are hot, too.
    pool = ["w0"] * 30 + [f"w{i}" for i in range(1, 20)] + ["x" * 300] * 8 + ["unknown"] * 10
    rows = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    df = texts(spark, *rows)
    counts = Counter(t for r in rows for t in r.split() if t != "unknown")
    known = [t for t, _ in counts.most_common()]
    table = spark.createDataFrame([(t, i + 3) for i, t in enumerate(known)], "token string, id long")
    number = {t: i + 3 for i, t in enumerate(known)}
    encoded = op.encode(df, "k", "text", table, 25, add_eos=False, limits=limits)
    assert ids(encoded) == {k: [number.get(t, 0) for t in r.split()[:25]] for k, r in enumerate(rows)}
    decoded = op.decode(encoded, "k", "input_ids", table, limits=limits)
    want = {k: " ".join(t for t in r.split()[:25] if t in number) for k, r in enumerate(rows)}
    assert ids(decoded, "decoded") == want


def test_large_vocab_shuffles_only_what_the_head_misses(spark):
    df = texts(spark, "a a b zz", "")
    table = vocab(spark, "a b c d e f g h")
    assert ids(op.encode(df, "k", "text", table, 9, False, limits=SMALL)) == {0: [3, 3, 4, 0], 1: []}


def test_encode_survives_without_any_broadcast(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    df = texts(spark, "a b c d e f g h zz", "h h h")
    encoded = op.encode(df, "k", "text", vocab(spark, "a b c d e f g h"), 20, False, limits=SMALL)
    assert ids(encoded) == {0: [3, 4, 5, 6, 7, 8, 9, 10, 0], 1: [10, 10, 10]}


def test_several_texts_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a b", "", "b b b", 5)], "k long, x string, y string, z string, n int")
    row = encode_texts(
        df, "k", {"x": (F.col("x"), 9), "y": (F.col("y"), 9), "z": (F.col("z"), 2)}, vocab(spark, "a b"), ["n"]
    ).first()
    assert (row["x"], row["y"], row["z"], row["n"]) == ([3, 4], [], [4, 4], 5)
    with pytest.raises(ValueError):
        encode_texts(df, "k", {str(i): (F.col("x"), 1) for i in range(5)}, vocab(spark, "a"))


def test_long_texts_are_encoded_whole(spark):
    n = 300_000
    df = spark.range(1).select(F.col("id").alias("k"), F.repeat(F.lit("a b "), n).alias("text"))
    got = op.encode_texts(df, "k", {"ids": (F.col("text"), None)}, vocab(spark, "a b"))
    row = got.select(F.size("ids").alias("n"), F.slice("ids", -2, 2).alias("tail")).first()
    assert (row["n"], row["tail"]) == (2 * n, [3, 4])


def test_prompt_mask(spark):
    df = spark.createDataFrame([(1, [5, 6, 7], 2), (2, [5, 6], 9), (3, [5], 0)], "k long, labels array<long>, prompt_length int")
    assert ids(op.mask_prompt_labels(df), "labels") == {1: [-100, -100, 7], 2: [-100, -100], 3: [5]}


def hindsight(spark):
    return spark.createDataFrame(
        [(1, "g a ", "n n a ", "b c"), (2, "g a b c d e ", "n ", "b"), (3, "g ", "n ", "")],
        "k long, prompt string, neg_prompt string, text string",
    )


def test_counter_condition_pads_and_is_not_closed(spark):
    table = vocab(spark, "a b c g n")
    got = ids(op.encode_counter_condition(hindsight(spark), "k", table, 4), "input_ids_neg")
    assert got == {1: [7, 7, 3, 4], 2: [7, 4, 0, 0], 3: [7, 0, 0, 0]}


def test_one_pass_equals_its_parts(spark):
    table = vocab(spark, "a b c g n")
    df = hindsight(spark)
    whole = {r["k"]: r for r in op.encode_hindsight(df, "k", table, 4).collect()}
    text = op.token_lengths(df, {"prompt_length": "prompt"}).withColumn("full", F.concat("prompt", "text"))
    parts = op.mask_prompt_labels(op.encode(text, "k", "full", table, 4, keep=["prompt_length"]))
    negative = ids(op.encode_counter_condition(df, "k", table, 4), "input_ids_neg")
    for r in parts.collect():
        mine = whole[r["k"]]
        assert mine["labels"] == r["labels"] and mine["input_ids"] == r["input_ids"]
        assert mine["input_ids_neg"] == negative[r["k"]] and mine["attention_mask"] == r["attention_mask"]
    assert set(op.project_training_columns(op.encode_hindsight(df, "k", table, 4)).columns) == {
        "input_ids", "attention_mask", "labels", "input_ids_neg",
    }


def test_contrast_rows(spark):
    table = vocab(spark, "Give a ori good bad answer p q r")
    df = spark.createDataFrame([(1, "p q", "r r r"), (2, "p", "")], "k long, prompt string, chosen string")
    rows = {(r["k"], r["variant"]): r for r in op.encode_contrast(df, "k", table, prompt_len=7, max_res_len=2).collect()}
    assert len(rows) == 6
    assert rows[1, "orig"]["input_ids"] == [0, 3, 4, 5, 8, 9, 10, 11, 11]
    assert rows[1, "orig"]["attention_mask"] == [0, 1, 1, 1, 1, 1, 1, 1, 1]
    # Nothing separates the control sentence from the prompt: one unknown token.
    assert rows[1, "pos"]["input_ids"] == [0, 0, 3, 4, 6, 0, 10, 11, 11]
    assert rows[1, "pos"]["attention_mask"] == [0, 0, 1, 1, 1, 1, 1, 1, 1]
    assert rows[2, "neg"]["attention_mask"] == [0, 0, 1, 1, 1, 1, 1, 0, 0]
    assert {len(r["input_ids"]) for r in rows.values()} == {9}
    single = op.encode_contrast(df, "k", table, variants=False, prompt_len=1, max_res_len=1).where("k = 1").first()
    assert single["input_ids"] == [9, 11]


def test_position_ids(spark):
    masks = {1: [0, 0, 1, 1, 1, 0], 2: [0, 0], 3: [1, 1], 4: [1, 0, 1, 1], 5: [0, 1, 0, 0, 1], 6: []}
    df = spark.createDataFrame(list(masks.items()), "k long, attention_mask array<long>")

    def want(mask):
        total, out = 0, []
        for m in mask:
            total += m
            out.append(total - 1 if m else 1)
        return out

    assert ids(op.position_ids(df), "position_ids") == {k: want(m) for k, m in masks.items()}


def test_qa_batches_pad_to_their_longest(spark):
    table = vocab(spark, "a b c")
    df = spark.createDataFrame(
        [(1, 0, "a b", "c"), (2, 0, "a", "b b b"), (3, 1, "a", "c"), (4, 1, "", "")],
        "k long, batch int, question string, answer string",
    )
    rows = {r["k"]: r for r in op.encode_qa_batch(df, "k", "batch", table).collect()}
    assert rows[1]["input_ids"] == [3, 4, 5, 0, 0] and rows[1]["labels"] == [0, 0, 1, 0, 0]
    assert rows[2]["input_ids"] == [0, 3, 4, 4, 4] and rows[2]["attention_mask"] == [0, 1, 1, 1, 1]
    assert rows[3]["input_ids"] == [3, 5] and rows[4]["input_ids"] == [0, 0] and rows[4]["labels"] == [0, 0]


def test_round_trip(spark):
    df = texts(spark, "b a\n\nc  a", "", "c")
    table = op.build_vocab(df, ["text"])
    decoded = op.decode(op.encode(df, "k", "text", table), "k", "input_ids", table)
    assert ids(decoded, "decoded") == {0: "b a c a", 1: "", 2: "c"}


@pytest.mark.parametrize("size", [0, 3, 4, 5, 7, 10, 14, 1000])
def test_sized_vocab_is_the_start_of_the_whole(spark, size):
    """Ties at the cut, special tokens, and fewer tokens than asked for."""
    text = "a a a a b b b c c c d d d e f g h </s> </s> </s> </s> </s> <s> i"
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    whole = op.build_vocab(df, ["text"]).where(F.col("id") < size)
    sized = op.build_vocab(df, ["text"], size=size)
    assert sorted(map(tuple, sized.collect())) == sorted(map(tuple, whole.collect()))
    assert op.build_vocab(df.limit(0), ["text"], size=size).count() == 0


@pytest.mark.parametrize("limits, gathered", [(Limits(), {"k", "_one"}), (SMALL, {"k", "_one", "_left"})])
def test_no_more_than_numbers_is_gathered(spark, limits, gathered, monkeypatch):
    """What goes into the gathering of a text's ids: not its words, nor slot, position and id apart."""
    seen = []
    monkeypatch.setattr("pairloom.operators.encoding.staged", lambda df, name: seen.append(df) or df)
    df = texts(spark, "a b zz a", "c", "")
    encoded = op.encode(df, "k", "text", vocab(spark, "a b c d e f"), 9, False, limits=limits)
    plan = (seen or [encoded])[0]._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Aggregate":
        plan = plan.children().head()
    output = plan.child().output()
    assert {output.apply(i).name() for i in range(output.size())} == gathered
    assert ids(encoded) == {0: [3, 4, 0, 3], 1: [5], 2: []}
