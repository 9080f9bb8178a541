from __future__ import annotations

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.functions.fixed_values import WHITESPACE
from pairloom.functions.text import strip


def one(df, *cols):
    row = df.select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def test_strip_is_python_strip(spark):
    texts = [f"{a}x{b}y{c}" for a in WHITESPACE for b in (" ", "\n") for c in WHITESPACE] + ["", " \n ", "​x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"))
    assert all(r["s"] == r["t"].strip() for r in df.collect())


MESSAGES = "array<struct<content:string,role:string>>"


def test_extract_responses_short_conversation_is_null(spark):
    df = spark.createDataFrame(
        [([("q", "user"), ("a", "assistant")], [("q", "user")])], f"chosen {MESSAGES}, rejected {MESSAGES}"
    )
    assert one(op.extract_responses(df), "chosen_response", "rejected_response") == ("a", None)


@pytest.mark.parametrize(
    ("style", "expected"),
    [
        ("dialogue", "\n\nHuman:  hi \n\nAssistant: "),
        ("bare", "Human:  hi \n\nAssistant: "),
        ("bare_stripped", "Human: hi\n\nAssistant: "),
        ("bare_tight", "Human:  hi \n\nAssistant:"),
        (
            "summary",
            "\n\nHuman: Your task is to write a summary for the following post.\n\npost:  hi \n\nAssistant: ",
        ),
    ],
)
def test_styles(spark, style, expected):
    df = spark.createDataFrame([(" hi ",)], "prompt string")
    assert one(op.format_prompts(df, style), "prompt") == expected


def test_unknown_style(spark):
    with pytest.raises(ValueError, match="unknown prompt style"):
        op.format_prompts(spark.createDataFrame([("a",)], "prompt string"), "loud")


def test_append_eos(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert one(op.append_eos(op.append_eos(df, ["x"]), ["y"], spaced=False), "x", "y") == ("a </s>", "b</s>")


def test_turn_boundaries_strip_first(spark):
    df = spark.createDataFrame([("\n\nHuman: a\n\nAssistant: b\n\nhuman: c\n\nHuman: d \n",)], "prompt string")
    marked = "Human: a\n\nAssistant: b </s>\n\nhuman: c </s>\n\nHuman: d"
    assert one(op.mark_turn_boundaries(df), "prompt") == marked
    assert one(op.mark_turn_boundaries(df, leading=True), "prompt") == "\n\n" + marked


def test_preference_side():
    from pairloom.operators.prompts import preference_side

    assert preference_side("chosen") == "chosen"
    assert preference_side("rejected_but_not_chosen") == "chosen"
    assert preference_side("rejected") == "rejected"
    with pytest.raises(ValueError):
        preference_side("all")


def pair_rows(spark):
    return spark.createDataFrame(
        [(1, " p ", "good </s>", "bad </s>")],
        "id long, prompt string, chosen_response string, rejected_response string",
    )


def test_training_texts(spark):
    df = pair_rows(spark)
    dialogue = "\n\nHuman:  p \n\nAssistant: "
    assert one(op.build_training_text(df, "preference"), "text") == dialogue + "good </s>"
    assert one(op.build_training_text(df, "preference", "rejected"), "text") == dialogue + "bad </s>"
    talk = spark.createDataFrame([("\n\nHuman: a\n\nHuman: b", "r", "c")], "prompt string, response string, chosen string")
    assert one(op.build_training_text(talk, "sft"), "text") == "Human: a </s>\n\nHuman: br </s>"
    assert one(op.build_training_text(talk, "transcript"), "text") == "\n\nHuman: a </s>\n\nHuman: bc </s>"
    with pytest.raises(ValueError):
        op.build_training_text(df, "poem")


def test_hindsight_swaps_instructions(spark):
    rows = {r["type"]: r for r in op.hindsight_examples(pair_rows(spark), "G", "B").collect()}
    prompt = "Human: p\n\nAssistant: "
    assert rows["chosen"]["prompt"] == "G\n\n" + prompt and rows["chosen"]["neg_prompt"] == "B\n\n" + prompt
    assert rows["rejected"]["prompt"] == "B\n\n" + prompt and rows["rejected"]["neg_prompt"] == "G\n\n" + prompt
    assert rows["chosen"]["text"] == "good </s>" and rows["rejected"]["text"] == "bad </s>"


def test_summary_choice_indexes(spark):
    df = spark.createDataFrame(
        [(("post",), [("zero",), ("one",)], 1)],
        "info struct<post:string>, summaries array<struct<text:string>>, choice int",
    )
    assert one(op.summary_preferences(df, "chosen"), "chosen") == "one</s>"
    assert one(op.summary_preferences(df, "rejected"), "chosen") == "zero</s>"


def test_contrast_separators(spark):
    rows = op.contrast_prompts(spark.createDataFrame([(1, "P")], "id long, prompt string")).collect()
    assert {r["variant"]: r["prompt"] for r in rows} == {
        "orig": "Give a ori answer\n\nP",
        "pos": "Give a good answerP",
        "neg": "Give a bad answer\n\nP",
    }


def test_random_swap_is_stable_and_keeps_base(spark):
    df = spark.range(400).select(
        "id",
        F.lit("a b").alias("prompt"),
        F.lit("good").alias("chosen_response"),
        F.lit("bad").alias("rejected_response"),
    )
    draw = lambda d: {r["id"]: (r["chosen"], r["random"]) for r in op.random_preference_swap(d, "id", 7).collect()}
    first = draw(df)
    assert first == draw(df.repartition(13))
    assert all((chosen == "bad") == (u < 0.5) for chosen, u in first.values())
    assert 140 < sum(chosen == "bad" for chosen, _ in first.values()) < 260
    row = op.random_preference_swap(df, "id", 7).first()
    assert row["prompt_length"] == 2 and row["base"] == "good" and row["text"] == row["prompt"] + row["chosen"]


def test_split_turns(spark):
    texts = {
        1: "\n\nHuman: hum\n\nAssistant: an answer\n\nHuman: again\n\nAssistant: more",
        2: "human: low\n\nassistant: case",
        3: "Human: unanswered",
    }
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {(r["id"], r["turn"]): (r["human"], r["assistant"]) for r in op.split_turns(df, "text", ["id"]).collect()}
    assert got == {
        (1, 0): ("hum", "an answer"),
        (1, 1): ("again", "more"),
        (2, 0): ("low", "case"),
        (3, 0): ("unanswered", None),
    }


def test_clean_completions_keeps_unanswered(spark):
    requests = op.completion_requests(spark.createDataFrame([(1, "do"), (2, "it")], "id long, instruction string"))
    prompt = "\n\nHuman: do\n\nAssistant: "
    done = spark.createDataFrame([(1, f"{prompt}x{prompt}y")], "id long, completion string")
    rows = {r["id"]: r for r in op.clean_completions(requests, done, "m").collect()}
    assert rows[1]["output"] == "xy" and rows[2]["output"] is None and rows[2]["generator"] == "m"


def test_lengths_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\t\r") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    rows = [(i, a, rng.choice(texts)) for i, a in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    measured = op.token_lengths(df, {"na": "a", "nab": ("a", "b"), "nba": ("b", "a")}).collect()
    words = lambda t: len(re.findall(r"[^ \t\n\r]+", t))
    for r in measured:
        assert (r["na"], r["nab"], r["nba"]) == (words(r["a"]), words(r["a"] + r["b"]), words(r["b"] + r["a"]))


def test_length_hook_measures_the_concatenation(spark):
    df = spark.createDataFrame([("ab c", "d e")], "a string, b string")
    characters = lambda c: F.split(c, "")
    measured = op.token_lengths(df, {"n": "a", "both": ("a", "b")}, characters)
    assert one(measured, "n", "both") == (4, 7)


def test_arrow_tokenizer_hook(spark):
    @F.pandas_udf("array<string>")
    def halves(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [t[: len(t) // 2], t[len(t) // 2 :]])

    df = spark.createDataFrame([("abcd",)], "a string")
    assert one(op.token_lengths(df, {"n": "a"}, halves), "n") == 2
    vocab = spark.createDataFrame([("ab", 3), ("cd", 4)], "token string, id long")
    assert one(op.encode(df, "a", "a", vocab, 5, tokens=halves), "input_ids") == [3, 4, 2]


def test_budgets_are_inclusive(spark):
    df = spark.createDataFrame(
        [(256, 768, 768), (257, 1, 1), (1, 769, 1), (1, 1, 769)],
        "prompt_length long, chosen_response_length long, rejected_response_length long",
    )
    assert op.filter_pair_budget(df).count() == 1
    assert op.filter_prompt_budget(df).count() == 3
    assert op.filter_text_budget(df, text="chosen_response_length").count() == 2


def test_branches(spark):
    df = pair_rows(spark)
    rows = op.preference_branches(df).collect()
    assert sorted((r["branch"], r["output"]) for r in rows) == [("chosen", "good </s>"), ("rejected", "bad </s>")]
    assert [r["output"] for r in op.preference_branches(df, "rejected").collect()] == ["bad </s>"]
    assert op.concat_examples(df, df.select(*reversed(df.columns))).count() == 2
