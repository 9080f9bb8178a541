from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import final_plan
from pyspark.errors import PySparkException

from pairloom import operators as op
from pairloom import plans

NAN = float("nan")


def test_explode_sets(spark):
    mc1 = spark.createDataFrame(
        [(1, "q?", (["a", "b"], [0, 1]))], "q long, question string, mc1_targets struct<choices:array<string>,labels:array<int>>"
    )
    rows = [tuple(r) for r in op.explode_mc1(mc1).collect()]
    assert rows == [(1, "Human: q?\n\nAssistant: ", 0, "a", 0), (1, "Human: q?\n\nAssistant: ", 1, "b", 1)]
    keyed = spark.createDataFrame(
        [(1, "q?", (["a", "b"], ["1", "2"]), "2")],
        "q long, question string, choices struct<text:array<string>,label:array<string>>, answerKey string",
    )
    rows = [tuple(r) for r in op.explode_keyed_choices(keyed).collect()]
    assert rows == [(1, "Human: q?\n\nAssistant:", 0, "a", 0), (1, "Human: q?\n\nAssistant:", 1, "b", 1)]


def test_sequence_logprob_counts_masked_positions_only(spark):
    scores = spark.createDataFrame(
        [(1, 0, 0, 0, -9.0), (1, 0, 1, 1, -1.0), (1, 0, 2, 1, -2.0)], "q long, choice int, pos int, mask int, logprob double"
    )
    assert op.sequence_logprob(scores).first()["logprob"] == -3.0


def choice_tables(spark, questions):
    """questions: {q: [(answer, label, logprob or None), ...]}"""
    choices = [(q, i, a, lab) for q, cs in questions.items() for i, (a, lab, _) in enumerate(cs)]
    scores = [(q, i, s) for q, cs in questions.items() for i, (_, _, s) in enumerate(cs) if s is not None]
    return (
        spark.createDataFrame(choices, "q long, choice int, answer string, label int"),
        spark.createDataFrame(scores, "q long, choice int, logprob double"),
    )


def test_accuracy_decisions(spark):
    questions = {
        1: [("aa", 1, -2.0), ("bb", 0, -2.0)],  # tie: the first wins, rightly
        2: [("aa", 0, -2.0), ("bb", 1, -2.0)],  # tie: the first wins, wrongly
        3: [("a", 0, -2.0), ("bbbbbbbb", 1, -4.0)],  # right only by length
        4: [("a", 0, -1.0), ("b", 0, -2.0)],  # nothing labelled 1
        5: [("a", 1, -1.0), ("b", 0, None)],  # a choice without a score
        6: [("a", 0, -1.0), ("b", 1, NAN)],  # NaN counts as highest, as in numpy
        7: [("", 1, -1.0), ("bb", 0, -9.0)],  # empty answer: no score by length
        8: [("a", 1, -1.0), ("b", 1, -2.0)],  # two right ones: the first is gold
    }
    choices, scores = choice_tables(spark, questions)
    rows = {r["q"]: r for r in op.score_questions(choices, scores).collect()}
    assert {q for q, r in rows.items() if not r["valid"]} == {4, 5}
    assert {q: r["correct"] for q, r in rows.items() if r["valid"]} == {1: 1, 2: 0, 3: 0, 6: 1, 7: 1, 8: 1}
    assert {q: r["correct_norm"] for q, r in rows.items() if r["valid"]} == {1: 1, 2: 0, 3: 1, 6: 1, 7: 0, 8: 1}
    for q in (1, 2, 3, 6, 8):
        raw = np.array([s for _, _, s in questions[q]])
        by_length = raw / np.array([float(len(a)) for a, _, _ in questions[q]])
        assert (rows[q]["predicted"], rows[q]["predicted_norm"]) == (np.argmax(raw), np.argmax(by_length))
    total = op.mc_accuracy(choices, scores).first()
    assert (total["questions"], total["invalid"]) == (6, 2)
    assert math.isclose(total["acc"], 4 / 6) and math.isclose(total["acc_norm"], 4 / 6)


def test_report_metric_by_set(spark):
    rows = spark.createDataFrame(
        [("tqa", 1, 0, True), ("arc-e", 1, 0, True), ("arc-e", 1, 1, True), ("arc-e", 1, 1, False)],
        "eval_set string, correct int, correct_norm int, valid boolean",
    )
    got = {r["metric"]: r["value"] for r in op.eval_report(rows).collect()}
    assert got == {"tqa_accuracy": 1.0, "arc-e_accuracy": 0.5}


def test_logits_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for i, scale in enumerate([1.0, 50.0, 1e4, 1e-3]):
        values = rng.normal(size=20) * scale
        top = values.max()
        want[i] = values[3] - top - np.log(np.exp(values - top).sum())
        rows += [(i, 0, t, float(v), 3) for t, v in enumerate(values)]
    # Classes switched off with -inf carry no mass.
    rows += [(9, 0, 0, 0.0, 0), (9, 0, 1, 0.0, 0), (9, 0, 2, float("-inf"), 0)]
    want[9] = -math.log(2)
    df = spark.createDataFrame(rows, "id long, pos int, token int, logit double, target int")
    got = {r["id"]: r["logprob"] for r in op.logprob_from_logits(df).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_logits_in_many_bins(spark):
    """Far apart, at a bin's edge, negative, NaN below the highest, nothing finite, the target missing; null is no class."""
    inf = float("inf")
    cases = [[0.0, 700.0, -900.0, 5e3], [255.9, 256.1, -1e9], [-0.1, 0.1, -256.0, -513.0], [511.9, 512.0, 256.0, 0.0], [-1e9, -1e9 - 1, -5e9]]
    rows, want = [], {}
    for i, values in enumerate(cases):
        top = max(values)
        for target in range(len(values)):
            want[i, target] = values[target] - top - math.log(sum(math.exp(v - top) for v in values))
            rows += [(i, target, t, v, target) for t, v in enumerate(values)]
    rows += [(7, 0, 0, NAN, 1), (7, 0, 1, 600.0, 1), (8, 0, 0, -inf, 0), (8, 0, 1, None, 0), (9, 0, 0, 1.0, 5), (10, 0, 0, -inf, 0), (10, 0, 1, 3.0, 0)]
    rows += [(11, 0, 0, None, 1), (11, 0, 1, 300.0, 1)]
    df = spark.createDataFrame(rows, "id long, pos int, token int, logit double, target int")
    got = {(r["id"], r["pos"]): r["logprob"] for r in op.logprob_from_logits(df).collect()}
    assert math.isnan(got.pop((7, 0))) and got.pop((8, 0)) is None and got.pop((9, 0)) is None
    assert got.pop((10, 0)) == -inf and got.pop((11, 0)) == 0.0
    assert got == pytest.approx(want, rel=1e-12)


def test_nan_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (NAN, 1.0), (None, 1.0)], "a double, b double")
    report = {r["column_name"]: (r["rows"], r["nan_rows"]) for r in op.nan_report(df, ["a", "b"]).collect()}
    assert report == {"a": (3, 1), "b": (3, 0)}
    assert op.assert_no_nan(df, ["b"]).collect()
    with pytest.raises(PySparkException, match="NaN in a"):
        op.assert_no_nan(df, ["a"]).collect()
    # Neither a count nor a selection without the column gets past the check.
    with pytest.raises(PySparkException, match="NaN in a"):
        op.assert_no_nan(df, ["a"]).count()
    with pytest.raises(PySparkException, match="NaN in a"):
        op.assert_no_nan(df, ["a"]).select("b").collect()


def test_evaluation_refuses_nan(spark):
    choices, _ = choice_tables(spark, {1: [("a", 1, 0.0)]})
    scores = spark.createDataFrame([(1, 0, 1, 1, NAN)], "q long, choice int, pos int, mask int, logprob double")
    with pytest.raises(PySparkException, match="NaN in logprob"):
        plans.evaluate_sets({"tqa": (choices, scores)}).collect()


def test_preference_score(spark):
    rows = [
        (1, "pos", -100, 5.0), (1, "pos", 7, 2.0), (1, "neg", -100, 5.0), (1, "neg", 7, 3.0),
        (2, "pos", 7, 2000.0), (2, "neg", 7, 3000.0),
    ]
    df = spark.createDataFrame(rows, "id long, cond string, label int, loss double")
    got = {r["id"]: r for r in op.contrastive_preference(df).collect()}
    p, n = math.exp(-1.0), math.exp(-1.5)  # ignored positions stay in the denominator
    assert got[1]["pos_lp"] == pytest.approx(-math.log(p / (p + n) + 1e-8))
    assert got[1]["neg_lp"] == pytest.approx(-math.log(n / (p + n) + 1e-8))
    assert got[1]["score"] == pytest.approx(0.8 * got[1]["pos_lp"] + 0.2 * got[1]["neg_lp"])
    # Both probabilities underflow to zero; the score stays finite.
    assert got[2]["pos_lp"] == pytest.approx(0.0, abs=1e-7) and got[2]["neg_lp"] == pytest.approx(-math.log(1e-8))
    total = op.contrastive_loss(df).first()
    assert total["examples"] == 2 and total["score"] == pytest.approx((got[1]["score"] + got[2]["score"]) / 2)


ACTS = "example_id long, layer int, pos int, variant string, mask int, vec array<float>"


def test_steering_and_distance(spark):
    rows = [
        (1, 10, 0, "base", 1, [1.0, 0.0]), (1, 10, 0, "pos", 1, [2.0, 1.0]), (1, 10, 0, "neg", 1, [1.0, 1.0]),
        (1, 10, 0, "model", 1, [6.0, 4.0]),
        (1, 10, 1, "base", 0, [1.0, 1.0]), (1, 10, 1, "pos", 1, [1.0, 1.0]), (1, 10, 1, "neg", 1, [0.0, 0.0]),
        (1, 10, 1, "model", 1, [9.0, 9.0]),
        (1, 12, 0, "base", 1, [NAN, 0.0]), (1, 12, 0, "pos", 1, [0.0, 0.0]), (1, 12, 0, "neg", 1, [0.0, 0.0]),
        (1, 12, 0, "model", 1, [0.0, 0.0]),
        (1, 11, 0, "base", 1, [1.0, 0.0]), (1, 11, 0, "pos", 1, [2.0, 1.0]), (1, 11, 0, "neg", 1, [1.0, 1.0]),
    ]
    acts = spark.createDataFrame(rows, ACTS)
    targets = op.steering_targets(acts)
    got = {(r["layer"], r["pos"]): r["target"] for r in targets.collect()}
    assert set(got) == {(10, 0), (10, 1), (12, 0)}
    assert got[10, 0] == [6.0, 0.0] and got[10, 1] == [0.0, 0.0]
    by_layer = {r["layer"]: r for r in op.alignment_distance(acts, targets, by=["layer"]).collect()}
    assert by_layer[10]["distance"] == 2.0 and by_layer[10]["positions"] == 2  # the masked position counts as 0
    assert by_layer[12]["distance"] is None
    assert op.alignment_distance(acts, targets).first()["distance"] == 2.0  # NaN left out


INF = float("inf")


@pytest.mark.parametrize("logits, target, expected", [
    ([1.0, 2.0, 3.0], 2, 3 - math.log(math.exp(1) + math.exp(2) + math.exp(3))),
    ([5000.0, 4999.0], 1, 4999 - 5000 - math.log(1 + math.exp(-1))),
    ([-5000.0, -5001.0], 0, -math.log(1 + math.exp(-1))),
    ([0.5], 0, 0.0), ([1.0, -INF], 0, 0.0), ([1.0, -INF], 1, -INF), ([1.0, None], 0, 0.0),
    ([1.0], 3, None), ([1.0], None, None), ([], 0, None), (None, 0, None),
])
def test_logprob_of_arrays(spark, logits, target, expected):
    for kind in ("double", "float"):
        df = spark.createDataFrame([(1, 0, logits, target)], f"id long, pos int, logits array<{kind}>, target int")
        got = op.logprob_from_arrays(df).first()["logprob"]
        assert got == expected if expected in (None, -INF) else got == pytest.approx(expected, abs=1e-6)


def test_logprob_of_tensors(spark):
    rows = [(1, [[1.0, 2.0], [0.0, 0.0], [3.0, 1.0]], [-100, 1, 0]), (2, [[1.0, 0.0]], [1]), (3, [], []), (4, None, None), (5, [[1.0, 0.0], [2.0, 2.0]], [0, -100])]
    df = spark.createDataFrame(rows, "id long, logits array<array<float>>, labels array<int>")
    half = -math.log(2)
    shifted = {(r["id"], r["pos"]): r["logprob"] for r in op.logprob_from_tensor(df).collect()}
    assert shifted == {(1, 0): pytest.approx(-math.log(1 + math.exp(-1))), (1, 1): pytest.approx(half)}
    plain = {(r["id"], r["pos"]): r["logprob"] for r in op.logprob_from_tensor(df, shift=False).collect()}
    assert plain == {(1, 1): pytest.approx(half), (1, 2): pytest.approx(-math.log(1 + math.exp(-2))), (2, 0): pytest.approx(-1 - math.log(1 + math.exp(-1))), (5, 0): pytest.approx(-math.log(1 + math.exp(-1)))}
    plan = op.logprob_from_tensor(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_placed_activations_are_not_shuffled(spark):
    rng = np.random.default_rng(3)
    rows = [(e, layer, 0, v, 1, rng.normal(size=4).tolist()) for e in range(30) for layer in (10, 12) for v in ("base", "pos", "neg", "model") if not (e == 7 and v == "neg")]
    acts = spark.createDataFrame(rows, ACTS)
    placed = op.write_placed(acts, "placed_acts", 4)
    try:
        targets = op.steering_targets(placed, placed=True)
        assert "Exchange" not in final_plan(targets)
        assert sorted(map(repr, targets.collect())) == sorted(map(repr, op.steering_targets(acts).collect()))
        per_layer = op.steered_distance(placed, by=["layer"], placed=True)
        # The one exchange is that of the layers' sums.
        assert final_plan(per_layer).count("Exchange") == 1
        expected = {r["layer"]: r for r in op.alignment_distance(acts, op.steering_targets(acts), by=["layer"]).collect()}
        for r in per_layer.collect() + op.steered_distance(acts, by=["layer"]).collect():
            assert r["positions"] == expected[r["layer"]]["positions"] and r["distance"] == pytest.approx(expected[r["layer"]]["distance"])
    finally:
        spark.sql("DROP TABLE placed_acts")
