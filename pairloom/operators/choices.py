"""Multiple-choice sets: exploding them, scoring them, reporting accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.arrays import bound
from pairloom.functions.fixed_values import IGNORE_LABEL
from pairloom.functions.text import apply_style


def explode_mc1(df: DataFrame, key: str = "q") -> DataFrame:
    """One row per choice of a single-answer set: (key, question, choice, answer, label)."""
    zipped = F.arrays_zip(F.col("mc1_targets")["choices"].alias("answer"), F.col("mc1_targets")["labels"].alias("label"))
    return df.select(
        key, apply_style(F.col("question"), "bare").alias("question"), F.posexplode(zipped).alias("choice", "_item")
    ).select(key, "question", "choice", "_item.answer", "_item.label")


def explode_keyed_choices(df: DataFrame, key: str = "q") -> DataFrame:
    """As ``explode_mc1`` for sets that name the right choice by its key."""
    zipped = F.arrays_zip(F.col("choices")["text"].alias("answer"), F.col("choices")["label"].alias("name"))
    return df.select(
        key,
        "answerKey",
        apply_style(F.col("question"), "bare_tight").alias("question"),
        F.posexplode(zipped).alias("choice", "_item"),
    ).select(
        key,
        "question",
        "choice",
        F.col("_item")["answer"].alias("answer"),
        (F.col("_item")["name"] == F.col("answerKey")).cast("int").alias("label"),
    )


def sequence_logprob(token_scores: DataFrame, keys: Sequence[str] = ("q", "choice")) -> DataFrame:
    """Sum of mask x logprob for each (question, choice).

    The mask of a position is that of the token it predicts. Partial sums combine on the
    map side.
    """
    return token_scores.groupBy(*keys).agg(F.sum(F.col("logprob") * F.col("mask")).alias("logprob"))


# Width of a logit bin: exp() of anything within it stays far from overflow.
_LOGIT_BIN = 256.0


def logprob_from_logits(logits: DataFrame, keys: Sequence[str] = ("id", "pos")) -> DataFrame:
    """Log-softmax over the class column at the target class, from (keys.., token, logit, target).

    One pass instead of max-then-sum: exponentials are summed relative to the floor of a
    coarse logit bin, so partial sums combine on the map side and nothing overflows. Of the
    bins of a position only the highest and the one below it can be seen in a double, and these
    are an even and an odd one: each position keeps the highest of either kind, in fields of fixed
    width that are hashed, not sorted.
    """
    finite = F.when(F.col("logit") > F.lit(float("-inf")), F.col("logit"))
    binned = (
        logits.select(
            *keys,
            "logit",
            F.when(F.col("token") == F.col("target"), F.col("logit")).alias("_at_target"),
            F.floor(finite / F.lit(_LOGIT_BIN)).alias("_bin"),
        )
        .groupBy(*keys, "_bin")
        .agg(
            F.sum(F.exp(F.col("logit") - F.col("_bin") * F.lit(_LOGIT_BIN))).alias("_mass"),
            F.max("_at_target").alias("_at_target"),
        )
    )
    kinds = [F.when(F.col("_bin").bitwiseAND(F.lit(1)) == i, F.col("_bin")) for i in (0, 1)]
    # NaN counts as highest, so the highest mass tells of one in any bin.
    merged = binned.groupBy(*keys).agg(
        *[F.max(kind).alias(f"_bin{i}") for i, kind in enumerate(kinds)],
        *[F.max_by("_mass", kind).alias(f"_mass{i}") for i, kind in enumerate(kinds)],
        F.max("_bin").alias("_top"),
        F.max("_mass").alias("_most"),
        F.max("_at_target").alias("_at_target"),
    )

    def part(i: int) -> Column:
        return F.coalesce(F.col(f"_mass{i}") * F.exp((F.col(f"_bin{i}") - F.col("_top")) * F.lit(_LOGIT_BIN)), F.lit(0.0))

    mass = F.when(F.isnan("_most"), F.col("_most")).otherwise(part(0) + part(1))
    return merged.select(
        *keys, (F.col("_at_target") - F.col("_top") * F.lit(_LOGIT_BIN) - F.ln(mass)).alias("logprob")
    )


def nan_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row (column_name, rows, nan_rows) per column, from a single pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(F.isnan(c).cast("long")), F.lit(0)).alias(f"_{i}") for i, c in enumerate(cols)],
    )
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("nan_rows")) for i, c in enumerate(cols)])
    return counted.select("rows", F.explode(items).alias("_item")).select("_item.column_name", "rows", "_item.nan_rows")


def array_logprob(logits: Column, target: Column) -> Column:
    """Log-softmax of an array of logits at a class; null where there is no such class.

    Relative to the largest finite logit, so nothing overflows; a class of minus infinity has no mass.
    """
    top = F.array_max(F.filter(logits, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))

    def scored(top: Column) -> Column:
        mass = F.aggregate(logits, F.lit(0.0), lambda total, x: total + F.coalesce(F.exp(x.cast("double") - top), F.lit(0.0)))
        return F.get(logits, target).cast("double") - top - F.ln(mass)

    # Bound, the largest is found once, not once for each class.
    return bound(top, scored)


def logprob_from_arrays(df: DataFrame, keys: Sequence[str] = ("id", "pos"), logits: str = "logits", target: str = "target") -> DataFrame:
    """Log-softmax at the target class, from a row per position with all its logits. No shuffle."""
    return df.select(*keys, array_logprob(F.col(logits), F.col(target)).alias("logprob"))


def logprob_from_tensor(
    df: DataFrame, keys: Sequence[str] = ("id",), logits: str = "logits", labels: str = "labels", shift: bool = True, ignored: int = IGNORE_LABEL
) -> DataFrame:
    """(keys.., pos, logprob) from a row per example: ``logits`` positions by classes, ``labels`` a position each.

    With ``shift``, the logits of a position are for the label after it, and the last position has none.
    Positions whose label is ``ignored`` are left out. Everything happens inside the row.
    """
    # Zipped rather than looked up by position, which would make the labels again for each position.
    ahead = F.slice(F.col(labels), 1 + int(shift), F.array_size(F.col(logits)))
    both = F.zip_with(F.col(logits), ahead, lambda row, label: F.struct(row.alias("row"), label.alias("label")))
    wanted = F.transform(both, lambda p, i: F.struct(i.alias("pos"), p["label"].alias("label"), p["row"].alias("row")))
    told = F.filter(wanted, lambda p: p["label"].isNotNull() & (p["label"] != ignored))
    scored = F.transform(told, lambda p: F.struct(p["pos"].alias("pos"), array_logprob(p["row"], p["label"]).alias("logprob")))
    # An outer explode: a plain one would have every score made once more, to see if there are any.
    rows = df.select(*keys, F.explode_outer(scored).alias("_scored")).where(F.col("_scored").isNotNull())
    return rows.select(*keys, "_scored.pos", "_scored.logprob")


def assert_no_nan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Refuse NaN scores: any use of the returned table, a count too, raises where a row has one.

    The check is a condition on the rows, which no pruning of columns removes. It rides along
    in the same stage, with no extra pass; ``nan_report`` counts instead of raising.
    """
    sound = F.lit(True)
    for c in cols:
        sound = F.when(F.isnan(c), F.raise_error(F.lit(f"NaN in {c}")).cast("boolean")).otherwise(sound)
    return df.where(sound)


def score_questions(choices: DataFrame, scores: DataFrame, key: str = "q") -> DataFrame:
    """Per question: gold choice, predicted choice raw and by length, both verdicts, ``valid``.

    The highest logprob wins, plain or divided by the answer's length in characters; the
    first of equals wins, NaN counts as highest. A question with no choice labelled 1, or
    with a choice that has no score, is not valid.
    """
    joined = choices.select(key, "choice", "answer", "label").join(
        scores.select(key, "choice", "logprob"), [key, "choice"], "left"
    )
    per_character = F.try_divide(F.col("logprob"), F.length("answer").cast("double"))

    def best(score: Column) -> Column:
        return F.max_by("choice", F.struct(score.alias("score"), (-F.col("choice")).alias("first")))

    return (
        joined.groupBy(key)
        .agg(
            F.min(F.when(F.col("label") == 1, F.col("choice"))).alias("gold"),
            best(F.col("logprob")).alias("predicted"),
            best(per_character).alias("predicted_norm"),
            F.count_if(F.col("logprob").isNull()).alias("_unscored"),
        )
        .select(
            key,
            "gold",
            "predicted",
            "predicted_norm",
            (F.col("predicted") == F.col("gold")).cast("int").alias("correct"),
            (F.col("predicted_norm") == F.col("gold")).cast("int").alias("correct_norm"),
            (F.col("gold").isNotNull() & (F.col("_unscored") == 0)).alias("valid"),
        )
    )


def mc_accuracy(choices: DataFrame, scores: DataFrame, key: str = "q") -> DataFrame:
    """One row: ``acc``, ``acc_norm`` over valid questions, and the counts behind them."""
    return score_questions(choices, scores, key).agg(
        F.avg(F.when(F.col("valid"), F.col("correct"))).alias("acc"),
        F.avg(F.when(F.col("valid"), F.col("correct_norm"))).alias("acc_norm"),
        F.count_if("valid").alias("questions"),
        F.count_if(~F.col("valid")).alias("invalid"),
    )


# Evaluation sets judged by the plain score; all others are judged per character.
PLAIN_SETS = ("tqa",)


def eval_report(results: DataFrame, eval_set: str = "eval_set") -> DataFrame:
    """(eval_set, metric, value) from ``score_questions`` rows tagged with their set.

    The metric is ``<set>_accuracy``: ``acc`` for the plain sets, else ``acc_norm``.
    """
    verdict = F.when(F.col(eval_set).isin(*PLAIN_SETS), F.col("correct")).otherwise(F.col("correct_norm"))
    return (
        results.groupBy(F.col(eval_set).alias("eval_set"))
        .agg(F.avg(F.when(F.col("valid"), verdict)).alias("value"))
        .select("eval_set", F.concat("eval_set", F.lit("_accuracy")).alias("metric"), "value")
    )
