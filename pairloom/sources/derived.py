"""Preference-data inputs derived from the generic tables of a data directory.

No preference data ships with the tables, so each input shape is built from
``conversations``, ``documents``, ``labels`` and ``embeddings``, whole, by keyed hashes:
the same rows on every run, at every size, and in any engine that has md5.

The inputs that need a global order, and the vocabularies, are staged once per session and
directory, as tables that several jobs read would be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.arrays import bound
from pairloom.functions.fixed_values import ASSISTANT, HUMAN, TOKEN_PATTERN
from pairloom.functions.hashing import unit_interval
from pairloom.functions.text import token_count, word_tokens
from pairloom.operators.encoding import build_vocab
from pairloom.operators.prompts import append_eos, extract_responses, format_prompts
from pairloom.operators.ranking import exact_rank
from pairloom.sources.readers import spread
from pairloom.sources.staging import staged

_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), over at least as many tasks as there are cores."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def staged_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` makes, written out the first time a session asks for it."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _STAGED:
        _STAGED[at] = staged(build(), name)
    return _STAGED[at]


def _keyed(tag: str, *parts: Column | str) -> Column:
    """Uniform draw from ``tag:part:part...``."""
    return unit_interval(F.concat_ws(":", F.lit(tag), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def pair_id(conversation: Column, turn: Column) -> Column:
    """One number for a turn, unique up to 2^32 turns in a conversation."""
    return conversation * F.lit(1 << 32) + turn


def pair_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn followed by an assistant turn, ranked in hash order (pair_id, prompt, good, rk, n)."""

    def build() -> DataFrame:
        turns = _table(spark, sf_dir, "conversations")
        user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
        reply = turns.where(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("good")
        )
        # Joined on (conversation, turn): a giant conversation spreads over its turns.
        pairs = user.join(reply, ["conv_id", "turn"]).select(
            pair_id(F.col("conv_id"), F.col("turn")).alias("pair_id"), "prompt", "good"
        )
        return exact_rank(staged(pairs, "turn_pairs"), "pair_id", "pair", out="rk", total="n")

    return spread(staged_once(spark, sf_dir, "pair_base", build), "pair_id")


def _neighbour(base: DataFrame, offset: Column | int) -> DataFrame:
    """Each row joined with the answer ``offset`` ranks further on, wrapping round."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    answers = base.select(F.col("rk").alias("_at"), F.col("good").alias("other"))
    return base.withColumn("_at", (F.col("rk") + offset) % F.col("n")).join(answers, "_at").drop("_at")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, prompt, chosen, rejected) with message lists; rejected is the next pair's answer."""

    def messages(answer: str) -> Column:
        return F.array(
            F.struct(F.col("prompt").alias("content"), F.lit("user").alias("role")),
            F.struct(F.col(answer).alias("content"), F.lit("assistant").alias("role")),
        )

    return _neighbour(pair_base(spark, sf_dir), 1).select(
        "pair_id", "prompt", messages("good").alias("chosen"), messages("other").alias("rejected")
    )


def pair_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, prompt, chosen_response, rejected_response), responses closed."""
    responses = append_eos(extract_responses(pairs(spark, sf_dir)), ["chosen_response", "rejected_response"])
    return responses.select("pair_id", "prompt", "chosen_response", "rejected_response")


def pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_responses`` with the prompt in bare style and ``text``, prompt and chosen response."""
    wrapped = format_prompts(pair_responses(spark, sf_dir), "bare")
    return wrapped.withColumn("text", F.concat("prompt", "chosen_response"))


def pair_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of the chosen side only, so that rejected texts hold unknown tokens."""
    return staged_once(spark, sf_dir, "pair_vocab", lambda: build_vocab(pair_text(spark, sf_dir), ["text"]))


def document_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of all documents."""
    return staged_once(spark, sf_dir, "document_vocab", lambda: build_vocab(documents(spark, sf_dir), ["text"]))


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents, each with a bad one of its language: (pair_id, prompt, chosen_response, rejected_response)."""

    def build() -> DataFrame:
        docs = _table(spark, sf_dir, "documents").join(
            _table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"
        )
        # A handful of languages: each (language, quality) is ranked over many buckets.
        keys = docs.select("doc_id", "lang", "quality")
        ranked = exact_rank(keys, "doc_id", "dp", within=["lang", "quality"], out="rk", total="n")
        ranked = staged(ranked, "doc_ranks")
        good = ranked.where(F.col("quality") == 1)
        bad = ranked.where(F.col("quality") == 0)
        bad_counts = bad.groupBy("lang").agg(F.max("n").alias("n_bad"))
        # Ids are matched first, texts fetched by id after: no join is keyed by language alone
        # but the one with the per-language counts, which is one row for each.
        matched = (
            good.join(bad_counts, "lang")
            .select(F.col("doc_id").alias("pair_id"), "lang", (F.col("rk") % F.col("n_bad")).alias("rk"))
            .join(bad.select("lang", "rk", F.col("doc_id").alias("bad_id")), ["lang", "rk"])
            .select("pair_id", "bad_id")
        )
        # The prompt is the whole text of the next good document of the language.
        after = good.select("lang", ((F.col("rk") + F.col("n") - 1) % F.col("n")).alias("rk"), F.col("doc_id").alias("prompt_id"))
        matched = matched.join(good.join(after, ["lang", "rk"]).select(F.col("doc_id").alias("pair_id"), "prompt_id"), "pair_id")
        texts = docs.select("doc_id", "text")
        prompts = texts.select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
        chosen = texts.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("chosen_response"))
        rejected = texts.select(F.col("doc_id").alias("bad_id"), F.col("text").alias("rejected_response"))
        joined = matched.join(chosen, "pair_id").join(rejected, "bad_id").join(prompts, "prompt_id")
        return joined.select("pair_id", "prompt", "chosen_response", "rejected_response")

    return spread(staged_once(spark, sf_dir, "doc_pairs", build), "pair_id")


# Turns put together at a time. A giant conversation is told in many such blocks, and only
# the blocks' strings meet per conversation.
BLOCK_TURNS = 256


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, prompt, response): the history up to the last assistant turn, which is the response."""
    spoken = _table(spark, sf_dir, "conversations").where(F.col("role") != "system")
    last = spoken.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max("turn").alias("last"))
    marker = F.when(F.col("role") == "user", HUMAN).otherwise(ASSISTANT)
    before = F.when(F.col("turn") < F.col("last"), F.struct("turn", F.concat(marker, "text").alias("marked")))
    told = (
        spoken.join(last, "conv_id")
        .where(F.col("turn") <= F.col("last"))
        .groupBy("conv_id", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"))
        .agg(
            F.array_sort(F.collect_list(before)).alias("turns"),
            F.max(F.when(F.col("turn") == F.col("last"), F.col("text"))).alias("response"),
        )
        .select("conv_id", "block", F.array_join(F.col("turns")["marked"], "").alias("history"), "response")
    )
    return told.groupBy("conv_id").agg(
        F.concat(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "history"))), lambda b: b["history"]), ""),
            F.lit(ASSISTANT),
        ).alias("prompt"),
        F.max("response").alias("response"),
    )


def transcript_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, prompt, chosen, rejected): one-turn transcripts with both answers as text."""
    pair = extract_responses(pairs(spark, sf_dir))
    return pair.select(
        "pair_id",
        F.concat(F.lit(HUMAN), "prompt", F.lit(ASSISTANT)).alias("prompt"),
        F.col("chosen_response").alias("chosen"),
        F.col("rejected_response").alias("rejected"),
    )


def summary_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, ranked in hash order within their language (doc_id, lang, text, quality, rk, n)."""

    def build() -> DataFrame:
        labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
        labelled = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(labels, "doc_id")
        return exact_rank(staged(labelled, "labelled"), "doc_id", "summary", within="lang", out="rk", total="n")

    return spread(staged_once(spark, sf_dir, "summary_base", build), "doc_id")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, info, summaries, choice): the next two documents of the language, whole; quality is the choice."""
    base = summary_base(spark, sf_dir)

    def after(offset: int) -> DataFrame:
        # Joined on (language, rank): a language that holds a third of the rows spreads over its ranks.
        at = F.struct("lang", ((F.col("rk") - offset + 2 * F.col("n")) % F.col("n")).alias("rk"))
        return base.select(at.alias("_at"), F.struct("text").alias(f"_s{offset}"))

    posts = base.withColumn("_at", F.struct("lang", "rk"))
    return (
        posts.join(after(1), "_at")
        .join(after(2), "_at")
        .select("doc_id", F.struct(F.col("text").alias("post")).alias("info"), F.array("_s1", "_s2").alias("summaries"), F.col("quality").alias("choice"))
    )


def mc_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, question, choice, answer, label): the own answer and the next three, rotated by rank."""
    base = pair_base(spark, sf_dir).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    answers = pair_base(spark, sf_dir).select(F.col("rk").alias("_at"), F.col("good").alias("answer"))
    return (
        base.withColumn("_at", (F.col("rk") + F.col("k")) % F.col("n"))
        .join(answers, "_at")
        .select(
            F.col("pair_id").alias("q"),
            F.col("prompt").alias("question"),
            ((F.col("k") + F.col("rk")) % 4).cast("int").alias("choice"),
            "answer",
            (F.col("k") == 0).cast("int").alias("label"),
        )
    )


def _choice_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("choice", "answer", "label")))
    return mc_long(spark, sf_dir).groupBy("q", "question").agg(items.alias("items"))


def mc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, question, mc1_targets): answers and 0/1 labels as parallel lists."""
    return _choice_lists(spark, sf_dir).select(
        "q",
        "question",
        F.struct(
            F.col("items")["answer"].alias("choices"),
            F.col("items")["label"].alias("labels"),
        ).alias("mc1_targets"),
    )


def keyed_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, question, choices, answerKey): answers and letters as parallel lists."""
    letters = F.transform("items", lambda i: F.char(65 + i["choice"]))
    right = F.get(F.filter("items", lambda i: i["label"] == 1), F.lit(0))["choice"]
    return _choice_lists(spark, sf_dir).select(
        "q",
        "question",
        F.struct(F.col("items")["answer"].alias("text"), letters.alias("label")).alias("choices"),
        F.char(65 + right).alias("answerKey"),
    )


def _positions(text: str) -> Column:
    """0 .. n-1 for the n tokens of a text; null without tokens, which explodes to no row."""
    n = token_count(F.col(text))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1))


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, choice, pos, mask, logprob): position 0 stands for the prompt."""
    return (
        mc_long(spark, sf_dir)
        .select("q", "choice", F.explode(_positions("answer")).alias("pos"))
        .select(
            "q", "choice", "pos", (F.col("pos") > 0).cast("int").alias("mask"),
            (-8 * _keyed("ts", "q", "choice", "pos")).alias("logprob"),
        )
    )


def token_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cond, pos, label, loss): the first four positions are ignored ones."""
    return (
        pair_base(spark, sf_dir)
        .select(F.col("pair_id").alias("id"), F.explode(_positions("good")).alias("pos"))
        .select("id", "pos", F.explode(F.array(F.lit("pos"), F.lit("neg"))).alias("cond"))
        .select(
            "id", "cond", "pos",
            F.when(F.col("pos") < 4, -100).otherwise(F.col("pos")).alias("label"),
            (8 * _keyed("tl", "id", "cond", "pos")).alias("loss"),
        )
    )


LOGIT_CLASSES = 16


def _target(word: Column, classes: int) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % classes).cast("int")


def _logit(pos: Column | str, token: Column | str) -> Column:
    return 10 * _keyed("lg", "id", pos, token)


def logits(spark: SparkSession, sf_dir: str, classes: int = LOGIT_CLASSES) -> DataFrame:
    """(id, pos, token, logit, target): each token of the response is a position, its hash the target class."""
    return (
        pair_base(spark, sf_dir)
        .select(F.col("pair_id").alias("id"), F.posexplode(word_tokens(F.col("good"))).alias("pos", "word"))
        # What the classes of a position share of the hashed text is made once.
        .select("id", "pos", _target(F.col("word"), classes).alias("target"), F.concat_ws(":", F.lit("lg"), "id", "pos").alias("_at"))
        .select("id", "pos", "target", "_at", F.explode(F.array(*[F.lit(i) for i in range(classes)])).alias("token"))
        .select("id", "pos", "token", (10 * unit_interval(F.concat_ws(":", "_at", "token"))).alias("logit"), "target")
    )


def _logit_places(spark: SparkSession, sf_dir: str, classes: int) -> DataFrame:
    """(id, places): per id the (pos, target, n) that its responses have, in order; ``n`` counts responses of an id that repeats.

    Only the responses meet per id, never their positions or logits.
    """
    texts = pair_base(spark, sf_dir).groupBy(F.col("pair_id").alias("id")).agg(F.collect_list("good").alias("texts"))

    def packed(text: Column) -> Column:
        return F.transform(word_tokens(text), lambda w, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(_target(w, classes).cast("long")))

    def firsts(at: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (F.get(at, i) != F.get(at, i - 1)))

    def place(at: Column, first: Column, i: Column, j: Column) -> Column:
        return F.struct(
            F.shiftright(F.get(at, i), 32).cast("int").alias("pos"),
            F.get(at, i).bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("target"),
            (F.coalesce(F.get(first, j + 1), F.size(at)) - i).alias("n"),
        )

    def places(at: Column) -> Column:
        return bound(firsts(at), lambda first: F.transform(first, lambda i, j: place(at, first, i, j)))

    told = texts.where(F.exists("texts", lambda text: text.rlike(TOKEN_PATTERN)))
    return told.select("id", bound(F.sort_array(F.flatten(F.transform("texts", packed))), places).alias("places"))


def _logit_row(place: Column, classes: int) -> Column:
    """The logits of a place in the order of the classes, each as often as ``logits`` has it."""
    tokens = F.array(*[F.lit(i) for i in range(classes)])
    return F.flatten(F.transform(tokens, lambda token: F.array_repeat(_logit(place["pos"], token), place["n"])))


def logit_arrays(spark: SparkSession, sf_dir: str, classes: int = LOGIT_CLASSES) -> DataFrame:
    """(id, pos, target, logits): ``logits`` with all classes of a position and target in one row."""
    # An outer explode: a plain one would have the places made once more, to see if there are any.
    places = _logit_places(spark, sf_dir, classes).select("id", F.explode_outer("places").alias("place"))
    return places.select("id", "place.pos", "place.target", _logit_row(F.col("place"), classes).alias("logits"))


def logit_tensors(spark: SparkSession, sf_dir: str, classes: int = LOGIT_CLASSES) -> DataFrame:
    """(id, logits, labels): the rows of ``logit_arrays`` of an id as one, in the order of positions."""

    def row(place: Column) -> Column:
        return F.struct(place["pos"].alias("pos"), _logit_row(place, classes).alias("logits"), place["target"].alias("target"))

    rows = _logit_places(spark, sf_dir, classes).select("id", F.sort_array(F.transform("places", row)).alias("rows"))
    return rows.select("id", F.col("rows.logits").alias("logits"), F.col("rows.target").alias("labels"))


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long activation table: four consecutive vectors are base, pos, neg and model; six layers an example."""
    vectors = _table(spark, sf_dir, "embeddings")
    group = F.floor(F.col("vec_id") / 4)
    names = F.array(*[F.lit(v) for v in ("base", "pos", "neg", "model")])
    return vectors.select(
        F.floor(F.col("vec_id") / 24).alias("example_id"),
        (10 + 2 * (group % 6)).cast("int").alias("layer"),
        F.lit(0).alias("pos"),
        F.get(names, (F.col("vec_id") % 4).cast("int")).alias("variant"),
        (group % 5 != 0).cast("int").alias("mask"),
        F.col("embedding").alias("vec"),
    )


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_base(spark, sf_dir).select(F.col("pair_id").alias("id"), F.col("prompt").alias("instruction"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made completions, prompt included, for nine requests in ten."""
    return (
        pair_base(spark, sf_dir)
        .where(F.col("rk") % 10 != 0)
        .select(
            F.col("pair_id").alias("id"),
            F.concat(F.lit(HUMAN), "prompt", F.lit(ASSISTANT), "good").alias("completion"),
        )
    )
