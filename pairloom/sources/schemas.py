"""Declared schemas of the tables this package reads."""

from __future__ import annotations

from pyspark.sql import types as T

_MESSAGES = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("role", T.StringType())]))

PAIRS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", _MESSAGES),
        T.StructField("chosen-rating", T.DoubleType()),
        T.StructField("chosen-model", T.StringType()),
        T.StructField("rejected", _MESSAGES),
        T.StructField("rejected-rating", T.DoubleType()),
        T.StructField("rejected-model", T.StringType()),
    ]
)
PAIRS_PREPARED = T.StructType(
    [
        *PAIRS.fields,
        T.StructField("prompt_length", T.LongType()),
        T.StructField("chosen_response", T.StringType()),
        T.StructField("rejected_respomse", T.StringType()),
        T.StructField("chosen_length", T.LongType()),
    ]
)
TRANSCRIPTS = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType())])
TRANSCRIPT_PAIRS = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", T.StringType()),
        T.StructField("rejected", T.StringType()),
    ]
)
SUMMARIES = T.StructType(
    [
        T.StructField("info", T.StructType([T.StructField("post", T.StringType())])),
        T.StructField("summaries", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
        T.StructField("choice", T.IntegerType()),
    ]
)
MC1 = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField(
            "mc1_targets",
            T.StructType(
                [
                    T.StructField("choices", T.ArrayType(T.StringType())),
                    T.StructField("labels", T.ArrayType(T.IntegerType())),
                ]
            ),
        ),
    ]
)
KEYED_CHOICES = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField(
            "choices",
            T.StructType(
                [
                    T.StructField("text", T.ArrayType(T.StringType())),
                    T.StructField("label", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("answerKey", T.StringType()),
    ]
)
INSTRUCTIONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("instruction", T.StringType())])
COMPLETIONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("completion", T.StringType())])
COMPLETION_RECORDS = T.StructType(
    [
        T.StructField("instruction", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("generator", T.StringType()),
    ]
)
TOKEN_SCORES = T.StructType(
    [
        T.StructField("q", T.LongType()),
        T.StructField("choice", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("mask", T.IntegerType()),
        T.StructField("logprob", T.DoubleType()),
    ]
)
TOKEN_LOSS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("cond", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("loss", T.DoubleType()),
    ]
)
LOGITS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("token", T.IntegerType()),
        T.StructField("logit", T.DoubleType()),
        T.StructField("target", T.IntegerType()),
    ]
)
ACTIVATIONS = T.StructType(
    [
        T.StructField("example_id", T.LongType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("variant", T.StringType()),
        T.StructField("mask", T.IntegerType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
    ]
)
