"""Chat formatting with every participant's perspective, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask holds the character ranges of what the
assistant says, closing marker included. System turns are rendered as such in every
perspective and are nobody's.

Turns come in order of their number, repeated numbers in order of speaker and the text's md5. A
dialogue is rendered in parts of ``BLOCK`` turn numbers, and of ``BLOCK`` turns at most where numbers
are repeated or missing: all of it, nothing cut, each part with its number, its offset in the whole rendering, and mask ranges in the whole. A conversation that
holds a third of all rows is many parts in many tasks; what is gathered per conversation is one
row of lengths per part. Joining the parts' texts in order gives the dialogue.

* Null texts count as empty; a null or empty speaker is named ``unknown``.
* Turns without a number come before all others, in parts of their own. Rows without a
  conversation id form one conversation of that id. Repeated rows are turns of their own.
* Conversations of system turns alone have no participant and no row; empty tables give none.
* Markers inside texts and names are broken by a space, so that no text can pose as another turn.
* Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.sources.staging import staged

BLOCK = 128
# The markers of the chat template.
OPEN, CLOSE, SYSTEM, ASSISTANT, USER = "<|im_start|>", "<|im_end|>\n", "system", "assistant", "user name="


def _safe(value: Column) -> Column:
    return F.replace(value, F.lit("<|im_"), F.lit("<| im_"))


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with ``sub``: which run of ``block`` turns of its block a turn is in, 0 but for crowded blocks.

    Crowded blocks are put in order by ranges, so a block that holds a third of all rows is many ranges;
    a turn's rank is its place in its range and the sizes of the ranges before.
    """
    keyed = rows.withColumn("key", F.struct("conv_id", "block"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key")
    calm = keyed.join(crowded, "key", "left_anti").withColumn("sub", F.lit(0).cast("long"))
    # Equal turns are told apart by where they are written.
    busy = staged(keyed.join(crowded, "key", "left_semi").withColumn("tie", F.monotonically_increasing_id()), "crowded")
    order = ["turn", "role", "digest", "tie"]
    ranged = staged(busy.repartitionByRange("key", *order).withColumn("range", F.spark_partition_id()), "crowded")
    prior = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("key", "range", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("key", "range").orderBy(*order)) - 1
    ranked = ranged.withColumn("local", local).join(starts, ["key", "range"])
    ranked = ranked.withColumn("sub", F.floor((F.col("before") + F.col("local")) / block))
    return calm.drop("key").unionByName(ranked.select(*rows.columns, "sub"))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """``(conv_id, participant, part, offset, n_turns, text, mask)``; mask: array of (start, end) in the whole rendering."""
    name = F.coalesce(F.when(F.trim(F.col(role_col)) != "", F.col(role_col)), F.lit("unknown"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn_col) / block), F.lit(-(1 << 62))).alias("block"),
        F.col(turn_col).alias("turn"),
        _safe(name).alias("role"),
        _safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    rows = _dealt(rows.withColumn("digest", F.md5(F.col("text").cast("binary"))), block)
    speakers = rows.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("participant")).distinct()
    # One row per part and perspective, and the turns of the part in order.
    parts = rows.groupBy("conv_id", "block", "sub").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "text"))).alias("turns"))
    seen = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["conv_id"])).select(parts["conv_id"], "block", "sub", "participant", "turns")

    def head(turn):
        return (
            F.when(turn["role"] == SYSTEM, F.lit(f"{OPEN}{SYSTEM}\n"))
            .when(turn["role"] == F.col("participant"), F.lit(f"{OPEN}{ASSISTANT}\n"))
            .otherwise(F.concat(F.lit(f"{OPEN}{USER}"), turn["role"], F.lit("\n")))
        )

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["role"] == F.col("participant")).alias("own")))
    rendered = seen.withColumn("pieces", pieces).select(
        "conv_id", "block", "sub", "participant", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.transform("pieces", lambda p: F.struct(F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body"), p["own"].alias("own"))).alias("sizes"),
    )
    step = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def grow(state, size):
        start = state["at"] + size["head"]
        end = start + size["body"]
        return F.struct(
            end.alias("at"),
            F.when(size["own"], F.concat(state["mask"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["mask"]).alias("mask"),
        )

    walked = rendered.withColumn("walked", F.aggregate("sizes", step, grow)).select(
        "conv_id", "block", "sub", "participant", "n_turns", "text", F.col("walked.at").alias("length"), F.col("walked.mask").alias("own")
    )
    # Only lengths meet per conversation and perspective; each part's place then goes back to its text.
    order = Window.partitionBy("conv_id", "participant").orderBy("block", "sub")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = walked.select("conv_id", "block", "sub", "participant", "length").select(
        "conv_id", "block", "sub", "participant", before.alias("offset"), (F.row_number().over(order) - 1).cast("int").alias("part")
    )
    w, p = walked.alias("w"), places.alias("p")
    on = F.col("w.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("w.block") == F.col("p.block")) & (F.col("w.sub") == F.col("p.sub")) & (F.col("w.participant") == F.col("p.participant"))
    mask = F.transform("w.own", lambda m: F.struct((m["start"] + F.col("p.offset")).alias("start"), (m["end"] + F.col("p.offset")).alias("end")))
    return w.join(p, on).select("w.conv_id", "w.participant", "p.part", "p.offset", F.col("w.n_turns").cast("long").alias("n_turns"), "w.text", mask.alias("mask"))
