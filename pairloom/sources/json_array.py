"""One JSON array of records, cut into records by many tasks.

A text reader hands out what stands between two closing braces, in parallel ranges of the file. A
piece holds no half of an escape, since a brace is never escaped, so the number of quotes
in it says whether it changes from outside a string to inside, whatever stands before. A range
knows its pieces' places among its own; how ranges start, inside a string or not, how deep, and
at which record, is a running sum over one row for each range. A record is what lies between two
braces that close to the array's own depth.

Anything between records but one comma, elements that are not records, and an array that is not closed fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.sources.staging import staged, staging_path

_BEFORE = (Window.unboundedPreceding, -1)
_ESCAPES = r"(?s)\\."
_STRINGS = '"[^"]*"'


def _depth(text: Column) -> Column:
    """Opening less closing brackets of a text without strings."""
    opening, closing = (F.length(F.regexp_replace(text, f"[^{c}]", "")) for c in (r"\[{", r"\]}"))
    return opening - closing


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, range, at, piece, quotes, outside, inside)``: what a piece does to the depth if it starts outside a string, or inside."""
    read = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece")
    )
    bare = F.regexp_replace("piece", _ESCAPES, "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    # An open string at the end is cut off; a piece that starts inside one is given its quote.
    outside, inside = (F.regexp_replace(F.regexp_replace(t, _STRINGS, ""), '"(?s:.*)', "") for t in (bare, F.concat(F.lit('"'), bare)))
    return read.select("*", quotes.alias("quotes"), _depth(outside).alias("outside"), _depth(inside).alias("inside"))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``: the text of each record, on one line."""
    own = Window.partitionBy("file", "range")
    before = own.orderBy("at").rowsBetween(*_BEFORE)
    # Pieces carry the place in their range; which is the last of a file is known from the ranges.
    held = pieces(spark, path).withColumns({"odd": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2, "last": F.lead("at").over(own.orderBy("at")).isNull()})
    # A piece ends in a brace, which counts unless it ends inside a string.
    for start in (0, 1):
        begins = (F.col("odd") + start) % 2 == 1
        ends = (F.col("odd") + start + F.col("quotes")) % 2 == 1
        held = held.withColumn(f"moves{start}", F.when(begins, F.col("inside")).otherwise(F.col("outside")) - (~ends).cast("int"))
    held = staged(held.select("file", "range", "at", "piece", "last", "odd", "quotes", "moves0", "moves1"), "json_pieces")

    # One row for each range of a file.
    ranges = Window.partitionBy("file").orderBy("range")
    prior = ranges.rowsBetween(*_BEFORE)
    starts = held.groupBy("file", "range").agg(F.sum("quotes").alias("quotes"), F.sum("moves0").alias("moves0"), F.sum("moves1").alias("moves1"))
    starts = starts.withColumn("inside", F.coalesce(F.sum("quotes").over(prior), F.lit(0)) % 2)
    starts = starts.withColumn("moves", F.when(F.col("inside") == 1, F.col("moves1")).otherwise(F.col("moves0")))
    starts = starts.withColumns({"deep": F.coalesce(F.sum("moves").over(prior), F.lit(0)), "final": F.lead("range").over(ranges).isNull()})
    starts = starts.select("file", "range", "inside", "deep", "final")

    moves = F.when(F.col("inside") == 1, F.col("moves1")).otherwise(F.col("moves0"))
    placed = held.join(starts, ["file", "range"]).withColumn("moves", moves)
    placed = placed.withColumns({"depth": F.col("deep") + F.sum("moves").over(own.orderBy("at")), "last": F.col("last") & F.col("final")})
    ends_outside = (F.col("odd") + F.col("inside") + F.col("quotes")) % 2 == 0
    # Only the brace behind the last piece is not there.
    placed = placed.withColumn("closes", (F.col("depth") == 1) & ends_outside & ~F.col("last"))
    placed = placed.select("file", "range", "at", "piece", "last", "depth", "closes", F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0)).alias("record"))
    placed = staged(placed, "json_places")
    counts = placed.groupBy("file", "range").agg(F.sum(F.col("closes").cast("long")).alias("n"))
    counts = counts.select("file", "range", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("earlier"))
    numbered = placed.join(counts, ["file", "range"]).withColumn("record", F.col("record") + F.col("earlier"))

    parts = F.array_sort(F.collect_list(F.struct("range", "at", "piece")))
    records = numbered.groupBy("file", "record").agg(parts.alias("parts"), F.max("last").alias("last"), F.max(F.when(F.col("last"), F.col("depth"))).alias("depth"))
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), "}")
    records = records.select("file", "record", "last", "depth", text.alias("text"))
    first = F.col("record") == 0
    # The last piece is what follows the last record; its brace that is not there was counted.
    rest_is_right = (F.col("depth") == -1) & F.when(first, F.col("text").rlike(r"^[\s﻿]*\[\s*\]\s*$")).otherwise(F.col("text").rlike(r"^\s*\]\s*$"))
    starts_right = F.when(first, F.col("text").rlike(r"^[\s﻿]*\[\s*\{")).otherwise(F.col("text").rlike(r"^\s*,\s*\{"))
    wrong = F.raise_error(F.concat(F.lit("malformed array of records in "), F.col("file"), F.lit(", record "), F.col("record").cast("string")))
    line = F.when(F.col("last"), F.when(rest_is_right, F.lit(None).cast("string")).otherwise(wrong.cast("string")))
    line = line.when(starts_right, F.concat(F.regexp_replace(F.regexp_replace("text", r"^[\s﻿,\[]*", ""), r"[\r\n]", " "), F.lit("}"))).otherwise(wrong.cast("string"))
    return records.select(line.alias("value")).where("value is not null")


def as_json_lines(spark: SparkSession, path: str) -> str:
    """Where the records of an array were written, one on a line."""
    to = staging_path(spark, "json_lines") + ".jsonl"
    array_records(spark, path).write.text(to)
    return to
