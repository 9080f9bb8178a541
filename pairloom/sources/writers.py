"""Sinks, and the manifest of what they wrote."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairloom.sources.readers import MANIFEST, require_columns

SPLIT_NAMES = ("rm", "ppo", "test")


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save a labelled table with one directory per split. Rows stay in the task that holds them."""
    require_columns(df, ["split"]).write.mode(mode).partitionBy("split").parquet(path)


def _apart(spark: SparkSession, splits: Sequence[str]) -> int:
    """The least number of partitions that keeps all splits apart, so that a small one is not dealt out with a large one."""
    hashes = [r[0] for r in spark.createDataFrame([(name,) for name in splits], "split string").select(F.hash("split")).collect()]
    count = len(hashes)
    while len({h % count for h in hashes}) < len(set(hashes)):
        count += 1
    return count


def write_sized_splits(
    df: DataFrame,
    path: str,
    text_cols: Sequence[str] = (),
    number_cols: Sequence[str] = (),
    splits: Sequence[str] = SPLIT_NAMES,
    max_rows: int = 0,
    mode: str = "errorifexists",
) -> dict[str, dict[str, int]]:
    """Save a labelled table in files of about the advisory partition size, and what was written beside them.

    Rows are rebalanced by split: small parts of a split from many tasks come together, and a large
    split is dealt to several tasks. ``max_rows`` bounds the rows of a file as well. Rows, bytes of
    the text columns and rows with NaN in the number columns are counted, for each split, by the very
    tasks that write. A label that is not among ``splits`` fails.
    """
    labelled = require_columns(df, ["split", *text_cols, *number_cols])
    unknown = F.raise_error(F.concat(F.lit("unknown split "), F.coalesce("split", F.lit("null"))))
    labelled = labelled.withColumn("split", F.when(F.col("split").isin(*splits), F.col("split")).otherwise(unknown.cast("string")))
    size = _text_bytes(text_cols)
    metrics = []
    for k, name in enumerate(splits):
        own = F.col("split") == name
        metrics += [F.count_if(own).alias(f"rows_{k}"), F.sum(F.when(own, size).otherwise(F.lit(0))).alias(f"bytes_{k}")]
        metrics += [F.count_if(own & F.isnan(c)).alias(f"nan_{k}_{i}") for i, c in enumerate(number_cols)]
    counted = Observation()
    # Counted behind the exchange, in the tasks that write: a task that is run again counts once.
    out = labelled.hint("rebalance", _apart(df.sparkSession, splits), F.col("split")).observe(counted, *metrics)
    out.write.mode(mode).option("maxRecordsPerFile", str(max_rows)).partitionBy("split").parquet(path)
    seen = counted.get
    manifest = {
        name: {"num_examples": seen[f"rows_{k}"] or 0, "num_bytes": seen[f"bytes_{k}"] or 0, "nan_rows": {c: seen[f"nan_{k}_{i}"] or 0 for i, c in enumerate(number_cols)}}
        for k, name in enumerate(splits)
    }
    rows = [(json.dumps({"splits": manifest}),)]
    df.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{MANIFEST}")
    return manifest


def write_completions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save ``{instruction, output, generator}`` records as JSON Lines, one file per task."""
    records = require_columns(df, ["instruction", "output", "generator"])
    records.select("instruction", "output", "generator").write.mode(mode).option("ignoreNullFields", "false").json(path)


def _text_bytes(cols: Sequence[str]) -> Column:
    return sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in cols), F.lit(0).cast("long"))


def split_manifest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(split, num_examples, num_bytes): true counts per split, bytes over the named text columns."""
    size = _text_bytes(cols)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("num_examples"), F.sum(size).alias("num_bytes"))


def schema_json(df: DataFrame) -> str:
    """The table's schema as JSON, to keep beside a saved dataset."""
    return df.schema.json()
