"""Preparing pairs as they arrive.

Projection, measurement and budget operators keep no state, so the batch definition is
the streaming one. Splits and vocabularies need the whole table and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pairloom.plans.preparation import prepare_pairs
from pairloom.sources.readers import canonical_names


def read_pair_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New Parquet files of raw pairs as a stream."""
    return canonical_names(spark.readStream.schema(schema).parquet(path))


def start_preparation(pairs: DataFrame, out: str, checkpoint: str, **budgets: int) -> StreamingQuery:
    """Prepare everything that has arrived and append it to a Parquet table, exactly once."""
    return (
        prepare_pairs(pairs, **budgets)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
