"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

* ``quality`` drops documents that the quality classifier rejects, empty ones among them.
* ``near_duplicates`` keeps the least id of each group of documents that share four fifths of
  their five-word shingles, directly or through others.
* ``decontamination`` drops documents that hold a passage of the benchmark.
* ``personal_data`` replaces personal data, and terms that give it away, in the texts.
* ``token_ids`` encodes the texts and decodes the ids: ``doc_id, n_tokens, ids, decoded_sha256``,
  ids as little-endian unsigned 32-bit integers.

All stages but the last return the columns of the documents. Null ids, repeated rows, empty
tables and further columns are handled as each operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe, decontaminate, jaccard_join, pii, quality
from pairloom.llm.common import table
from pairloom.sources.staging import staged

SHINGLE_WORDS = 5
PERCENT = 80


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs, n=SHINGLE_WORDS, percent=PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark_passages(docs, table(spark, sf_dir, "benchmark"))


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs, path, pattern).select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", take_out_personal_data),
    ("token_ids", encode),
]

#: The classifier, the join and the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
