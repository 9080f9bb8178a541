from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from pairloom import sources


def skewed(spark, n=60_000):
    """One split has 98 of 100 rows, and every task has rows of each."""
    label = F.when(F.col("id") % 100 == 0, "test").when(F.col("id") % 100 == 1, "ppo").otherwise("rm")
    return spark.range(0, n, 1, 40).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"), F.when(F.col("id") % 7 == 0, float("nan")).otherwise(1.0).alias("score"), label.alias("split"))


def sizes(path, split):
    return [os.path.getsize(f) for f in glob.glob(f"{path}/split={split}/*.parquet")]


def test_files_have_about_the_advised_size(spark, tmp_path, conf):
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="1m", spark__sql__shuffle__partitions="4")
    path = str(tmp_path / "sized")
    sources.write_sized_splits(skewed(spark), path, ["text"])
    large = sizes(path, "rm")
    assert len(large) > 3 and max(large) < 2 * sorted(large)[len(large) // 2]
    assert 500_000 < sorted(large)[len(large) // 2] < 2_000_000
    assert len(sizes(path, "test")) == len(sizes(path, "ppo")) == 1
    # As before, without sizing: a file for each task and split.
    sources.write_splits(skewed(spark), str(tmp_path / "plain"))
    assert len(sizes(str(tmp_path / "plain"), "test")) == 40


def test_rows_of_a_file_are_bounded(spark, tmp_path):
    path = str(tmp_path / "rows")
    sources.write_sized_splits(skewed(spark, 5_000), path, max_rows=500)
    counts = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in counts) <= 500 and sum(r["count"] for r in counts) == 5_000


def test_counts_come_from_the_writing_pass(spark, tmp_path):
    path = str(tmp_path / "counted")
    df = skewed(spark, 3_000)
    manifest = sources.write_sized_splits(df, path, ["text"], ["score"])
    expected = {r["split"]: (r["num_examples"], r["num_bytes"]) for r in sources.split_manifest(df, ["text"]).collect()}
    assert {k: (m["num_examples"], m["num_bytes"]) for k, m in manifest.items()} == expected
    assert {k: m["nan_rows"]["score"] for k, m in manifest.items()} == {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count_if(F.isnan("score")).alias("n")).collect()}
    assert sources.read_split(spark, path, "rm").count() == expected["rm"][0]


def test_other_rows_than_written_are_refused(spark, tmp_path):
    path = str(tmp_path / "changed")
    sources.write_sized_splits(skewed(spark, 1_000), path)
    os.remove(glob.glob(f"{path}/split=ppo/*.parquet")[0])
    with pytest.raises(sources.WrongCount, match="ppo"):
        sources.read_split(spark, path, "ppo")
    assert sources.read_split(spark, path, "test").count() == 10


def test_empty_and_unknown_splits(spark, tmp_path):
    none = sources.write_sized_splits(skewed(spark, 0), str(tmp_path / "none"), ["text"], ["score"])
    assert all(m == {"num_examples": 0, "num_bytes": 0, "nan_rows": {"score": 0}} for m in none.values())
    for label in ("dev", None):
        df = spark.createDataFrame([(1, label)], "id long, split string")
        with pytest.raises(Exception, match="unknown split"):
            sources.write_sized_splits(df, str(tmp_path / f"odd{label}"))
