from __future__ import annotations

import json

import pytest

from pairloom import plans, sources, streaming
from pairloom.sources import schemas


RAW = [
    ("s", "p one", [("p one", "user"), ("good", "assistant")], 5.0, "m1", [("p one", "user"), ("bad", "assistant")], 1.0, "m2"),
    ("s", "p two", [("p two", "user"), ("fine", "assistant")], 4.0, "m1", [("p two", "user"), ("poor", "assistant")], 2.0, "m2"),
]


def raw_pairs(spark):
    return spark.createDataFrame(RAW, schemas.PAIRS)


@pytest.mark.parametrize("suffix", [".jsonl", ".json", ".parquet", ""])
def test_reader_follows_the_suffix(spark, tmp_path, suffix):
    path = str(tmp_path / f"pairs{suffix}")
    writer = raw_pairs(spark).write
    writer.json(path) if "json" in suffix else writer.parquet(path)
    got = sources.read_examples(spark, path, schemas.PAIRS)
    assert "chosen_rating" in got.columns and "rejected_model" in got.columns
    assert sorted(r["prompt"] for r in got.collect()) == ["p one", "p two"]


def test_reader_takes_a_json_array(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps([{"id": 1, "instruction": "a"}, {"id": 2, "instruction": "b"}], indent=4))
    got = sources.read_examples(spark, str(path), schemas.INSTRUCTIONS)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "a"), (2, "b")]


def test_misspelled_column_is_renamed(spark, tmp_path):
    path = str(tmp_path / "prepared")
    rows = [(*r, 3, "good </s>", "bad </s>", 5) for r in RAW]
    spark.createDataFrame(rows, schemas.PAIRS_PREPARED).write.parquet(path)
    got = sources.read_examples(spark, path, schemas.PAIRS_PREPARED)
    assert got.first()["rejected_response"] == "bad </s>"


def test_missing_columns_are_refused(spark, tmp_path):
    path = str(tmp_path / "partial")
    raw_pairs(spark).drop("chosen").write.parquet(path)
    with pytest.raises(sources.MissingColumns, match="chosen"):
        sources.read_examples(spark, path, schemas.PAIRS)


@pytest.mark.parametrize("name", ["rejected_respomse", "rejected_response"])
@pytest.mark.parametrize("suffix", ["", ".jsonl"])
def test_prepared_tables_under_either_name(spark, tmp_path, name, suffix):
    path = str(tmp_path / f"prepared{suffix}")
    rows = [(*r, 3, "good </s>", "bad </s>", 5) for r in RAW]
    df = spark.createDataFrame(rows, schemas.PAIRS_PREPARED).withColumnRenamed("rejected_respomse", name)
    df.write.json(path) if suffix else df.write.parquet(path)
    got = sources.read_examples(spark, path, schemas.PAIRS_PREPARED)
    assert got.first()["rejected_response"] == "bad </s>" and got.first()["chosen_response_length"] == 5


def test_json_is_refused_when_broken_or_partial(spark, tmp_path):
    broken, partial = tmp_path / "broken.jsonl", tmp_path / "partial.jsonl"
    broken.write_text('{"id": 1, "instruction": "a"}\n{"id": 2, "instru\n')
    partial.write_text('{"id": 1}\n{"id": 2}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_examples(spark, str(broken), schemas.INSTRUCTIONS).collect()
    with pytest.raises(sources.MissingColumns, match="instruction"):
        sources.read_examples(spark, str(partial), schemas.INSTRUCTIONS)


def test_json_array_after_blank_lines(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text("\n \n" + json.dumps([{"id": 1, "instruction": "a"}, {"id": 2, "instruction": "b"}]))
    got = sources.read_examples(spark, str(path), schemas.INSTRUCTIONS)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "a"), (2, "b")]


def test_splits_round_trip_and_prune(spark, tmp_path):
    path = str(tmp_path / "splits")
    df = spark.createDataFrame([(1, "a", "rm"), (2, "b", "test"), (3, "c", "test")], "id long, prompt string, split string")
    sources.write_splits(df, path)
    got = sources.read_split(spark, path, "test")
    assert sorted(r["id"] for r in got.collect()) == [2, 3] and got.columns == ["id", "prompt"]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()
    manifest = {r["split"]: (r["num_examples"], r["num_bytes"]) for r in sources.split_manifest(df, ["prompt"]).collect()}
    assert manifest == {"rm": (1, 1), "test": (2, 2)}
    assert json.loads(sources.schema_json(df))["type"] == "struct"
    with pytest.raises(sources.MissingColumns):
        sources.write_splits(df.drop("split"), str(tmp_path / "unsplit"))


def test_completion_export(spark, tmp_path):
    path = str(tmp_path / "out")
    asked = spark.createDataFrame([(1, "do"), (2, "it")], "id long, instruction string")
    done = spark.createDataFrame([(1, "\n\nHuman: do\n\nAssistant: done")], "id long, completion string")
    plans.export_completions(asked, done, "m", path)
    records = [json.loads(line) for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted(records, key=lambda r: r["instruction"]) == [
        {"instruction": "do", "output": "done", "generator": "m"},
        {"instruction": "it", "output": None, "generator": "m"},
    ]


class Session:
    """Stands in for a session whose settings a test may choose."""

    def __init__(self, **settings):
        self.settings = {k.replace("__", "."): v for k, v in settings.items()}
        self.conf = self
        self.sparkContext = self
        self.applicationId = "app-1"

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_staging_folder(spark, tmp_path):
    assert sources.staging_dir(Session(spark__checkpoint__dir="s3a://shared/x/", spark__master="yarn")) == "s3a://shared/x"
    # Without a folder of its own, the warehouse, which is shared too; never a temporary folder.
    assert sources.staging_dir(Session(spark__sql__warehouse__dir="hdfs://w/")) == "hdfs://w/_staging"
    got = sources.staged(spark.range(3).toDF("id"), "numbers")
    assert got.count() == 3 and all("/numbers-" in f for f in got.inputFiles())


def test_preparation_file_to_files(spark, tmp_path):
    source, out = str(tmp_path / "raw"), str(tmp_path / "splits")
    spark.createDataFrame([(f"s{i}", f"p {i}", *RAW[0][2:]) for i in range(9)], schemas.PAIRS).write.parquet(source)
    plans.prepare_and_save(spark, source, out, "source", test=2)
    sizes = {s: sources.read_split(spark, out, s).count() for s in ("rm", "ppo", "test")}
    assert sizes == {"rm": 3, "ppo": 4, "test": 2}
    row = sources.read_split(spark, out, "test").first()
    assert row["prompt"].startswith("\n\nHuman: p ") and row["chosen_response"] == "good </s>"


def test_streaming_preparation_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    raw_pairs(spark).write.parquet(source)

    def run():
        stream = streaming.read_pair_stream(spark, source, schemas.PAIRS)
        streaming.start_preparation(stream, out, str(tmp_path / "checkpoint"), prompt_budget=9).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("prompt", "chosen_response_length").collect())

    batch = plans.prepare_pairs(sources.read_examples(spark, source), prompt_budget=9)
    want = sorted(tuple(r) for r in batch.select("prompt", "chosen_response_length").collect())
    assert run() == want
    # A second run takes up only what has arrived since.
    assert run() == want
    raw_pairs(spark).limit(1).write.mode("append").parquet(source)
    assert len(run()) == 3


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from pairloom.sources import staging

    def session(master, warehouse, shared=None):
        settings = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": shared}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings[k]), sparkContext=SimpleNamespace(master=master))

    assert staging.staging_dir(session("local[4]", "file:/w")) == "file:/w/_staging"
    assert staging.staging_dir(session("yarn", "hdfs://n/w/")) == "hdfs://n/w/_staging"
    assert staging.staging_dir(session("yarn", "file:/w", "hdfs://n/c/")) == "hdfs://n/c"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(staging.NoSharedFolder):
            staging.staging_dir(session(master, "file:/w"))
