from __future__ import annotations

import json

import pyarrow as pa
import pytest
from test_sources import RAW, raw_pairs

from pairloom import sources
from pairloom.sources import saved, schemas

VALUE = {"dtype": "string", "_type": "Value"}
MESSAGE = [{"content": VALUE, "role": VALUE}]
NUMBER = {"dtype": "float64", "_type": "Value"}
FEATURES = {
    "source": VALUE, "prompt": VALUE, "chosen": MESSAGE, "chosen-rating": NUMBER, "chosen-model": VALUE,
    "rejected": MESSAGE, "rejected-rating": NUMBER, "rejected-model": VALUE,
}


def messages(kind):
    return pa.list_(pa.struct([("content", kind), ("role", kind)]))


def written(folder, rows, files=2, text=pa.string(), features=FEATURES, drop=(), **state):
    """A folder as other tools save it, through pyarrow alone."""
    folder.mkdir(parents=True)
    schema = pa.schema([(n, messages(text) if f == MESSAGE else pa.float64() if f == NUMBER else text) for n, f in FEATURES.items() if n not in drop])
    names = []
    for k in range(files):
        names.append(f"data-{k:05d}-of-{files:05d}.arrow")
        own = [dict(zip(FEATURES, r)) for r in rows[k::files]]
        for r in own:
            r |= {c: [{"content": m[0], "role": m[1]} for m in r[c]] for c in ("chosen", "rejected")}
        with pa.ipc.new_stream(str(folder / names[-1]), schema) as out:
            out.write_table(pa.Table.from_pylist([{n: r[n] for n in schema.names} for r in own], schema), max_chunksize=1)
    (folder / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names], "_split": "train"} | state))
    (folder / "dataset_info.json").write_text(json.dumps({"features": features, "splits": {"train": {"num_examples": len(rows)}}}))
    return str(folder)


@pytest.mark.parametrize("text", [pa.string(), pa.large_string()])
def test_equals_its_parquet_twin(spark, tmp_path, text):
    rows = RAW * 3 + [(None, "", [], None, None, [("ü\n", None)], float("nan"), "m")]
    path = written(tmp_path / "saved", rows, 3, text)
    spark.createDataFrame(rows, schemas.PAIRS).write.parquet(str(tmp_path / "twin"))
    for schema in (None, schemas.PAIRS):
        ours, twin = (sources.read_examples(spark, p, schema) for p in (path, str(tmp_path / "twin")))
        assert ours.schema == twin.schema
        assert sorted(map(repr, ours.collect())) == sorted(map(repr, twin.collect()))
    assert ours.rdd.getNumPartitions() == 3
    assert saved.saved_rows(spark, path) == len(rows)


def test_only_asked_columns_are_decoded(spark, tmp_path):
    path = written(tmp_path / "saved", RAW)
    assert sources.read_saved(spark, path, ["rejected", "prompt"]).columns == ["rejected", "prompt"]
    assert sorted(r["prompt"] for r in sources.read_saved(spark, path, ["prompt"]).collect()) == ["p one", "p two"]
    # Through a schema as well: the data source is asked for no more than its columns.
    asked = schemas.T.StructType([schemas.T.StructField("prompt", schemas.T.StringType())])
    assert "rejected" not in sources.read_examples(spark, path, asked)._jdf.queryExecution().toString()
    with pytest.raises(sources.MissingColumns):
        sources.read_examples(spark, path, schemas.MC1)


def test_missing_files_are_refused(spark, tmp_path):
    path = written(tmp_path / "saved", RAW)
    state = json.loads((tmp_path / "saved/state.json").read_text())
    state["_data_files"].append({"filename": "data-00002-of-00002.arrow"})
    (tmp_path / "saved/state.json").write_text(json.dumps(state))
    with pytest.raises(sources.BadDataset, match="data-00002"):
        sources.read_saved(spark, path)


def test_files_of_other_columns_are_refused(spark, tmp_path):
    wrong = FEATURES | {"chosen-rating": {"dtype": "int64", "_type": "Value"}}
    for name, settings, column in (("type", {"features": wrong}, "chosen-rating"), ("none", {"drop": ("rejected-model",)}, "rejected-model")):
        path = written(tmp_path / name, RAW, **settings)
        with pytest.raises(Exception, match=f"no column {column}"):
            sources.read_saved(spark, path).collect()
    with pytest.raises(sources.BadDataset, match="indices"):
        sources.read_saved(spark, written(tmp_path / "picked", RAW, _indices_data_files=[{"filename": "indices.arrow"}]))
    with pytest.raises(sources.BadDataset, match="does not know"):
        sources.read_saved(spark, written(tmp_path / "odd", RAW, features={"prompt": {"_type": "Image"}}))


@pytest.mark.parametrize("feature, expected", [
    ([{"a": VALUE}], "array<struct<a:string>>"),
    ({"feature": VALUE, "_type": "Sequence"}, "array<string>"),
    ({"feature": {"a": VALUE, "b": NUMBER}, "_type": "Sequence"}, "struct<a:array<string>,b:array<double>>"),
    ({"feature": {"a": VALUE}, "_type": "List"}, "array<struct<a:string>>"),
    ({"names": ["x", "y"], "_type": "ClassLabel"}, "bigint"),
    ({"_type": VALUE}, "struct<_type:string>"),
])
def test_features(feature, expected):
    assert saved.feature_type(feature).simpleString() == expected


def test_written_folders_read_back(spark, tmp_path):
    path = str(tmp_path / "saved")
    df = spark.createDataFrame(RAW * 50, schemas.PAIRS).repartition(4)
    sources.write_saved(df, path, "rm", shard_bytes=2_000)
    back = sources.read_saved(spark, f"file:{path}")
    assert back.schema == schemas.PAIRS and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    told = json.loads((tmp_path / "saved/dataset_info.json").read_text())["splits"]["rm"]
    files = [f["filename"] for f in json.loads((tmp_path / "saved/state.json").read_text())["_data_files"]]
    assert told["num_examples"] == 100 and told["num_bytes"] > 0 and files == sorted(files)
    # What other tools read: plain stream files.
    assert sum(pa.ipc.open_stream(str(tmp_path / "saved" / f)).read_all().num_rows for f in files) == 100
    with pytest.raises(FileExistsError):
        sources.write_saved(df, path)


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    sources.write_saved(spark.createDataFrame([], schemas.PAIRS), path)
    assert sources.read_saved(spark, path).schema == schemas.PAIRS and sources.read_saved(spark, path).count() == 0


def test_folders_of_splits(spark, tmp_path):
    path = str(tmp_path / "all")
    df = spark.createDataFrame([(i, "rm" if i % 3 else "test") for i in range(30)], "id long, split string")
    sources.write_saved_splits(df, path)
    assert sorted(map(tuple, sources.read_examples(spark, path).collect())) == sorted(map(tuple, df.collect()))
    assert sources.read_split(spark, path, "test").count() == 10 and sources.read_split(spark, path, "ppo").count() == 0
    with pytest.raises(ValueError, match="dev"):
        sources.read_split(spark, path, "dev")
