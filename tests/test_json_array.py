from __future__ import annotations

import json
import random

import pytest

from pairloom import sources
from pairloom.sources import schemas
from pairloom.sources.json_array import array_records, pieces

ODD = ['a "quoted" word', "braces } in { strings }}", "back\\slash \\", '\\"', "new\nline\ttab", "", None, "ü漢\U0001f600", "[1, {2}]", '"}', "\\\\\"}{", "x" * 3000]


def rows(n, seed=0):
    rng = random.Random(seed)
    for i in range(n):
        yield {"id": i, "text": rng.choice(ODD), "deep": {"list": [{"a": rng.choice(ODD)}] * rng.randint(0, 2), "more": {"b": {}}}, rng.choice(ODD[:5]): 1}


@pytest.fixture
def small_ranges(conf):
    """Ranges much smaller than the longest records."""
    conf(spark__sql__files__maxPartitionBytes="700", spark__sql__files__openCostInBytes="0")


@pytest.mark.parametrize("indent, separators", [(None, None), (4, None), (None, (",", ":"))])
def test_equals_the_records(spark, tmp_path, small_ranges, indent, separators):
    expected = list(rows(120))
    path = tmp_path / "rows.json"
    path.write_text("\n " + json.dumps(expected, indent=indent, separators=separators, ensure_ascii=indent is None) + "\n", encoding="utf-8")
    assert pieces(spark, str(path)).rdd.getNumPartitions() > 20
    found = [json.loads(r["value"]) for r in array_records(spark, str(path)).collect()]
    assert sorted(found, key=lambda r: r["id"]) == expected


def test_a_record_across_many_ranges(spark, tmp_path, small_ranges):
    long = {"id": 1, "text": 'say "}{" ' * 600, "list": [{"k": i, "v": "{"} for i in range(50)]}
    path = tmp_path / "rows.json"
    path.write_text(json.dumps([{"id": 0}, long, {"id": 2}]))
    found = {r["id"]: r for r in (json.loads(r["value"]) for r in array_records(spark, str(path)).collect())}
    assert found == {0: {"id": 0}, 1: long, 2: {"id": 2}}


def test_equals_the_json_lines_twin(spark, tmp_path, small_ranges):
    expected = [{"id": i, "instruction": ODD[i % len(ODD)]} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(expected))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, expected)))
    for schema in (None, schemas.INSTRUCTIONS):
        one, other = (sources.read_examples(spark, str(tmp_path / name), schema) for name in ("a.json", "b.jsonl"))
        assert one.schema == other.schema and sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))


def test_many_files(spark, tmp_path):
    folder = tmp_path / "rows.json"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text(json.dumps([{"id": 10 * k + i, "instruction": "}"} for i in range(k)]))
    got = sources.read_examples(spark, str(folder), schemas.INSTRUCTIONS)
    assert sorted(r["id"] for r in got.collect()) == [10, 20, 21]


@pytest.mark.parametrize("text", [
    '[{"a": 1} {"a": 2}]', '[{"a": 1},, {"a": 2}]', '[{"a": 1}, 5]', '[{"a": 1}, [{"a": 2}]]', '[{"a": 1}', '[{"a": 1},]', '[{"a": 1}]]', '[{"a": 1}] x',
    '[{"a": "1}]', '[{"a": 1]}', '[{"a": }]', '[{"a": 1}}]', '[5]', '[{"a": {"b": 1}]',
])
def test_malformed_arrays_fail(spark, tmp_path, text):
    path = tmp_path / "rows.json"
    path.write_text(text)
    schema = schemas.T.StructType().add("a", "long")
    with pytest.raises(Exception):
        sources.read_examples(spark, str(path), schema).collect()


@pytest.mark.parametrize("text", ["[]", " [ \n ] \n", "﻿[]"])
def test_empty_arrays(spark, tmp_path, text):
    path = tmp_path / "rows.json"
    path.write_text(text, encoding="utf-8")
    assert array_records(spark, str(path)).count() == 0
