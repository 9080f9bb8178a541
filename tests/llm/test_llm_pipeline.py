"""The pipeline, stage by stage, against plain Python on a small corpus."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_llm_jaccard import brute as components

import corpus_pipeline
from pairloom.llm import bpe, jaccard_join, pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("pipeline"))
    vocabulary = ["".join(rng.choices(["ran", "tel", "mio", "sor", "ned", "pla", "kut", "vie"], k=rng.randint(1, 4))) for _ in range(600)]
    passage = " ".join(rng.choices(vocabulary, k=14))
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        if i % 10 == 3:
            words[5:5] = passage.split()
        if i % 10 == 4:
            words[7:7] = ["mail", f"u{i}@example.com", "or", "+1 (555) 555-2485"]
        text = " ".join(words)
        if i % 6 == 5:
            text = "".join(f"{w.upper()}!! " for w in words[:4] * 20)
        if i % 10 == 7 and i > 20:
            text = rows[i - 1][1] + " tail"
        if i % 10 == 8 and i > 20:
            text = rows[i - 2][1]
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, " "), (None, rows[0][1]), (None, " ".join(rng.choices(vocabulary, k=60))), (1, rows[1][1])]
    rng.shuffle(rows)
    docs = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "kept") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, terms string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 5)) for i in range(300)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, f"Q: {passage}?"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "token_ids"]
    stages = dict(corpus_pipeline.STAGES)

    start = rows_of(docs)
    good = stages["quality"](spark, docs, folder)
    assert good.columns == docs.columns
    shouted = [t for _, t in start if t and "!!" in t]
    kept = rows_of(good)
    assert {t for _, t in kept} == {t for _, t in start if t and t.strip()} - set(shouted)

    single = stages["near_duplicates"](spark, good, folder)
    assert single.columns == docs.columns
    named = [(k, t) for k, (_, t) in enumerate(kept)]
    groups: dict[int, list[int]] = {}
    for k, _, root in components(named, 5, 80):
        groups.setdefault(root, []).append(k)
    expected = []
    for members in groups.values():
        first = min((kept[k][0] is None, kept[k][0] or 0, jaccard_join.fingerprint(jaccard_join.shingles(kept[k][1].encode(), 5)), k) for k in members)
        expected.append(kept[first[3]])
    got = rows_of(single)
    assert ordered(got) == ordered(expected)

    clean = stages["decontamination"](spark, single, folder)
    item = [w for w in WORD.findall(spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first()["text"].lower())]
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}

    def leaks(text):
        words = WORD.findall(text.lower())
        return any(tuple(words[i : i + 10]) in windows for i in range(len(words) - 9))

    expected = [r for r in got if not leaks(r[1])]
    got = rows_of(clean)
    assert ordered(got) == ordered(expected) and clean.columns == docs.columns and len(got) < len(expected) + 1

    private = stages["personal_data"](spark, clean, folder)
    assert private.columns == docs.columns and private.count() == len(got)
    texts = [r for r in private.collect()]
    assert not any(pii.base_spans(r["text"]) for r in texts) and any("[EMAIL]" in r["text"] for r in texts)
    assert all(r["n_chars"] == len(r["text"]) and r["terms"] == "kept" for r in texts)
    before = {i: t for i, t in got}
    assert all(r["text"] == before[r["doc_id"]] for r in texts if not pii.base_spans(before[r["doc_id"]]))

    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    encoded = {r["doc_id"]: r for r in stages["token_ids"](spark, private, folder).collect()}
    assert len(encoded) == len(texts)
    for r in texts:
        ids = library.encode_ordinary(r["text"])
        row = encoded[r["doc_id"]]
        assert bytes(row["ids"]) == np.array(ids, "<u4").tobytes() and row["n_tokens"] == len(ids)
        assert row["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(encoded)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
