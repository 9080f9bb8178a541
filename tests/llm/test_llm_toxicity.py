"""Toxicity on planted insults, misspelt ones among the texts held out, and on the generic tables."""

from __future__ import annotations

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm import quality, queries, toxicity
from pairloom.llm.common import least_hashed


def planted(n, rng, insults):
    syllables = ["ran", "tel", "mio", "sor", "ned", "pla", "kut", "vie", "dro", "lam"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 200))]
        labels.append(int(i % 4 == 0))
        if labels[-1]:
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append(" ".join(words))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*planted(800, random.Random(1), ["gribblewort", "snorfhead", "wizzlebrain"]))


def test_held_out_and_misspelt(model):
    scorer = model.scorer()
    for insults in (["gribblewort", "snorfhead"], ["gribblewart", "Snorfheads!", "wizlebrain"]):
        texts, labels = planted(400, random.Random(2), insults)
        right = sum((scorer.score(t) >= toxicity.THRESHOLD) == bool(y) for t, y in zip(texts, labels))
        assert right / len(texts) > 0.95


def test_edges(model):
    scorer = model.scorer()
    assert scorer.score(None) == scorer.score("") == scorer.score(" \n") == 0.0
    assert 0 <= scorer.score("\U0001f600") <= 1 and 0 <= scorer.score("x" * 100_000) <= 1
    assert scorer.score("ran tel " * 50_000 + "gribblewort") >= toxicity.THRESHOLD
    assert toxicity.fit([], []) is None and toxicity.fit(["a", "b"], [1, 1]) is None and toxicity.fit(["", None], [0, 1]) is None


def test_scores_word_by_word(model):
    """A text's score from its words' subwords one at a time: the most toxic run of SEGMENT words."""
    texts, _ = planted(60, random.Random(6), ["gribblewort", "Snorfheads!"])
    texts += ["one", "x" * 300 + " gribblewort", "a.b,c d e", "Gribblewort " * 9]
    for text, score in zip(texts, model.scorer().scores(texts)):
        words = text.lower().replace(".", " ").replace(",", " ").split()
        odds = []
        for lo in range(0, len(words), toxicity.SEGMENT):
            units = [u for w in words[lo : lo + toxicity.SEGMENT] for u in toxicity.subwords([w])[0].tolist()]
            odds.append(sum(float(model.unit[u]) for u in units) / len(units) + model.bias)
        assert abs(score - 1 / (1 + math.exp(-(model.slope * max(odds) + model.offset)))) < 1e-6


def test_least_hashed(spark):
    """At least as many rows as asked for, the least ones, and none between is left out."""
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("place"))
    places = sorted(r["place"] for r in rows.collect())
    for most in (1, 10, 777, 5000, 9000):
        found = sorted(r["place"] for r in least_hashed(rows, "place", most).collect())
        assert found == places[: len(found)] and min(most, 5000) <= len(found) <= most + 20
    assert least_hashed(rows.limit(0), "place", 5).count() == 0


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, score string, label long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, text string").write.parquet(f"{folder}/labels.parquet")


def test_op2(spark, tmp_path):
    texts, labels = planted(800, random.Random(3), ["gribblewort"])
    docs = [(i, t, "x", 9) for i, t in enumerate(texts)] + [(2000, None, None, None), (2001, "", "x", 1), (None, "ran gribblewort", "x", 1), (5, texts[5], "x", 9)]
    write(spark, tmp_path, docs, [(i, y, "x") for i, y in enumerate(labels)] + [(None, 1, ""), (7000, 1, ""), (3, None, "")])
    found = queries.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(docs)
    for row in found:
        assert row["held_out"] == (row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 800]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95


def test_op2_learns_nothing_from_held_out_rows(spark, tmp_path):
    texts, labels = planted(300, random.Random(4), ["gribblewort"])
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    write(spark, tmp_path, [(i, texts[i], "x", 9) for i in range(300)], [(i, labels[i], "x") for i in out])
    assert {r["score"] for r in queries.op2_toxicity(spark, str(tmp_path)).collect()} == {0.0}


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert queries.op2_toxicity(spark, str(tmp_path)).count() == 0


def test_long_words_are_whole():
    """All n-grams once, across the pieces' seams too."""
    for size in (63, 64, 65, 66, 120, 124, 128, 200, 1000):
        word = "".join(chr(0x4E00 + (k * k * 31 + k) % 5000) for k in range(size))
        whole = f"<{word}>"
        units, owners = toxicity.subwords(["short", word, "other"])
        alone = [toxicity.subwords([w])[0] for w in ("short", "other")]
        pieces = max(1, -(-(len(whole) - 4) // (toxicity.MOST_LETTERS - 2)))
        assert (owners == 1).sum() == sum(len(whole) - n + 1 for n in toxicity.SIZES) + pieces
        assert sorted(units[owners == 0]) == sorted(alone[0]) and sorted(units[owners == 2]) == sorted(alone[1])
    start = "".join(chr(0x4E00 + k) for k in range(100))
    one, other = (set(toxicity.subwords([start + end])[0].tolist()) for end in ("insult", "flower"))
    assert one != other


def test_training_sample_follows_the_hash(spark):
    """Long texts read first neither end the sample nor crowd out the rest; one row of each id."""
    rows = [(0, "long " * 1000), *((1, f"copy {k}") for k in range(50)), *((i, f"text {i} " * 5) for i in range(2, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    sample = toxicity.training_rows(docs, labels, F.lit(True), "doc_id", "text", "toxic", 100)
    assert sample.count() == 40
    texts, classes = toxicity.within_budget(sample, 4000)
    assert len(texts) == 39 and not any(t.startswith("long") for t in texts) and set(classes) == {0, 1}
    ordered = [r["text"] for r in sample.orderBy("place").collect() if not r["text"].startswith("long")]
    some, _ = toxicity.within_budget(sample, sum(map(len, ordered[:10])))
    assert set(ordered[:10]) == set(some)
    assert toxicity.fit_on(docs, labels, most_bytes=4000) is not None
    assert quality.fit_on(docs, labels, label_col="toxic", most_bytes=4000) is not None
