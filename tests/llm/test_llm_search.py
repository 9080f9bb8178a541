"""Decontamination and neighbours against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import connect, difference
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, neighbours, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aB1 .é-"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words(text):
    assert [w.decode() for w in decontaminate.words_of(text.encode())] == WORD.findall(lowered(text))


def brute(docs, items, window):
    patterns = []
    for item, text in items:
        words = WORD.findall(lowered(text))
        patterns += [(words[i : i + window], item) for i in range(max(1, len(words) - window + 1))] if words else []
    for doc, text in docs:
        found = list(WORD.finditer(lowered(text)))
        words = [m[0] for m in found]
        hit, named = set(), set()
        for pattern, item in patterns:
            for i in range(len(words) - len(pattern) + 1):
                if words[i : i + len(pattern)] == pattern:
                    hit.update(range(i, i + len(pattern)))
                    named.add(item)
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1][1] = found[i].end()
            else:
                spans.append([found[i].start(), found[i].end()])
        names = ",".join(sorted(str(n) for n in named if n is not None))
        yield doc, len(words), len(hit), len(named - {None}), hashlib.sha256(names.encode()).hexdigest(), [tuple(s) for s in spans]


@pytest.mark.parametrize("chunk_bytes", [60, 2_000_000])
def test_decontamination(spark, chunk_bytes):
    rng = random.Random(3)
    words = "Ab bé c3 dd é \U0001f600x".split()
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(12)] + [(50, None), (51, " . "), (None, "zz yy"), (3, "only zz")]
    docs = [(i, rng.choice([" ", " -- ", "\n"]).join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "zz YY zz yy"), (None, "ab " * 2000), (5, docs[5][1])]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, pattern string")
    found = decontaminate.find_benchmark_passages(d, b, window=4, chunk_bytes=chunk_bytes).collect()
    got = [(r["id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], [(s["start"], s["end"]) for s in r["spans"]]) for r in found]
    assert sorted(got, key=repr) == sorted(brute(docs, items, 4), key=repr)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in found)
    assert decontaminate.find_benchmark_passages(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_benchmark_passages(d.limit(0), b).count() == 0


@pytest.mark.parametrize("name", ["op5_chat", "op6_decontamination", "op9_neighbours"])
def test_equals_sql(spark, data_dir, name):
    with connect(data_dir) as con:
        assert difference(queries.QUERIES[name](spark, data_dir), con, queries.ORACLES[name]) is None


@pytest.mark.parametrize("query_block", [3, 16_384])
def test_neighbours(spark, query_block):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=8).astype(np.float32).tolist() for _ in range(300)]
    vectors[10:120] = [vectors[10]] * 110  # a hot vector, and ties by the dozen
    rows = [(i, v) for i, v in enumerate(vectors)]
    bad = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, []]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + [(1000 + 20 * k, v) for k, v in enumerate(bad)] + [(None, vectors[0])]], "vec_id long, embedding array<float>, score string")
    found = neighbours.nearest(table.repartition(5), F.col("vec_id") % 20 == 0, k=7, query_block=query_block).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}
    expected = {}
    exact = np.array(vectors, np.float64)
    for q in range(0, 300, 20):
        scores = [(-float(sum(a * b for a, b in zip(exact[q].tolist(), exact[c].tolist()))), c) for c in range(300) if c != q]
        expected |= {(q, r + 1): (c, -s) for r, (s, c) in enumerate(sorted(scores)[:7])}
    assert {k: v for k, (v, _) in got.items()} == {k: v for k, (v, _) in expected.items()}
    assert all(got[k][1] == pytest.approx(expected[k][1], rel=1e-12) for k in got)


def test_few_and_no_neighbours(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert neighbours.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 16)), rng.normal(size=(60, 16)) * 10.0 ** rng.integers(-6, 6, (60, 1))
    (qa, sa, na, ea), (qb, sb, nb, eb) = neighbours.quantise(a), neighbours.quantise(b)
    near = (qa.astype(float) @ qb.T) * sa[:, None] * sb[None, :]
    bound = na[:, None] * eb[None, :] + ea[:, None] * (nb + eb)[None, :]
    assert (np.abs(near - a @ b.T) <= bound * (1 + 1e-9)).all()
