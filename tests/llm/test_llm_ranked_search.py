"""Ranked search against scores of all documents."""

from __future__ import annotations

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import connect, difference

from pairloom.llm import queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aZ09 .é-\x7f@`{"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_terms(text):
    assert [t.decode() for t in ranked_search.terms_of(text.encode())] == terms(text)


def brute(docs, items, k):
    """``(row of the item, item_id, rank, doc_id, score)``."""
    held = [(doc, Counter(own), len(own)) for doc, own in ((doc, terms(text)) for doc, text in docs)]
    n, total = sum(size > 0 for _, _, size in held), sum(size for _, _, size in held)
    df = Counter(t for _, own, _ in held for t in own)
    for item, text in items:
        scored = []
        for doc, own, size in held:
            score = 0
            for t in terms(text):
                if own[t]:
                    m = 25 + 75 * size * n // total
                    score += floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        yield from ((item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k]))


@pytest.mark.parametrize("block_terms, block_docs", [(200_000, 16_384), (12, 7)])
def test_search(spark, monkeypatch, block_terms, block_docs):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block_docs)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Éa", "漢", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(most):
        return rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights, k=rng.randint(0, most)))

    docs = [(i, text(60)) for i in range(300)] + [(i, "w3 w4 W5 the") for i in range(400, 520)]
    docs += [(None, "w3 w4 w5 the"), (7, docs[7][1]), (900, None), (901, ""), (902, " . "), (903, "w0 " * 20_000)]
    items = [(i, text(25)) for i in range(12)] + [(3, "w3 w4 w5"), (None, "w7 w7 w9"), (None, None), (50, ""), (51, "nowhere"), (52, " ".join(words) * 3)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(6)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    found = ranked_search.search(d, b, k=10).collect()
    assert Counter(tuple(r) for r in found) == Counter(brute(docs, items, 10))


def test_terms_of_every_document_weigh_nothing(spark):
    docs = spark.createDataFrame([(i, "common") for i in range(600)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "common")], "item_id string, text string")
    assert ranked_search.search(docs, items).count() == 0
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_intervals_close_on_the_best(seed):
    rng = np.random.default_rng(seed)
    n_docs, scores, lists = 400, np.zeros(400, np.int64), []
    for _ in range(rng.integers(1, 9)):
        docs = rng.permutation(n_docs)[: rng.integers(1, n_docs)]
        worth = np.sort(rng.integers(1, rng.choice([3, 1000]), len(docs)))[::-1]
        gain = int(rng.integers(1, 50))
        lists.append(ranked_search.Posting(gain, docs, worth))
        scores[docs] += gain * worth
    docs, found = ranked_search.best_documents(lists, n_docs, 10, 1)
    assert (scores[docs] == found).all()
    least = max(1, np.sort(scores)[-10])
    assert set(np.flatnonzero(scores >= least)) <= set(docs.tolist())


def test_reading_stops_early():
    """Lists of which only the start can matter are not read to their end."""
    read, n = [], 200_000

    class Docs:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def __getitem__(self, at):
            read.append(len(self.values[at]))
            return self.values[at]

    impacts = np.concatenate((np.arange(1000, 980, -1), np.ones(n - 20, np.int64)))
    docs, scores = ranked_search.best_documents([ranked_search.Posting(5, Docs(np.arange(n)), impacts)], n, 10, 1)
    assert sorted(docs.tolist()) == list(range(10)) and scores.tolist() == [5 * x for x in range(1000, 990, -1)]
    assert sum(read) < 1000


def test_op12(spark, data_dir):
    with connect(data_dir) as con:
        assert difference(queries.op12_ranked_search(spark, data_dir), con, queries.ORACLES["op12_ranked_search"]) is None
