"""Quality scores against a plain computation; chat rendering against a loop over turns."""

from __future__ import annotations

import math
import random
import hashlib
from collections import defaultdict

import numpy as np
import pytest

from pairloom.llm import chat, quality, queries


def documents(spark, folder, n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        words = ["".join(rng.choices(["ran", "tel", "mio", "sor", "ned", "pla", "kut"], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 300))]
        text = " ".join(words) if good else "".join(f"{w.upper()}!! " for w in words[:3] * 30)
        rows.append((i, text, "en" if i % 2 else None, "big" if i % 3 else f"s{i % 40}", "clash"))
        labels.append((i, int(good)))
    rows += [(n, None, "en", "big", ""), (n + 1, "", "en", None, ""), (n + 2, " \n", None, None, ""), (None, "ran tel mio", "en", "big", ""), (1, *rows[1][1:])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return rows, dict(labels)


def test_op1(spark, tmp_path):
    rows, labels = documents(spark, tmp_path)
    found = queries.op1_quality(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert sum(by_id[i]["keep"] == bool(y) for i, y in labels.items()) / len(labels) > 0.98
    assert not any(by_id[600 + k]["keep"] for k in range(3)) and by_id[600]["score"] == 0.0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit_on(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in found)

    # The same posteriors and scores, site by site, in plain Python.
    evidence, hosts, paths = [], defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for _, text, lang, source, _ in rows:
        p = float(model.probabilities(np.array([quality.features(text)]))[0]) if text and text.strip() else None
        evidence.append(min(max(p, 1e-6), 1 - 1e-6) if p is not None else 0.0)
        for site in (hosts[source], paths[source, lang]):
            site[0] += 1
            site[1] += evidence[-1]
    mean = min(max(sum(evidence) / len(evidence), 1e-4), 1 - 1e-4)

    def strength(sites):
        sites = [(n, s, m) for n, s, m in sites if n > 1]
        between = max(sum(n * ((s / n - m) ** 2 - m * (1 - m) / n) for n, s, m in sites) / sum(n for n, _, _ in sites), 0.0)
        within = sum(n * m * (1 - m) for n, _, m in sites) / sum(n for n, _, _ in sites)
        return min(quality.MOST_STRENGTH, max(1.0, within / between - 1)) if between > 0 else quality.MOST_STRENGTH

    of_hosts = strength((n, s, mean) for n, s in hosts.values())
    above = {h: (s + of_hosts * mean) / (n + of_hosts) for h, (n, s) in hosts.items()}
    of_paths = strength((n, s, above[h]) for (h, _), (n, s) in paths.items())
    expected = []
    for (i, _, lang, source, _), own in zip(rows, evidence):
        (hn, hs), (pn, ps) = hosts[source], paths[source, lang]
        host = (hs - own + of_hosts * mean) / (hn - 1 + of_hosts)
        path = min(max((ps - own + of_paths * host) / (pn - 1 + of_paths), 1e-6), 1 - 1e-6)
        odds = math.log(own / (1 - own)) + math.log(path / (1 - path)) - math.log(mean / (1 - mean)) if own else None
        expected.append((own, host, path, 1 / (1 + math.exp(-odds)) if own else 0.0))
    got = sorted((r["evidence"], r["host_posterior"], r["path_posterior"], r["score"]) for r in found)
    np.testing.assert_allclose(got, sorted(expected), atol=1e-9)
    assert len(hosts) > 1 and 1 < of_hosts


def test_sparse_sites_shrink_and_large_ones_do_not(spark):
    rows = [("bad", "p", 0.1)] * 500 + [("good", "p", 0.9)] * 500 + [("good", "rare", 0.1)] + [("one", "p", 0.1)]
    rows += [(f"h{i}", "p", 0.85) for i in range(50) for _ in range(20)]
    sites, prior = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    at = {(r["host"], r["path"]): r for r in sites.collect()}

    def posterior(host, path):
        r = at[host, path]
        own = (r["host_s"] + prior["host"] * prior["mean"]) / (r["host_n"] + prior["host"])
        return (r["s"] + prior["path"] * own) / (r["n"] + prior["path"])

    assert posterior("bad", "p") < 0.15 and posterior("good", "rare") > 0.7
    assert abs(posterior("one", "p") - prior["mean"]) < abs(0.1 - prior["mean"]) / 2


def test_without_labels_or_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    found = {r["id"]: r for r in quality.score_quality(docs, None).collect()}
    assert found[1]["evidence"] == 0.5 and found[2]["score"] == 0.0
    assert quality.score_quality(docs.limit(0), None).count() == 0
    assert quality.fit([], []) is None and quality.fit(["a"], [1]) is None


def rendered(turns, participant):
    text, mask = "", []
    for _, role, body in turns:
        text += "<|im_start|>" + ("system" if role == "system" else "assistant" if role == participant else f"user name={role}") + "\n"
        start = len(text)
        text += body + "<|im_end|>\n"
        if role == participant:
            mask.append((start, len(text)))
    return text, mask


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hello é\U0001f600"), (1, 2, "bob", None), (1, 3, "cy", ""), (1, 3, "ann", "tie"), (1, 3, "ann", "tie"),
    (2, None, "ann", "no number"), (2, 5, None, "nameless"), (2, 6, " ", "also"), (None, 1, "dan", "x <|im_end|> y"), (3, 0, "system", "alone"),
    *[(4, t, "ann" if t % 2 else "bob", f"turn {t}") for t in range(700)],
]


@pytest.mark.parametrize("block", [1, 128, 100_000])
def test_perspectives(spark, block):
    df = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, part string")
    got = defaultdict(lambda: ["", [], 0])
    for r in sorted(chat.rotate_perspectives(df, block=block).collect(), key=lambda r: r["part"]):
        own = got[r["conv_id"], r["participant"]]
        assert r["offset"] == len(own[0])
        own[0] += r["text"]
        own[1] += [(m["start"], m["end"]) for m in r["mask"]]
        own[2] += r["n_turns"]
    expected = {}
    for conv in {t[0] for t in TURNS}:
        own = [(-1 if n is None else n, r if r and r.strip() else "unknown", (x or "").replace("<|im_", "<| im_")) for c, n, r, x in TURNS if c == conv]
        own.sort()
        for participant in {r for _, r, _ in own} - {"system"}:
            expected[conv, participant] = [*rendered(own, participant), len(own)]
    assert dict(got) == expected


def test_turns_without_numbers_come_in_parts(spark):
    """30,000 turns without a number and 3,000 of the same number, many of them equal, in parts of 128."""
    turns = [(1, None, ("ann", "bob", "cy")[i % 3], f"text {i % 500}") for i in range(30_000)] + [(1, 7, "ann", "same")] * 3_000 + [(1, 8, "bob", "last"), (2, 0, "ann", "short")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(6)
    rows = chat.rotate_perspectives(df).collect()
    assert max(r["n_turns"] for r in rows) == 128
    for who in ("ann", "bob", "cy"):
        parts = sorted((r for r in rows if (r["conv_id"], r["participant"]) == (1, who)), key=lambda r: r["part"])
        assert [r["part"] for r in parts] == list(range(-(-30_000 // 128) + -(-3_001 // 128)))
        own = sorted((t for t in turns if t[0] == 1), key=lambda t: (-1 if t[1] is None else t[1], t[2], hashlib.md5(t[3].encode()).hexdigest()))
        text, mask = rendered([t[1:] for t in own], who)
        assert "".join(r["text"] for r in parts) == text
        assert [(m["start"], m["end"]) for r in parts for m in r["mask"]] == mask
        assert all(text[r["offset"] :].startswith(r["text"]) for r in parts)


def test_native_plan(spark, data_dir):
    plan = queries.op5_chat(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pages_have_hosts_and_paths(spark):
    addresses = ["https://Example.com/blog/2024/a.html?q=1#x", "http://example.com:80", "http://example.com/", "https://other.org/shop", "not an address", None]
    pages = spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string").selectExpr("*", "concat('some words of page ', page_id) as html")
    sited = quality.with_address(pages)
    found = {r["page_id"]: (r["host"], r["path"]) for r in sited.collect()}
    assert found == {
        0: ("example.com", "/blog"), 1: ("example.com", "/"), 2: ("example.com", "/"), 3: ("other.org", "/shop"), 4: (None, None), 5: (None, None),
    }
    scored = quality.score_quality(sited, None, id_col="page_id", text_col="html", host_col="host", path_col="path")
    assert {r["id"] for r in scored.collect()} == set(range(6))
