"""Personal data against plain regular expressions, and disclosing terms on a planted corpus."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import pii, queries

# The contract's patterns as they stand.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


@pytest.mark.parametrize("text", [
    "a@b@c.d", "a@b.c@d.e", "x@y.z.", "@a.b", "a@b", "é.x@y-z.co é", "1.2.3.4.5.6.7.8", "1.2.3.256 01.02.03.004", "000255.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "5500005555555559 4111111111111112", "+1 (988) 555-2485", "+1 2", "++49 30 1234567", "+1 (((((( 23456789",
    "a.b+c%d@x.y " * 3, "1" * 5000, "a" * 5000 + "@", "\U0001f600 a@b.c", "4111 1111 1111 1111 4111 1111 1111 1111",
])
def test_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.text("a.@1 5+-(é", max_size=40))
def test_patterns_anywhere(text):
    assert pii.base_spans(text) == plain(text)


def test_nothing_in_nothing():
    assert pii.base_spans(None) == pii.base_spans("") == []


def corpus(spark, tmp_path):
    rows = []
    for i in range(200):  # the name stands only beside one address; the other words are everywhere
        if i % 40 == 0:
            text = f"number{'abcdefgh'[i // 40]} write to Quillfeather please at quill@example.com about things and matters {'xyzvw'[i // 40] * 4}"
        else:
            text = f"please write about things and matters {i} at length to everyone"
        rows.append((i, text, 1, "x"))
    rows += [(900, None, 1, "x"), (901, "", 1, "x"), (None, "me@example.org", 1, "x"), (950, "copy rareword you@example.org", 1, "x"), (950, "copy rareword you@example.org", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, terms string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return docs


def test_disclosing_terms(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    found = pii.find_personal_data(docs).collect()
    assert len(found) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    telling = {texts[r["id"]][t["start"] : t["end"]] for r in found for t in r["terms"]}
    assert telling == {"Quillfeather"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == "numbera write to  please at [EMAIL] about things and matters xxxx"
    assert clean[900] is None and clean[901] == "" and clean[None] == "[EMAIL]" and clean[1] == texts[1]
    assert pii.sanitise(docs).columns == docs.columns


def letters(spark):
    """A name at the head of letters, far from the address, and in a text without it."""
    rows = []
    for i in range(200):
        body = " ".join(f"please write about things and matters {'abcdefghij'[(i + k) % 10] * 5} at length to everyone" for k in range(4))
        if i % 40 == 0:
            body = f"please Quillfeather {'abcde'[i // 40] * 4} {body} write to quill@example.com and Quillfeather again"
        rows.append((i, body))
    copied = "Somebody Copyword " + rows[1][1] + " write to copy@example.com"
    rows += [(300, "everyone saw quillfeather at length"), *((400 + i, copied) for i in range(6))]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("broadcast", [pii.BROADCAST_TERMS, 0])
def test_disclosing_terms_go_everywhere(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", broadcast)
    docs = letters(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["id"]: [texts[r["id"]][t["start"] : t["end"]] for t in r["terms"]] for r in pii.find_personal_data(docs).collect()}
    assert {i: t for i, t in found.items() if t} == {**{i: ["Quillfeather"] * 2 for i in range(0, 200, 40)}, 300: ["quillfeather"]}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, remove=2.0).collect()}
    assert clean[300] == "everyone saw [TERM] at length"
    assert clean[0].startswith("please [TERM] aaaa please") and clean[0].endswith("write to [EMAIL] and [TERM] again")


def test_terms_far_from_their_entity_alone(spark):
    """Never within reach of the address."""
    docs = letters(spark).selectExpr("doc_id", "replace(text, ' and Quillfeather again', '') as text")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, remove=2.0).collect()}
    assert clean[300] == "everyone saw [TERM] at length" and clean[40].startswith("please [TERM] bbbb please")


def test_short_terms_and_codes(spark):
    rows = []
    for i in range(200):
        text = f"please write to all of us in unit {i % 10} about things and matters {'abcdefghij'[i % 10] * 5}"
        rows.append((i, f"{text} says Xu of AB1234 at quill@example.com" if i % 40 == 3 * (i // 40) else f"{text} says no one of them at length"))
    rows.append((300, "ab1234 is the code of xu"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, remove=2.0).collect()}
    assert clean[300] == "[TERM] is the code of [TERM]"
    assert clean[0] == "please write to all of us in unit 0 about things and matters aaaaa says [TERM] of [TERM] at [EMAIL]"
    assert clean[1] == rows[1][1]


def test_op7(spark, data_dir, tmp_path):
    corpus(spark, tmp_path)
    for folder in (data_dir, str(tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        found = queries.op7_personal_data(spark, folder).collect()
        assert len(found) == len(docs)
        texts = {(r["doc_id"]): r["text"] or "" for r in docs}
        for row in found:
            base = plain(texts[row["doc_id"]])
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            assert row["spans"].startswith(joined)
            assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in base) for k in pii.KINDS]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op7_personal_data(spark, str(tmp_path)).count() == 0
    assert pii.sanitise(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 0
