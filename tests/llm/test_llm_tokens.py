"""Encoders, token files and token counts against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import bpe, queries, token_counts, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGES = [
    "", " ", "  a  b ", "a \n b", "\n \n", "x  y", "don't  they'll", "<|endoftext|> a<|endoftext|>", "<|startoftext|>x", "İstanbul İ", "é café ́x",
    "\U0001f600 \U0001f469‍\U0001f467", "12 345  6", "a" * 3000, "ab " * 2000, "\x1c\x1d a\x85b", "  　x", "ΣΣ ΟΣ", "ﬁn ẞ", "tab\tend\r\n next", "\x00\x01 z",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.TextCoder(RANKS, public_tokenizers.PATTERN)


def unpack(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.mark.parametrize("text", EDGES)
def test_prefix_coder_equals_library(coder, library, text):
    ids = unpack(coder.encode(text))
    assert ids == library.encode_ordinary(text)
    assert b"".join(coder.coder.tokens[i] for i in ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tabcdeth'sl1.éß"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_prefix_coder_equals_library_anywhere(coder, library, text):
    assert unpack(coder.encode(text)) == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text("abcdeingthé ", max_size=80), st.text("abcdeingthé", max_size=20), st.integers(0, 200), st.integers(0, 20))
def test_appends_and_edits_are_exact(coder, library, text, more, at, width):
    """Appended and edited tables equal tables made anew, for bytes that are one pre-token."""
    data, extra = text.replace(" ", "").encode(), more.encode()
    table = bpe.PrefixTable(coder.coder, data)
    table.append(extra)
    assert table.last == bpe.PrefixTable(coder.coder, data + extra).last
    at = min(at, len(data))
    table.edit(at, at + width, b"xyz")
    whole = (data + extra)[:at] + b"xyz" + (data + extra)[at + width :]
    assert table.data == whole and table.last == bpe.PrefixTable(coder.coder, whole).last
    assert table.ids() == library._core_bpe.encode_single_piece(whole)


def as_table(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    as_table(spark, [*EDGES, None, "same text", "same text"]).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    as_table(spark, []).write.parquet(f"{folder}/documents.parquet")
    return folder


def documents(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("folder", ["data", "edge", "empty"])
def test_op4(spark, data_dir, edge_dir, empty_dir, library, folder):
    folder = {"data": data_dir, "edge": edge_dir, "empty": empty_dir}[folder]
    texts = documents(spark, folder)
    found = queries.op4_byte_bpe(spark, folder).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_ids_as_lists_round_trip(spark, coder, library):
    docs = as_table(spark, ["Hello there", None, ""])
    encoded = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    assert encoded.schema["ids"].dataType.simpleString() == "array<int>"
    decoded = bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert {r["id"]: bytes(r["decoded"]) for r in decoded} == {0: b"Hello there", 1: b"", 2: b""}


@pytest.mark.parametrize("folder", ["data", "edge", "empty"])
def test_op8(spark, data_dir, edge_dir, empty_dir, folder):
    folder = {"data": data_dir, "edge": edge_dir, "empty": empty_dir}[folder]
    texts = documents(spark, folder)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r for r in queries.op8_token_files(spark, folder).collect()}
    assert set(found) == set(texts)
    start = 0
    for doc_id in sorted(texts):
        ids = tokenizer.encode(texts[doc_id], add_special_tokens=False).ids + [2]
        row = found[doc_id]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_are_selective(spark, data_dir, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    token_files.write_token_files(spark.read.parquet(f"{data_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), parts=2)
    plan = token_files.read_token_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "array<int>" not in plan
    some = token_files.read_token_ids(spark, path, 10, 19)
    assert sorted(r["id"] for r in some.collect()) == list(range(10, 20))
    assert "GreaterThanOrEqual(id,10)" in some._jdf.queryExecution().executedPlan().toString()
    column = {}
    for file in tmp_path.glob("tokens/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        column |= {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DELTA_BINARY_PACKED" in e for e in column["place"].encodings) and column["place"].has_column_index
    assert any("DICTIONARY" in e for e in column["ids.list.element"].encodings)


@pytest.mark.parametrize("folder", ["data", "edge", "empty"])
def test_op10(spark, data_dir, edge_dir, empty_dir, folder):
    folder = {"data": data_dir, "edge": edge_dir, "empty": empty_dir}[folder]
    texts = documents(spark, folder)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for row in queries.op10_token_counts(spark, folder).collect():
        text = texts[row["doc_id"]]
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 2048), text[:40]


def test_whole_tokens_are_proven():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = sorted(token_counts.whole_tokens(tokenizer))
    for word in random.Random(0).sample(whole, 500):
        assert len(tokenizer.encode(word, add_special_tokens=False).ids) == 1
    assert len(whole) > 10_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tAabthe's1.<|>é́"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_counts_equal_library_anywhere(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = token_counts.piece_counter(path)
    assert counter.count_all(texts) == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tabthe's1.<|>é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_equal_library_anywhere(text):
    encoder = token_files.piece_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert unpack(encoder.encode_all([text])[0]) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_columns_equal_library(spark):
    """Null and empty texts, other spaces, special strings, line feeds, marks, other scripts, in a slice of a longer column."""
    import pyarrow as pa

    encoder = token_files.piece_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["left out", None, "", " ", "a b", " a b ", "a  b", "a\u00a0 b", "a \nb c", "a\n b", "\tb c", f"x {encoder.special[0]} y", f"{encoder.special[0]}"]
    texts += ["It's the end, a.\nWas it?", "Été déjà vu!", "日本 語 text", "don't 'll a.b 12,5 (x)", "w" * 70 + " " + "w" * 70 + ".", "a b", "b a b"]
    ids, counts = encoder.encode_array(pa.array(texts, pa.string()).slice(1))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert [unpack(e) for e in encoder.encode_all(texts[1:])] == want and encoder.encode_all([]) == []
    assert [unpack(encoder.encode(t)) for t in texts[1:]] == want


def test_pieces_in_use_outlive_others(monkeypatch):
    """Where many pieces occur once, those that recur reach the library once; the number kept is bounded."""
    monkeypatch.setattr(token_files, "CACHED_PIECES", 20)
    encoder = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    told, word = [], encoder._word
    monkeypatch.setattr(encoder, "_word", lambda piece, space: told.append(piece) or word(piece, space))
    for i in range(40):
        rare = " ".join("q" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] + c for c in "abcdefghij")
        assert unpack(encoder.encode(f"A often {rare}")) == encoder.tokenizer.encode(f"A often {rare}", add_special_tokens=False).ids
        assert len(encoder.after_space.young) <= 20 and len(encoder.after_space.old) <= 20
    assert told.count("often") == 1 and len(told) == 40 * 10 + 2


def test_slices_keep_rows_in_order():
    import pyarrow as pa

    texts = ["aaaa", None, "bb", "", "c" * 30, "dd", "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    slices = list(token_files._slices(batch, 5))
    assert [i for s in slices for i in s.column(0).to_pylist()] == list(range(7)) and len(slices) > 2


def test_limit_is_a_parameter(spark):
    found = token_counts.count_tokens(as_table(spark, ["one two three"]), public_tokenizers.path("word_bpe_49k.json"), limit=2)
    assert found.where(F.col("over_limit")).count() == 1
