"""Packing against all packings of few pieces, the library's ids and whole sequences."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), len(items)

    def place(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def held(fillings) -> Counter:
    total: Counter = Counter()
    for filling, times in fillings:
        for length, each in filling:
            total[length] += each * times
    return total


@settings(max_examples=400, deadline=None)
@given(st.sampled_from([10, 12, 20, 31, 100]), st.lists(st.integers(1, 70), min_size=1, max_size=10))
def test_fewest_sequences(capacity, items):
    items = [min(x, capacity) for x in items]
    counts = Counter(items)
    fillings = packing.complete(counts, capacity)
    assert held(fillings) == counts
    assert all(sum(x * n for x, n in f) <= capacity for f, _ in fillings)
    best = fewest(items, capacity)
    assert sum(n for _, n in fillings) == best >= packing.least_sequences(counts, capacity)


def test_completion_improves_best_fit():
    rng = random.Random(4)
    counts = {x: rng.randint(0, 40) for x in range(500, 1000)}
    one = sum(n for _, n in packing.best_fit(counts, 2048))
    more = packing.complete(counts, 2048, nodes=300)
    assert sum(n for _, n in more) < one and held(more) == {x: n for x, n in counts.items() if n}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_best_fit_by_counts_is_best_fit_one_by_one(items):
    rooms: list[int] = []
    for x in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= x]
        room = min(fit) if fit else 30
        if fit:
            rooms.remove(room)
        rooms.append(room - x)
    assert sum(n for _, n in packing.best_fit(Counter(items), 30)) == len(rooms)


def test_large_counts_need_no_more_work():
    counts = {x: 1_000_000_007 for x in (2048, 1500, 700, 548, 300, 1)}
    fillings = packing.complete(counts, 2048)
    assert held(fillings) == counts and len(fillings) < 100


@pytest.mark.parametrize("n, expected", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (24, [(0, 8), (8, 8), (16, 8)])])
def test_cuts(n, expected):
    assert packing.cuts(n, 8) == expected


TEXTS = ["plain words, don't stop", "", None, " lead\n\n  and trail  ", "é ü ɏ", "Ωmega жизнь 漢字 \U0001f600", "a<|endoftext|>b", "x" * 900, "word " * 4000, "tab\tand\x0bfeed\r\n1234567"]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aB1 's\n\t<|>é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_equals_the_library(text):
    encoder = packing.text_encoder(PATH)
    assert encoder.ranked is not None
    assert encoder.encode(text).tolist() == encoder.library.tokenizer.encode(text, add_special_tokens=False).ids


ODD = ["a", "B", "don", "'t", "'s", "'", "1", "22", ",", "!", "x" * 30, "é", "ɏ", "ɐ", "Ω", "²", "ª", "\u0301", "\x00", "<|endoftext|>"]
GAPS = [" "] * 6 + ["  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ODD + GAPS + [" "] * 8), max_size=14).map("".join)), min_size=1, max_size=8))
def test_columns_equal_the_library(texts):
    encoder = packing.text_encoder(PATH)
    expected = [encoder.library.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        ids, counts = encoder.encode_array(pa.array(texts, kind))
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == expected


def test_columns_of_long_texts_and_of_unproven_files(monkeypatch):
    encoder = packing.TextEncoder(PATH)
    expected = [encoder.library.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    monkeypatch.setattr(packing, "SLICE_BYTES", 30)
    for _ in range(2):
        ids, counts = encoder.encode_array(pa.array(TEXTS, pa.string()))
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == expected
        encoder.ranked = None


def test_recurring_pieces_are_merged_once():
    """every occurrence went through the merges."""
    encoder = packing.TextEncoder(PATH)
    given_, ranked = [], encoder.ranked

    class Counting:
        def encode_to_numpy(self, text, **options):
            given_.append(text)
            return ranked.encode_to_numpy(text, **options)

    encoder.ranked = Counting()
    _, counts = encoder.encode_array(pa.array(["some recurring words, " * 500 + "end"] * 20))
    assert len(counts) == 20 and sum(map(len, given_)) < 200


def test_pieces_are_read_once_where_lengths_are_counted_apart(spark):
    """checksums were taken for the counts, too."""
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(40)], "doc_id long, text string")
    pieces = packing.cut_into_pieces(docs, PATH, capacity=16)
    read = spark.sparkContext.accumulator(0)

    def reading(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    packed = packing.place(pieces.mapInArrow(reading, pieces.schema), capacity=16, counted=pieces).collect()
    assert len(packed) == read.value == 40


def test_packed_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id", "x"), (None, None, "x")] + [(i, TEXTS[0], "x") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for _, t, _ in rows]
    packed = packing.pack_documents(docs, PATH, capacity=256).collect()
    assert Counter((r["id"], r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tobytes()) for r in packed) == Counter(
        (doc, k, start, np.array(own[start : start + n], "<u4").tobytes()) for (doc, _, _), own in zip(rows, ids) for k, (start, n) in enumerate(packing.cuts(len(own), 256))
    )
    places: dict[int, list] = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256
    assert len(places) <= -(-sum(map(len, ids)) // 256) + 1


def test_whole_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(40)], "doc_id long, text string")
    # Read twice, so the pieces keep their places only because they are staged.
    packed = packing.pack_documents(docs, PATH, end_id=9, capacity=16)
    whole = packing.sequences(packed).collect()
    assert sorted(i for r in whole for i in r["doc_ids"]) == list(range(40))
    assert all(4 * r["n_tokens"] == len(r["ids"]) <= 64 and r["ids"][-4:] == b"\x09\0\0\0" for r in whole)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PATH).count() == 0


def test_op11(spark, data_dir):
    found = queries.op11_packing(spark, data_dir).toPandas()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    library = Tokenizer.from_file(PATH)
    for doc, own in found.sort_values("piece").groupby("doc_id"):
        ids = np.array([*library.encode(docs[doc], add_special_tokens=False).ids, 0], "<u4")
        assert list(zip(own["start"], own["length"])) == packing.cuts(len(ids))
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in packing.cuts(len(ids))] == own["ids_crc32"].tolist()
    assert found["doc_id"].nunique() == len(docs)
    assert found.groupby("sequence_id")["length"].sum().max() <= 2048
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 2048) + 2
