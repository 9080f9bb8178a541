"""The Jaccard join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import jaccard_join as jj


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, n, percent):
    sets = [shingle_set(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(docs)]


def corpus(seed, groups=12, copies=12):
    """Groups of near copies of many lengths, edited once or more, with passages in common."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [rng.choices(vocabulary, k=15) for _ in range(2)]
    docs = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 8, 12, 20, 40, 70, 160]))
        if g % 3 == 0:
            base = base + passages[0]
        if g % 4 == 0:
            base = passages[1] + base
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), rng.choice([" ", "\n", "\t "]).join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    docs += [(900, None), (901, ""), (902, " \n"), (None, docs[0][1]), (None, "alone here"), (3, docs[3][1]), (3, docs[3][1]), (950, "é a b c"), (951, "é A B C")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(
    "seed,n,percent,frequent,crowd,broadcast",
    [(1, 4, 85, 3, 2_048, 10**6), (2, 4, 85, 10_000, 4, 10**6), (3, 5, 80, 3, 4, 0), (4, 4, 85, 8, 6, 0)],
)
def test_components_equal_all_pairs(spark, seed, n, percent, frequent, crowd, broadcast, monkeypatch):
    """The same whatever counts as frequent or crowded, and whether wanted texts are chosen by a broadcast or a join."""
    monkeypatch.setattr(jj, "FREQUENT", frequent)
    monkeypatch.setattr(jj, "CHUNK_COUNT", 2)
    monkeypatch.setattr(jj, "CROWD", crowd)
    monkeypatch.setattr(jj, "BROADCAST_CLASSES", broadcast)
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, class string")
    found = [tuple(r) for r in jj.similar_components(df, n=n, percent=percent).collect()]
    assert sorted(found, key=repr) == sorted(brute(docs, n, percent), key=repr)


def test_empty_table(spark):
    assert jj.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def meetings(x, y, frequent, percent=85):
    """Banded signatures under which two sets are compared."""
    a, b = (dict(zip(*(v.tolist() for v in jj.banded_signatures(s, frequent, percent)))) for s in (x, y))
    return {sig for sig in a.keys() & b.keys() if a[sig] == b[sig] == 0 or a[sig] + b[sig] == 3}


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        size = int(rng.integers(1, 300))
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        other = base.copy()
        change = int(rng.integers(0, max(1, size // 5) + 1))
        other[:change] = rng.integers(0, 2**63, change).astype(np.uint64)
        x, y = np.unique(base), np.unique(other[: size - int(rng.integers(0, size // 8 + 1))])
        both = len(np.intersect1d(x, y))
        if np.array_equal(x, y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        frequent = np.sort(rng.choice(x, int(rng.integers(0, len(x) + 1)), replace=False))
        a, b = jj.signatures(x, frequent, percent)[0], jj.signatures(y, frequent, percent)[0]
        assert len(np.intersect1d(a, b)), (size, len(x), len(y), both, len(frequent))
        assert meetings(x, y, frequent, percent), (size, len(x), len(y), both, len(frequent))
        common = np.minimum(jj.outline(x), jj.outline(y)).sum()
        assert common >= both


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(300, 400)] + [(7, 6), (6, 7)]
    found = dict(map(tuple, jj.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[k] == 5 for k in range(300, 400)) and found[7] == found[6] == 6
    assert jj.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_of_a_large_signature(spark, monkeypatch):
    """Classes beyond a block still meet, each pair once, whatever the blocks."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    rows = []
    for c in range(90):
        found = np.unique(np.concatenate((base[rng.random(60) < 0.97], rng.integers(0, 2**63, 2).astype(np.uint64))))
        rows.append((1, int(c), len(found), int(c), found))
    expected = {
        (a[1], b[1])
        for a in rows
        for b in rows
        if a[1] > b[1] and 100 * (k := int(np.minimum(jj.outline(a[4]), jj.outline(b[4])).sum())) >= 85 * (a[2] + b[2] - k)
    }
    for blocks in (1, 4):
        keyed = []
        for sig, c, n, root, found in rows:
            for other in range(blocks):
                own = c % blocks
                keyed.append((sig, min(own, other), max(own, other), own, c, n, root, jj.outline(found).tobytes()))
        df = spark.createDataFrame(keyed, "sig long, lo long, hi long, own long, class long, n long, root long, cells binary")
        near = df.repartition(3, "sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").mapInArrow(jj._near(85), "a bigint, b bigint").distinct()
        assert {tuple(r) for r in near.collect()} == expected


def near_pairs(spark, rows, blocks=1):
    keyed = [(1, min(c % blocks, o), max(c % blocks, o), c % blocks, c, len(f), c, jj.outline(f).tobytes()) for c, f in rows for o in range(blocks)]
    df = spark.createDataFrame(keyed, "sig long, lo long, hi long, own long, class long, n long, root long, cells binary")
    near = df.repartition(3, "sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").mapInArrow(jj._near(85), "a bigint, b bigint").distinct()
    return {tuple(r) for r in near.collect()}


@pytest.mark.parametrize("small, large", [(90_865, 106_900), (91_205, 107_300), (374_595, 440_700)])
def test_large_sets_at_the_threshold(spark, small, large):
    """A subset of exactly 85 % links, however large the sets and however many classes a signature has."""
    rng = np.random.default_rng(small)
    whole = np.unique(rng.integers(0, 2**63, large + 1000).astype(np.uint64))[:large]
    rows = [(0, whole), (1, rng.permutation(whole)[:small]), (2, rng.permutation(whole)[: small - 1])]
    assert 100 * small == 85 * large
    rows += [(c, rng.integers(0, 2**63, 40).astype(np.uint64)) for c in range(3, 73)]
    for blocks in (1, 2):
        found = near_pairs(spark, rows, blocks)
        assert (1, 0) in found
        # What the cells cannot rule out is verified later; a subset one smaller they do rule out.
        assert (2, 0) not in found


def test_cells_beyond_the_products(spark):
    """Counts above the levels that products cover are added up exactly."""
    rng = np.random.default_rng(9)
    rows = [(c, rng.integers(0, 2**63, int(rng.integers(3_000, 12_000))).astype(np.uint64)) for c in range(70)]
    rows += [(100 + c, np.concatenate((f[: int(0.9 * len(f))], rng.integers(0, 2**63, 100).astype(np.uint64)))) for c, f in rows[:20]]
    cells = {c: jj.outline(f).astype(np.int64) for c, f in rows}
    sizes = {c: len(f) for c, f in rows}
    expected = {(a, b) for a in cells for b in cells if a > b and 100 * (k := int(np.minimum(cells[a], cells[b]).sum())) >= 85 * (sizes[a] + sizes[b] - k)}
    assert near_pairs(spark, rows) == expected


def test_partner_bands():
    """Every size a set may link with lies in one of its bands, and each sees the other."""
    for size in [*range(6, 400), 5_000, 90_865, 1_000_003]:
        bands = jj.partner_bands(size, 85)
        least, most = jj.least_common(size, 85), 100 * size // 85
        assert bands[0][1] == least and all(low <= most for _, low in bands)
        edges = [*(low for _, low in bands), most + 1]
        assert edges == sorted(set(edges))
        for low, high in zip(edges, edges[1:]):
            for other in {low, high - 1}:
                assert size in range(jj.least_common(other, 85), 100 * other // 85 + 1)


def test_sets_of_a_shared_passage_meet_only_where_they_may_link():
    """Sets of one size that share too little to link have no pairs of the passage's shingles as signatures."""
    rng = np.random.default_rng(4)
    passage = np.unique(rng.integers(0, 2**63, 180).astype(np.uint64))

    def with_own(k):
        return np.unique(np.concatenate((passage, rng.integers(0, 2**63, k).astype(np.uint64))))

    far, near = [with_own(22) for _ in range(2)], [with_own(12) for _ in range(2)]
    assert len(np.intersect1d(*(jj.signatures(x, passage)[0] for x in far)))
    assert not meetings(*far, passage) and meetings(*near, passage)


@pytest.mark.parametrize("block, crowd, few", [(3, 1_000_000, 64), (3, 4, 2), (40, 1_000_000, 64)])
def test_components_of_a_shared_passage(spark, block, crowd, few, monkeypatch):
    """Signatures of more classes than a block are indexed again; the components stay those of all pairs."""
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "FEW", few)
    monkeypatch.setattr(jj, "CROWD", crowd)
    monkeypatch.setattr(jj, "FREQUENT", 4)
    monkeypatch.setattr(jj, "CHUNK_COUNT", 2)
    rng = np.random.default_rng(block)
    passage = " ".join(f"p{k}" for k in range(120))
    docs = []
    for group in range(30):
        own = [f"w{group}x{k}" for k in range(int(rng.integers(4, 40)))]
        for copy in range(int(rng.integers(1, 4))):
            words = [w if rng.random() > 0.02 else f"c{group}x{copy}x{k}" for k, w in enumerate(own)]
            docs.append((len(docs), passage + " " + " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = [tuple(r) for r in jj.similar_components(df).collect()]
    assert sorted(found) == sorted(brute(docs, 4, 85))
    assert 1 < len({c for _, _, c in found}) < len(docs)


def test_crowded_signatures(spark, monkeypatch):
    """Counts within tasks find them, and their rows get the same aggregates as in a window."""
    monkeypatch.setattr(jj, "CROWD", 10)
    rows = [(1, c, 5, 2) for c in range(40)] + [(2, c, 6, 1) for c in range(3)] + [(1, None, 8, None), (1, None, 4, None), (2, None, 9, None)]
    signed = spark.createDataFrame(rows, "sig long, class long, n long, rare long")
    crowded = jj._crowded(signed)
    assert [r["sig"] for r in crowded.collect()] == [1]
    known = {"low": F.min("class"), "high": F.max("class"), "rows": F.count(F.lit(1)), "rep": F.min(F.struct("rare", "class", "n"))}
    found = jj._by_signature(signed.where("class is not null"), crowded, known)
    assert {(r["sig"], r["low"], r["high"], r["rows"], r["rep"]["class"]) for r in found.collect()} == {(1, 0, 39, 40, 0), (2, 0, 2, 3, 0)}
    assert found.count() == 43


@pytest.mark.parametrize("most, expected", [(0, set()), (2, {1, 2}), (3, {1, 2, 3}), (4, {1, 2, 3}), (100, {1, 2, 3, 4, 5, 6})])
def test_most_frequent(spark, most, expected):
    counts = spark.createDataFrame([(1, 1000), (2, 900), (3, 64), (4, 2), (5, 2), (6, 2), (7, None)], "term long, n long")
    assert {r["term"] for r in jj.most_frequent(counts, "n", most).collect()} == expected
