"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed into buckets with an embedding
each; a misspelling shares most n-grams with the word it stands for. Longer words are hashed in
pieces of ``MOST_LETTERS`` letters that overlap, so that each n-gram counts once. A text is cut into
segments of a few words, a segment is the average of its subword embeddings, and a linear
softmax gives its class. Embeddings and softmax are trained together, in numpy. A text is as
toxic as its most toxic segment, so one insult in a long text is not averaged away; a logistic
curve fitted on labelled texts the training did not see turns that maximum into a probability.

Training first takes every segment under its text's label. Then, of toxic texts, it keeps the
segments that stand out, and trains on with these against the segments of clean texts.

* The model is fitted on at most ``TRAIN_ROWS`` labelled ids, one row of each, and ``TRAIN_BYTES``
  characters of their text, in the order of a hash of the id; a text that does not fit the rest is
  passed over. Everything is scored.
* Null texts, empty texts and texts without words score 0. Without labels of both classes
  everything scores 0.
* Labels that are null or whose document is missing are left out; several labels of a document
  count as toxic if one does. Repeated rows are scored one by one.
* Only the id and text columns of documents are read; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import least_hashed, prepare, texts_of, two_columns
from pairloom.sources.staging import staged

TRAIN_ROWS = 6_000
TRAIN_BYTES = 32_000_000
BUCKETS = 1 << 18
WIDTH = 8
SIZES = (3, 4, 5)
SEGMENT = 4
THRESHOLD = 0.3
SEED = 7
LEAST_TEXTS = 3
RATE = 0.5
CACHED_WORDS = 400_000
MOST_LETTERS = 64
_SEAM = max(SIZES) - 1
_FACTOR = np.uint64(0x100000001B3)
_EDGES = ".,;:!?\"'()[]{}<>…»«¡¿"


def words_of(text: str | None) -> list[str]:
    return text.lower().replace(".", " ").replace(",", " ").split() if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, with the ends marked, and of the words themselves; and whose each is.

    Polynomials over code points, computed for all words at once. A word of more than
    ``MOST_LETTERS`` letters has its pieces in place of itself: each starts with the last letters
    of the one before, so that n-grams across a seam are kept, and none counts twice.
    """
    marked, whose, overlap = [], [], []
    for k, w in enumerate(words):
        whole = f"<{w.strip(_EDGES) or w}>"
        marked.append(whole[: MOST_LETTERS + 2])
        whose.append(k)
        overlap.append(0)
        for lo in range(MOST_LETTERS + 2 - _SEAM, len(whole) - _SEAM, MOST_LETTERS + 2 - _SEAM):
            marked.append(whole[lo : lo + MOST_LETTERS + 2])
            whose.append(k)
            overlap.append(_SEAM)
    whose, overlap = np.array(whose, np.int64), np.array(overlap, np.int64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    # Of the letters a piece shares with the one before, n-grams that end there are already counted.
    place = np.repeat(sizes, sizes) - left
    seen = np.repeat(overlap, sizes)
    units, owners = [], []
    for n in SIZES:
        at = np.flatnonzero((left >= n) & (place + n > seen))
        total = np.full(len(at), n, np.uint64)
        for k in range(n):
            total = total * _FACTOR + codes[at + k]
        units.append(total)
        owners.append(owner[at])
    if len(marked):
        powers = _FACTOR ** np.arange(MOST_LETTERS + 2, dtype=np.uint64)
        units.append(np.add.reduceat(codes * powers[left - 1], ends - sizes))
        owners.append(np.arange(len(marked)))
    x = np.concatenate(units)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), whose[np.concatenate(owners)]


@dataclass
class Model:
    """What scoring needs: embeddings only enter through their product with the softmax."""

    unit: np.ndarray  # log-odds of each bucket
    bias: float
    slope: float
    offset: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; what words come to is kept, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def most(self, texts: list[str | None]) -> list[float | None]:
        """Log-odds of each text's most toxic segment; None for a text without words."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words} - self.known.keys())
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            units, owners = subwords(part)
            self.known.update(zip(part, range(len(self.sums), len(self.sums) + len(part))))
            self.sums = np.concatenate((self.sums, np.bincount(owners, weights=self.model.unit[units], minlength=len(part))))
            self.counts = np.concatenate((self.counts, np.bincount(owners, minlength=len(part))))
        found: list[float | None] = []
        for words in split:
            if not words:
                found.append(None)
                continue
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            starts = np.arange(0, len(words), SEGMENT)
            means = np.add.reduceat(self.sums[at], starts) / np.add.reduceat(self.counts[at], starts)
            found.append(float(means.max()) + self.model.bias)
        return found

    def scores(self, texts: list[str | None]) -> list[float]:
        model = self.model
        return [0.0 if m is None else float(_sigmoid(model.slope * m + model.offset)) for m in self.most(texts)]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Segments:
    """Segments of texts as ranges of words, and words as ranges of subwords."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        words, sizes, owner = [], [], []
        for i, text in enumerate(texts):
            own = [index.setdefault(w, len(index)) for w in words_of(text)]
            words.append(np.array(own, np.int32))
            parts = [min(SEGMENT, len(own) - k) for k in range(0, len(own), SEGMENT)]
            sizes += parts
            owner += [i] * len(parts)
        self.words = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.owner = np.array(owner, np.int64)
        units, owners = subwords(list(index)) if index else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(owners, kind="stable")
        self.counts = np.bincount(owners, minlength=len(index))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))[:-1]
        self.units = units[order].astype(np.int32)

    def texts_per_bucket(self) -> np.ndarray:
        """In how many texts each bucket occurs, as far as LEAST_TEXTS matters."""
        owners = np.repeat(self.owner, self.sizes)
        pairs = np.unique(owners * np.int64(len(self.counts)) + self.words)
        texts = np.bincount(pairs % len(self.counts), minlength=len(self.counts))
        return np.bincount(self.units, weights=np.repeat(texts, self.counts), minlength=BUCKETS)

    def gather(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of some segments: where each segment's words are, and the words' subwords."""
        at = _ranges(self.starts[chosen], self.sizes[chosen])
        distinct, inverse = np.unique(self.words[at], return_inverse=True)
        units = self.units[_ranges(self.first[distinct], self.counts[distinct])]
        return inverse, np.repeat(np.arange(len(chosen)), self.sizes[chosen]), units, self.counts[distinct]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Trainer:
    def __init__(self, segments: _Segments, rng: np.random.Generator):
        self.segments, self.rng = segments, rng
        self.table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        self.table[segments.texts_per_bucket() < LEAST_TEXTS] = 0
        self.trained = self.table.any(axis=1)
        self.softmax = rng.normal(0, 1, (2, WIDTH)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = np.full((BUCKETS, 1), 1e-12, np.float32)
        self.seen_softmax = np.full((2, WIDTH), 1e-12, np.float32)

    def forward(self, chosen: np.ndarray):
        inverse, owner, units, counts = self.segments.gather(chosen)
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        words = np.add.reduceat(self.table[units], first, axis=0)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        totals = np.add.reduceat(counts[inverse], starts).astype(np.float32)[:, None]
        means = np.add.reduceat(words[inverse], starts, axis=0) / totals
        return means, totals, inverse, owner, units, counts

    def train(self, chosen: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int, rate: float, batch: int = 4096) -> None:
        for _ in range(epochs):
            order = self.rng.permutation(len(chosen))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                means, totals, inverse, owner, units, counts = self.forward(chosen[rows])
                odds = means @ self.softmax.T + self.bias
                p = np.exp(odds - odds.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), labels[rows]] -= 1
                p *= weights[rows, None] / weights[rows].sum()
                back = (p @ self.softmax) / totals
                side = p.T @ means
                self.seen_softmax += side**2
                self.softmax -= rate / 10 * side / np.sqrt(self.seen_softmax)
                self.bias -= p.sum(axis=0)
                words = np.zeros((len(counts), WIDTH), np.float32)
                for d in range(WIDTH):
                    words[:, d] = np.bincount(inverse, weights=back[owner, d], minlength=len(counts))
                touched, where = np.unique(units, return_inverse=True)
                spread = np.repeat(words, counts, axis=0)
                grad = np.stack([np.bincount(where, weights=spread[:, d], minlength=len(touched)) for d in range(WIDTH)], axis=1)
                grad *= self.trained[touched, None]
                self.seen[touched] += (grad**2).mean(axis=1, keepdims=True).astype(np.float32)
                self.table[touched] -= (rate * grad / np.sqrt(self.seen[touched])).astype(np.float32)

    def odds(self) -> np.ndarray:
        side = self.softmax[1] - self.softmax[0]
        return self.table @ side

    def scores(self) -> np.ndarray:
        found = np.zeros(len(self.segments.sizes))
        side, bias = self.softmax[1] - self.softmax[0], self.bias[1] - self.bias[0]
        for lo in range(0, len(found), 16_384):
            chosen = np.arange(lo, min(lo + 16_384, len(found)))
            found[chosen] = self.forward(chosen)[0] @ side + bias
        return found


def fit(texts: list[str], labels: list[int], seed: int = SEED) -> Model | None:
    """Train on labelled texts; None without both classes."""
    labels = np.array(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.2
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    own = np.flatnonzero(~held)
    segments = _Segments([texts[i] for i in own])
    if not len(segments.owner):
        return None
    text_labels = labels[own]
    y = text_labels[segments.owner]
    trainer = _Trainer(segments, rng)
    positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(positive) or not len(negative):
        return None
    some = np.concatenate((positive, rng.choice(negative, min(len(negative), 2 * len(positive)), replace=False)))
    trainer.train(some, y[some], np.ones(len(some), np.float32), epochs=2, rate=RATE)
    for _ in range(3):
        scores = trainer.scores()
        best = np.full(len(own), -np.inf)
        np.maximum.at(best, segments.owner, scores)
        # Of a toxic text: its best segment, and others nearer to it than to what clean texts reach.
        usual = np.median(best[(text_labels == 0) & np.isfinite(best)])
        kept = positive[(scores[positive] >= best[segments.owner[positive]]) | (scores[positive] > (best[segments.owner[positive]] + usual) / 2)]
        hard = negative[np.argsort(-scores[negative])[: 4 * len(kept)]]
        easy = rng.choice(negative, min(len(negative), 8 * len(kept)), replace=False)
        against = np.unique(np.concatenate((hard, easy)))
        chosen = np.concatenate((kept, against))
        weights = np.where(y[chosen] == 1, len(against) / max(1, len(kept)), 1.0).astype(np.float32)
        trainer.train(chosen, y[chosen], weights, epochs=2, rate=RATE)
    model = Model(trainer.odds().astype(np.float32), float(trainer.bias[1] - trainer.bias[0]), 1.0, 0.0)
    fitted = np.flatnonzero(held) if held.any() else own
    scorer = model.scorer()
    most = scorer.most([texts[i] for i in fitted])
    usable = [i for i, m in enumerate(most) if m is not None]
    model.slope, model.offset = _logistic(np.array([most[i] for i in usable]), labels[fitted][usable])
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly regularised logistic curve, by Newton's method."""
    centre, spread = x.mean(), x.std() or 1.0
    design = np.stack(((x - centre) / spread, np.ones(len(x))), axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(design @ w)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 0.5
        w += np.linalg.solve(hessian, design.T @ (y - p) - 0.5 * w)
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """``(text, label, place)`` of at most ``rows`` labelled ids, the first by a hash; one row of each id."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    own = own.where(allowed).groupBy("id").agg(F.max("label").alias("label"))
    own = own.withColumn("place", F.xxhash64("id", F.lit(SEED)))
    own = least_hashed(own, "place", rows).orderBy("place", "id").limit(rows)
    found = two_columns(docs, id_col, text_col).join(F.broadcast(own), "id").withColumn("text", F.coalesce("text", F.lit("")))
    one = found.groupBy("id", "label", "place").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return one.select("one.text", "label", "place")


def within_budget(sample: DataFrame, most: int) -> tuple[list[str], list[int]]:
    """Texts and labels of a sample in the order of its places, without rows that do not fit the rest of ``most`` characters.

    Lengths decide before any text comes to the driver.
    """
    sample = staged(sample.withColumn("size", F.length("text")), "sample")
    size, places, left_out = 0, [], False
    for row in sample.select("place", "size").orderBy("place", "size").collect():
        if size + row["size"] <= most:
            size += row["size"]
            places.append(row["place"])
        else:
            left_out = True
    if left_out:
        sample = sample.where(F.col("place").isin(places))
    taken = sorted((row["text"], row["label"]) for row in sample.select("text", "label").toLocalIterator())
    return [t for t, _ in taken], [y for _, y in taken]


def fit_on(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = TRAIN_ROWS,
    most_bytes: int = TRAIN_BYTES,
) -> Model | None:
    """Fit on a bounded sample; ``allowed`` is a condition on ``id``."""
    prepare(docs.sparkSession)
    sample = training_rows(docs, labels, F.lit(True) if allowed is None else allowed, id_col, text_col, label_col, rows)
    return fit(*within_budget(sample, most_bytes))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        scorer = fitted.scorer() if fitted else None
        for batch in batches:
            texts = texts_of(batch)
            scores = scorer.scores(texts) if scorer else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, score, predicted)`` of every row. The model, 1 MB for any input, goes to all tasks."""
    spark = prepare(docs.sparkSession)
    rows = two_columns(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
