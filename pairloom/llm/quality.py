"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

A logistic model over binned text statistics gives each document a probability of being good.
Sites are two levels: hosts, and paths within hosts. The probabilities of a host's documents,
summed, update a beta prior centred on the global mean; those of a path update a prior centred
on its host's posterior. The strength of each prior is estimated from the spread of the sites'
means beyond what their sizes explain (method of moments), so sparse sites shrink to the level
above and large sites speak for themselves. A document's final odds are its own, moved by how
far its path's posterior lies from the global mean, where the document itself is left out of
its path and host.

For a table of web pages ``with_address`` appends host and path of the address; ``documents`` has a
source and, within it, languages, which are the two levels used by default.

* Null texts count as empty; an empty text has no words and scores 0: it is rejected.
* Null hosts and paths are sites of their own. Without labels of both classes every text with
  words keeps the neutral evidence of 0.5 and only sites speak; an empty table gives no rows.
* The model is fitted on at most ``TRAIN_ROWS`` labelled ids, one row of each, and ``TRAIN_BYTES``
  characters of their text, in the order of a hash of the id; a text that does not fit the rest is
  passed over. Site statistics cover all documents.
* Sums per site are combined on the map side, so a host with a third of all rows is a few rows
  in the shuffle. Site tables are sent to all tasks up to ``BROADCAST_SITES`` rows, else joined.
* Repeated rows are scored one by one; columns of any names stay as they are in ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import fresh, hold, nothing_kept, prepare, texts_of
from pairloom.llm.toxicity import training_rows, within_budget
from pairloom.sources.staging import staged

TRAIN_ROWS = 8_000
TRAIN_BYTES = 32_000_000
BINS = 8
WINDOW = 40
THRESHOLD = 0.5
BROADCAST_SITES = 100_000
MOST_STRENGTH = 1e6
WEIGHT = 1.0
PATH_PARTS = 1
FEATURES = ("words", "word_length", "upper", "symbols", "digits", "marks", "distinct", "repeats", "lines", "line_repeats", "short")


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, each independent of its length but the first."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = text.encode()
    size = len(text)
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    symbols = sum(map(data.count, (b"#", b"$", b"%", b"&", b"*", b"@", b"|", b"<", b">", b"{", b"}", b"=", b"~", b"^", b"\\", b"_", b"+"))) / size
    digits = (len(data) - len(data.translate(None, b"0123456789"))) / size
    marks = (data.count(b"!") + data.count(b"?")) / n
    distinct = sum(len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW)) / n
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    lines = text.split("\n")
    return [
        math.log1p(n), size / n, upper, symbols, digits, marks, distinct, repeats,
        math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(len(w) < 3 for w in words) / n,
    ]


@dataclass
class Model:
    """Additive over bins of each statistic."""

    edges: list[np.ndarray]
    weights: np.ndarray

    def design(self, rows: np.ndarray) -> np.ndarray:
        columns = [np.ones((len(rows), 1))]
        for k, edges in enumerate(self.edges):
            columns.append((np.searchsorted(edges, rows[:, k], side="right")[:, None] == np.arange(len(edges) + 1)[None, :]).astype(float))
        return np.concatenate(columns, axis=1)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(rows) @ self.weights, -30, 30)))


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """Penalised logistic regression by Newton's method; None without both classes."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    rows = np.array([features(t) for t in texts])
    # Bins at quantiles of either class, so that a rare class has bins of its own.
    edges = [
        np.unique(np.concatenate([np.quantile(rows[y == c, k], np.linspace(0, 1, BINS + 1)[1:-1]) for c in (0, 1)])) for k in range(rows.shape[1])
    ]
    model = Model(edges, np.zeros(1))
    design = model.design(rows)
    w = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(len(w)), gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def fit_on(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES
) -> Model | None:
    """Fit on a bounded sample of labelled rows."""
    prepare(docs.sparkSession)
    return fit(*within_budget(training_rows(docs, labels, F.lit(True), id_col, text_col, label_col, rows), most_bytes))


def _with_evidence(model, text_col: str):
    """Append the classifier's probability to every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality", nothing_kept)
        fitted = model.value
        for batch in batches:
            texts = texts_of(batch, text_col)
            filled = np.array([bool(t and not t.isspace()) for t in texts], bool)
            p = np.full(len(texts), 0.5)
            if fitted and len(texts):
                p = fitted.probabilities(np.array([features(t) for t in texts]))
            p = np.where(filled, np.clip(p, 1e-6, 1 - 1e-6), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "evidence"])

    return run


def _strength(stats: DataFrame, mean: str) -> float:
    """Beta prior strength from sites ``(n, s)`` and the mean above them, by moments.

    The variance of site means is the level's own variance plus what the sites' sizes explain.
    """
    m = F.col(mean)
    own = (F.col("s") / F.col("n") - m) ** 2 - m * (1 - m) / F.col("n")
    row = stats.where("n > 1").agg(F.sum(F.col("n") * own), F.sum("n"), F.sum(F.col("n") * m * (1 - m))).first()
    if not row[1]:
        return MOST_STRENGTH
    between, within = max(row[0] / row[1], 0.0), row[2] / row[1]
    return min(MOST_STRENGTH, max(1.0, within / between - 1)) if between > 0 else MOST_STRENGTH


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Sums of ``(host, path, evidence)`` per path and host, and the global mean and prior strengths."""
    paths = staged(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    mean = min(max((total[1] or 0) / (total[0] or 1), 1e-4), 1 - 1e-4)
    host_strength = _strength(hosts.selectExpr("host_n as n", "host_s as s").withColumn("m", F.lit(mean)), "m")
    joined = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_n", "host_s")
    posterior = (F.col("host_s") + host_strength * mean) / (F.col("host_n") + host_strength)
    path_strength = _strength(joined.withColumn("m", posterior), "m")
    return joined, {"mean": mean, "host": host_strength, "path": path_strength}


def _odds(p):
    return F.log(p / (1 - p))


def _scored(docs: DataFrame, model: Model | None, text_col: str, host_col: str, path_col: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows with evidence, posteriors and score appended, under names given in the dict."""
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    text = docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in text.schema]
    evidence = text.mapInArrow(_with_evidence(held, "text"), f"{', '.join(kinds)}, evidence double").drop("text")
    sites, prior = site_posteriors(evidence)
    sites = staged(sites, "sites")
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)

    names = {}
    for base in ("evidence", "host_posterior", "path_posterior", "score"):
        names[base] = fresh([*docs.columns, *names.values()], base)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    rows = docs.mapInArrow(_with_evidence(held, text_col), f"{', '.join(fields)}, `{names['evidence']}` double")
    own = F.col(f"d.`{names['evidence']}`")
    host = (F.col("s.host_s") - own + prior["host"] * prior["mean"]) / (F.col("s.host_n") - 1 + prior["host"])
    path = (F.col("s.s") - own + prior["path"] * host) / (F.col("s.n") - 1 + prior["path"])
    host, path = (F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)) for p in (host, path))
    odds = _odds(own) + WEIGHT * (_odds(path) - math.log(prior["mean"] / (1 - prior["mean"])))
    score = F.when(own > 0, 1 / (1 + F.exp(-odds))).otherwise(0.0)
    on = F.col(f"d.`{host_col}`").eqNullSafe(F.col("s.host")) & F.col(f"d.`{path_col}`").eqNullSafe(F.col("s.path"))
    found = rows.alias("d").join(sites.alias("s"), on, "left").select(
        *(F.col(f"d.`{c}`") for c in docs.columns),
        own.alias(names["evidence"]), host.alias(names["host_posterior"]), path.alias(names["path_posterior"]), score.alias(names["score"]),
    )
    return found, names


def with_address(pages: DataFrame, url_col: str = "url", parts: int = PATH_PARTS) -> DataFrame:
    """The rows with ``host``, lower-cased, and ``path``, the first ``parts`` folders or names of the address, appended.

    Addresses that are null or cannot be read have neither. Existing columns of these names are refused.
    """
    if taken := {"host", "path"} & {c.lower() for c in pages.columns}:
        raise ValueError(f"the table already has {sorted(taken)}")
    url = F.col(url_col)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    names = F.filter(F.split(path, "/"), lambda name: name != "")
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return pages.withColumns({"host": host, "path": F.when(host.isNotNull(), F.concat(F.lit("/"), F.array_join(F.slice(names, 1, parts), "/")))})


def score_quality(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id, evidence, host_posterior, path_posterior, score, keep)`` of every row."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    found, names = _scored(own, model, "text", "host", "path")
    return found.select("id", *names.values()).withColumn("keep", F.col(names["score"]) >= threshold)


def keep_good(
    docs: DataFrame, model: Model | None, text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of good documents, with their columns as they are."""
    found, names = _scored(docs, model, text_col, host_col, path_col)
    return found.where(F.col(names["score"]) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
