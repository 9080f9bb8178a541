"""Personal data: exact patterns, and terms that corpus co-occurrence shows to reveal them.

Patterns find the protected entities (email, ip, card, phone). What else gives an entity away
is estimated from the corpus: for a term met near an entity, its pointwise mutual information
with the entity, relative to the entity's own information, is the share of the entity that the
term discloses. A term that appears only with one person's address discloses all of it (1); a
word used everywhere discloses nothing. Terms that share documents with the same entity in enough
different contexts, with a share above ``GENERALISE``, are replaced by a general label; above
``REMOVE``, they are removed: wherever they stand, in all texts, near an entity or not.

* Term and entity meet in a document, at any distance. Support counts different contexts, so that
  copies of a document support nothing: the ``REACH`` words on each side of the term, all its
  places in a document being one context, or those on each side of an entity that has the term
  among them. Either kind suffices.
* Document frequencies of terms and entities cover all documents, repeated rows among them, and
  all their words outside entities. Words are runs of letters and digits of any length. Pairs are left out early only where the frequencies rule the share out.
* Up to ``BROADCAST_TERMS`` terms of ``BROADCAST_BYTES`` go to all tasks; more are joined to the
  places of all words.
* Offsets are code points, end exclusive. Patterns match leftmost and without overlap, each
  kind by itself; matches failing a check (ip parts, Luhn, digits) are dropped without retry.
* Null and empty texts hold nothing. Repeated rows are found one by one. Rows without an id,
  and rows sharing one, are told apart by their texts.
* Other columns are left as they are by ``sanitise`` and ignored by ``find_personal_data``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import fresh, hold, most_frequent, nothing_kept, prepare, texts_of
from pairloom.sources.staging import staged

KINDS = ("email", "ip", "card", "phone")
REACH = 8
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
FLUSH_TERMS = 200_000
FLUSH_PAIRS = 100_000
COMMON_TERMS = 50_000
BROADCAST_TERMS = 100_000
BROADCAST_BYTES = 4_000_000

# What the patterns are made of.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign: the longest local part before it and the longest domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start, step = at, 64
        while start > done:
            head = text[max(done, start - step) : start]
            left = len(head.rstrip(_LOCAL))
            start -= len(head) - left
            if left:
                break
            step *= 2
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the patterns, by kind and then start."""
    if not text:
        return []
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def _entity(kind: str, value: str) -> int:
    """One number for all spellings of an entity."""
    plain = value.lower() if kind in ("email", "ip") else "".join(filter(str.isdigit, value))
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}") - (1 << 63)


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def free_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``(term, start, end)`` of the words outside all spans."""
    taken = sorted((a, b) for _, a, b in spans)
    free, i, covered = [], 0, 0
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            covered = max(covered, taken[i][1])
            i += 1
        if m.start() >= covered:
            free.append((m[0].lower(), *m.span()))
    return free


def entity_windows(text: str, spans: list[tuple[str, int, int]], free: list[tuple[str, int, int]], reach: int) -> Iterator[tuple[int, int, list[str]]]:
    """``(entity, context, terms)`` of each span: the words around it."""
    starts = [s for _, s, _ in free]
    for kind, a, b in spans:
        before, after = bisect_left(starts, a), bisect_left(starts, b)
        words = [w for w, _, _ in free[max(0, before - reach) : before] + free[after : after + reach]]
        yield _entity(kind, text[a:b]), _hash(" ".join(words)), words


def term_contexts(free: list[tuple[str, int, int]], wanted: set[str], reach: int) -> dict[str, int]:
    """One number for the words around all places of each wanted term."""
    words = [w for w, _, _ in free]
    found: dict[str, int] = {}
    for i, w in enumerate(words):
        if w in wanted:
            around = _hash(" ".join(words[max(0, i - reach) : i + reach + 1]))
            found[w] = (found.get(w, 0) * 31 + around) & 0x7FFFFFFFFFFFFFFF
    return found


def _entities(reach: int, support: int):
    """Each row's entities, with the first ``support`` different contexts of each; more change nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii", nothing_kept)
        for batch in batches:
            at, entities, contexts = [], [], []
            for i, text in enumerate(texts_of(batch)):
                spans = base_spans(text)
                if not spans:
                    continue
                own: dict[int, set[int]] = {}
                for entity, context, _ in entity_windows(text, spans, free_words(text, spans), reach):
                    met = own.setdefault(entity, set())
                    if len(met) < support:
                        met.add(context)
                at += [i] * len(own)
                entities += own
                contexts += map(list, own.values())
            place = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(place), batch.column(1).take(place), pa.array(entities, pa.int64()), pa.array(contexts, pa.list_(pa.int64()))],
                names=["id", "h", "entity", "contexts"],
            )

    return run


def _with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([bool(base_spans(t)) for t in texts_of(batch)], pa.bool_()))


def _pairs(docs: int, common, reach: int, support: int, threshold: float):
    """``(entity, term, with_entity, both, near, far)`` summed within the task; of contexts, as many as matter.

    A share of ``threshold`` needs ``with_term <= docs * (with_entity / docs) ** threshold``, as
    the two meet in no more documents than hold the entity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii", nothing_kept)
        frequent = common.value
        pairs: dict[tuple[int, str], list] = {}
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))

        def rows() -> pa.RecordBatch:
            made = [(e, w, n, d, list(near), list(far)) for (e, w), (n, d, near, far) in pairs.items()]
            pairs.clear()
            columns = list(zip(*made)) if made else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["entity", "term", "with_entity", "both", "near", "far"])

        for batch in batches:
            for text, own in zip(texts_of(batch), batch.column(batch.schema.get_field_index("entities")).to_pylist()):
                spans = base_spans(text)
                free = free_words(text, spans)
                most = {e["entity"]: docs * (e["with_entity"] / docs) ** threshold * (1 + 1e-9) for e in own}
                least = max(most.values())
                far = term_contexts(free, {w for w, _, _ in free if frequent.get(w, 0) <= least}, reach)
                near: dict[tuple[int, str], set[int]] = {}
                for entity, context, words in entity_windows(text, spans, free, reach):
                    if entity in most:
                        for w in words:
                            near.setdefault((entity, w), set()).add(context)
                for e in own:
                    entity = e["entity"]
                    for w, context in far.items():
                        if frequent.get(w, 0) > most[entity]:
                            continue
                        pair = pairs.setdefault((entity, w), [e["with_entity"], 0, set(), set()])
                        pair[1] += 1
                        if len(pair[2]) < support:
                            pair[2].update(near.get((entity, w), ()))
                        if len(pair[3]) < support:
                            pair[3].add(context)
                    if len(pairs) > FLUSH_PAIRS:
                        yield rows()
        yield rows()

    return run


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of all words, summed within the task and let go at a bound."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for text in texts_of(batch):
            if text:
                spans = base_spans(text)
                words = (w for w, _, _ in free_words(text, spans)) if spans else map(str.lower, set(_WORD.findall(text)))
                counts.update(set(words))
                if len(counts) > FLUSH_TERMS:
                    yield rows()
    yield rows()


def disclosing_terms(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, threshold: float = GENERALISE) -> tuple[DataFrame, dict[str, int]] | None:
    """``(term, share)`` of terms that give away ``threshold`` of some entity's information; None if no entity has support.

    ``docs`` are ``(id, h, text)``. Of several entities, the share is the largest. Also the most
    frequent words, with their document counts.
    """
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    met = staged(docs.mapInArrow(_entities(reach, support), f"id {kind}, h bigint, entity bigint, contexts array<bigint>"), "entities")
    texts = met.select("entity", "h").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("texts"))
    contexts = met.select("entity", F.explode("contexts").alias("context")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("contexts"))
    entities = met.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")).join(texts, "entity").join(contexts, "entity")
    entities = staged(entities.where(F.greatest("texts", "contexts") >= support).select("entity", "with_entity"), "supported")
    if entities.isEmpty():
        return None

    n = docs.count()
    terms = docs.mapInArrow(_document_terms, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("with_term"))
    terms = staged(terms, "terms")
    rows = most_frequent(terms.where(F.col("with_term") > n ** (1 - threshold)), "with_term", COMMON_TERMS).collect()
    common = {r["term"]: r["with_term"] for r in rows}

    # Each row that holds such entities, with them; copies of a row are rows of their own.
    own = met.select("id", "h", "entity").distinct().join(entities, "entity").groupBy("id", "h")
    own = own.agg(F.collect_list(F.struct("entity", "with_entity")).alias("entities"))
    holding = docs.mapInArrow(_with_spans, docs.schema).alias("a").join(own.alias("b"), _same_row()).select("a.text", "b.entities")
    fields = "entity bigint, term string, with_entity bigint, both bigint, near array<bigint>, far array<bigint>"
    pairs = holding.mapInArrow(_pairs(n, spark.sparkContext.broadcast(common), reach, support, threshold), fields)

    def different(name):
        return F.size(F.array_distinct(F.flatten(F.collect_list(name))))

    pairs = pairs.groupBy("entity", "term").agg(
        F.first("with_entity").alias("with_entity"), F.sum("both").alias("both"), F.greatest(different("near"), different("far")).alias("contexts")
    )
    joined = pairs.where(F.col("contexts") >= support).join(terms, "term").withColumn("docs", F.lit(n))
    information = F.log2(F.col("docs") / F.col("with_entity"))
    mutual = F.log2(F.col("both") * F.col("docs") / (F.col("with_entity") * F.col("with_term")))
    shares = joined.where(information > 0).select("term", (mutual / information).alias("share")).where(F.col("share") >= threshold)
    return staged(shares.groupBy("term").agg(F.max("share").alias("share")), "telling"), common


def places(text: str | None, shares: dict[str, float], spans: list[tuple[str, int, int]]) -> list[dict]:
    """``start, end, share`` of all places of some terms outside the spans."""
    if not text or not shares or not any(w.lower() in shares for w in set(_WORD.findall(text))):
        return []
    return [{"start": a, "end": b, "share": shares[w]} for w, a, b in free_words(text, spans) if w in shares]


def _places_of_words(left_out):
    """``(id, h, term, start, end)`` of all words but those left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii", nothing_kept)
        skipped = left_out.value
        for batch in batches:
            for i, text in enumerate(texts_of(batch)):
                free = [x for x in free_words(text, base_spans(text)) if x[0] not in skipped] if text else []
                for lo in range(0, len(free), FLUSH_TERMS):
                    part = free[lo : lo + FLUSH_TERMS]
                    at = pa.array([i] * len(part), pa.int32())
                    columns = [pa.array(c, k) for c, k in zip(zip(*part), (pa.string(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["id", "h", "term", "start", "end"])

    return run


def _located(docs: DataFrame, id_col: str, text_col: str, reach: int, support: int, threshold: float) -> tuple[DataFrame, dict[str, float], DataFrame | None]:
    """The rows with their text's hash, and the disclosing terms: either their shares, or their places in each ``(id, h)``."""
    spark = prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = disclosing_terms(rows, reach, support, threshold)
    if found is None:
        return rows, {}, None
    telling, common = found
    count, size = telling.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if count <= BROADCAST_TERMS and size <= BROADCAST_BYTES:
        return rows, {r["term"]: r["share"] for r in telling.toLocalIterator()}, None
    # Frequent words that disclose nothing are not sent.
    frequent = spark.createDataFrame([(w,) for w in common], "term string")
    left_out = {r["term"] for r in frequent.join(telling, "term", "left_anti").toLocalIterator()}
    words = rows.mapInArrow(_places_of_words(spark.sparkContext.broadcast(left_out)), f"id {kind}, h bigint, term string, start bigint, end bigint")
    extra = (
        words.join(telling, "term")
        .select("id", "h", "start", "end", "share")
        .distinct()
        .groupBy("id", "h")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    )
    return rows, {}, extra


_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))


def _digits_of(shares):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii", nothing_kept)
        known = shares.value
        for batch in batches:
            texts = texts_of(batch)
            own = [base_spans(t) for t in texts]
            counts = [[sum(k == kind for k, _, _ in spans) for spans in own] for kind in KINDS]
            joined = [",".join(f"{k}:{a}:{b}" for k, a, b in spans) for spans in own]
            terms = [places(t, known, spans) for t, spans in zip(texts, own)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(joined, pa.string()), pa.array(terms, _PLACES)],
                names=["id", "h", *(f"n_{k}" for k in KINDS), "base", "terms"],
            )

    return run


def _same_row(left: str = "a", right: str = "b"):
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & (F.col(f"{left}.h") == F.col(f"{right}.h"))


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, support: int = SUPPORT, threshold: float = GENERALISE
) -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base, terms)``; terms: (start, end, share) of disclosing terms."""
    rows, shares, extra = _located(docs, id_col, text_col, reach, support, threshold)
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    held = docs.sparkSession.sparkContext.broadcast(shares)
    base = rows.mapInArrow(_digits_of(held), f"id {kind}, h bigint, {counts}, base string, terms array<struct<start:bigint,end:bigint,share:double>>")
    if extra is None:
        return base.drop("h")
    joined = base.alias("a").join(extra.alias("b"), _same_row(), "left")
    return joined.select("a.id", *(f"a.n_{k}" for k in KINDS), "a.base", F.coalesce("b.terms", "a.terms").alias("terms"))


def rewritten(text: str | None, terms: list[dict], remove: float) -> str | None:
    """The text with entities as labels, and disclosing terms general or gone; overlaps are one span."""
    spans = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
    spans += [(t["start"], t["end"], "" if t["share"] >= remove else "[TERM]") for t in terms or ()]
    if not spans:
        return text
    out, at = [], 0
    for a, b, label in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], label]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _rewrite(text_col: str, terms_col: str | None, shares, remove: float):
    """With places from a column of the rows, or else of the terms given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii", nothing_kept)
        known = shares.value
        for batch in batches:
            names = batch.schema.names
            t = names.index(text_col)
            texts = batch.column(t).to_pylist()
            if terms_col:
                terms = batch.column(names.index(terms_col)).to_pylist()
            else:
                terms = [places(x, known, base_spans(x)) if known else () for x in texts]
            texts = [rewritten(x, y, remove) for x, y in zip(texts, terms)]
            columns = [pa.array(texts, pa.string()) if i == t else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(
                [c for c, n in zip(columns, names) if n != terms_col], names=[n for n in names if n != terms_col]
            )

    return run


def sanitise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int = REACH,
    support: int = SUPPORT,
    threshold: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """The same rows and columns, with personal data taken out of the texts."""
    _, shares, extra = _located(docs, id_col, text_col, reach, support, threshold)
    held = docs.sparkSession.sparkContext.broadcast(shares)
    if extra is None:
        return docs.mapInArrow(_rewrite(text_col, None, held, remove), docs.schema)
    names = docs.columns
    terms = fresh(names, "terms")
    h = fresh([*names, terms], "h")
    keyed = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    on = F.col(f"a.`{id_col}`").eqNullSafe(F.col("b.id")) & (F.col(f"a.`{h}`") == F.col("b.h"))
    joined = keyed.alias("a").join(extra.alias("b"), on, "left").select(*(F.col(f"a.`{c}`") for c in names), F.col("b.terms").alias(terms))
    return joined.mapInArrow(_rewrite(text_col, terms, held, remove), docs.schema)
