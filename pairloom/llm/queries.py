"""Registered queries of this subpackage, and the same results as SQL where SQL can express them.

Each query runs its operator over the whole of its table with production parameters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pairloom.llm import bpe, chat, clustering, decontaminate, jaccard_join, neighbours, packing, pii, quality, ranked_search, token_counts, token_files, toxicity
from pairloom.llm.common import table
from pairloom.sources.staging import staging_path


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).withColumnRenamed("id", "doc_id")


def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def held_out(id_col):
        return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

    model = toxicity.fit_on(docs, labels, allowed=~held_out("id"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_byte_bpe(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), path, pattern, packed=True)
    return bpe.decode_ids(encoded, path, pattern).select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_chat(spark, sf_dir):
    parts = chat.rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return parts.withColumn("mask", F.array_join(spans, ","))


def op6_decontamination(spark, sf_dir):
    found = decontaminate.find_benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr("id as doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_personal_data(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    base = F.when(F.col("base") != "", F.array("base")).otherwise(F.array().cast("array<string>"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_email", "n_ip", "n_card", "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


def op8_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = staging_path(spark, "token-files")
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    tokens = token_files.read_token_ids(spark, path)
    return token_files.token_checksums(tokens).withColumnRenamed("id", "doc_id")


def op9_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_token_counts(spark, sf_dir):
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumnRenamed("id", "doc_id")


def op11_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pieces = packing.cut_into_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    # Checksums are taken before places are looked up, so that no ids are shuffled.
    return packing.place(packing.with_checksums(pieces), counted=pieces).withColumnRenamed("id", "doc_id")


def op12_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_clustering(spark, sf_dir):
    placed, _ = clustering.cluster(table(spark, sf_dir, "embeddings"))
    return placed.withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat": op5_chat,
    "op6_decontamination": op6_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_token_files": op8_token_files,
    "op9_neighbours": op9_neighbours,
    "op10_token_counts": op10_token_counts,
    "op11_packing": op11_packing,
    "op12_ranked_search": op12_ranked_search,
    "op13_clustering": op13_clustering,
}

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _clustering_sql(rounds: int = 3) -> str:
    """The rounds one after another."""
    steps = ["""
        v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (
            SELECT CAST(row_number() OVER (ORDER BY h, p) - 1 AS INTEGER) AS c, p
            FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, p FROM v WHERE vec_id IS NOT NULL ORDER BY h, p LIMIT 16))"""]
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS (
            SELECT vec_id, p, c, d FROM (
                SELECT v.vec_id, v.p, c, d, row_number() OVER (PARTITION BY v.n ORDER BY d, c) AS r FROM (
                    SELECT v.vec_id, v.n, v.p, c{r}.c, list_sum(list_transform(range(1, 65), lambda i: (v.p[i] - c{r}.p[i]) * (v.p[i] - c{r}.p[i]))) AS d
                    FROM (SELECT *, row_number() OVER () AS n FROM v) AS v CROSS JOIN c{r}) AS v) WHERE r = 1)""")
        if r < rounds:
            steps.append(f"""
        m{r} AS (
            SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p
            FROM (SELECT c, i, sum(p[i]) AS s, count(*) AS n FROM (SELECT c, p, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
        c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.p, c{r}.p) AS p FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.p, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLES = {
    "op3_jaccard_join": f"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM grams AS x JOIN grams AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM pairs JOIN sizes AS p ON p.doc_id = a JOIN sizes AS q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
        reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
        SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, least(doc.doc_id, coalesce(other, doc.doc_id)) AS component_id
        FROM doc LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id) AS r USING (doc_id)""",
    "op5_chat": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(turn // 128, -4611686018427387904) AS block,
                replace(CASE WHEN trim(role) <> '' THEN role ELSE 'unknown' END, '<|im_', '<| im_') AS role,
                replace(coalesce(text, ''), '<|im_', '<| im_') AS text
            FROM conversations),
        dealt AS (
            SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, md5(text)) - 1) // 128 AS sub FROM turns),
        seen AS (
            SELECT t.*, p.role AS participant, t.role = p.role AS own,
                '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = p.role THEN 'assistant' ELSE 'user name=' || t.role END || chr(10) AS head,
                t.text || '<|im_end|>' || chr(10) AS body
            FROM dealt AS t JOIN (SELECT DISTINCT conv_id, role FROM turns WHERE role <> 'system') AS p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        placed AS (
            SELECT *, sum(length(head) + length(body)) OVER (
                PARTITION BY conv_id, participant ORDER BY block, turn NULLS FIRST, role, md5(text) ROWS UNBOUNDED PRECEDING) AS stop
            FROM seen)
        SELECT conv_id, participant, CAST(row_number() OVER (PARTITION BY conv_id, participant ORDER BY block, sub) - 1 AS INTEGER) AS part,
            CAST(min(stop - length(body) - length(head)) AS BIGINT) AS "offset", count(*) AS n_turns,
            string_agg(head || body, '' ORDER BY stop) AS text,
            coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY stop) FILTER (own), '') AS mask
        FROM placed GROUP BY conv_id, participant, block, sub""",
    "op6_decontamination": f"""
        WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
        item AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
        place AS (
            SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win))),
        hit AS (SELECT doc_id, i, place.k AS k, item_id FROM place JOIN win ON place.win = win.win AND place.k = win.k),
        words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
        FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_neighbours": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20""",
    "op12_ranked_search": f"""
        WITH doc AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM documents),
        size AS (SELECT doc_id, count(*) AS n FROM doc GROUP BY doc_id),
        total AS (SELECT count(*) AS n, sum(n) AS l FROM size),
        held AS (SELECT doc_id, t, count(*) AS tf FROM doc GROUP BY doc_id, t),
        worth AS (
            SELECT t, CAST(floor(1000 * ln((2 * (SELECT n FROM total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held GROUP BY t),
        asked AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size.n * total.n) // total.l)))) AS BIGINT) AS score
            FROM asked JOIN held USING (t) JOIN worth USING (t) JOIN size USING (doc_id) CROSS JOIN total GROUP BY item_id, doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
        SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10""",
    "op13_clustering": _clustering_sql(),
}
