"""The registered queries' results in SQL, over the same tables.

Each entry is one SELECT. The inputs are common table expressions, included only where
used; ranks are plain global windows here, which is what the distributed ones must equal.
"""

from __future__ import annotations

from pairloom.functions.fixed_values import (
    BAD_INSTRUCTION,
    GOOD_INSTRUCTION,
    WHITESPACE,
)


def _text(value: str) -> str:
    """SQL literal; characters below space and above ASCII as chr() calls."""
    parts, plain = [], ""
    for c in value:
        if " " <= c <= "~":
            plain += c.replace("'", "''")
            continue
        if plain:
            parts.append(f"'{plain}'")
            plain = ""
        parts.append(f"chr({ord(c)})")
    if plain or not parts:
        parts.append(f"'{plain}'")
    return "(" + " || ".join(parts) + ")"


def _u(seed: str) -> str:
    return f"(('0x' || substr(md5({seed}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _toks(text: str) -> str:
    return f"regexp_extract_all({text}, {_text('[^ ') } || chr(9) || chr(10) || chr(13) || ']+')"


def _strip(text: str) -> str:
    return f"trim({text}, {_text(WHITESPACE)})"


def _marked(text: str) -> str:
    upper, lower = _text("\n\nHuman:"), _text("\n\nhuman:")
    return f"replace(replace({_strip(text)}, {upper}, ' </s>' || {upper}), {lower}, ' </s>' || {lower})"


def _joined(array: str) -> str:
    return f"array_to_string({array}, ' ')"


HUMAN, ASSISTANT = _text("\n\nHuman: "), _text("\n\nAssistant: ")
BARE, TIGHT = "'Human: '", _text("\n\nAssistant:")
SUMMARY = _text("\n\nHuman: Your task is to write a summary for the following post.\n\npost: ")


def _dialogue(prompt: str) -> str:
    return f"({HUMAN} || {prompt} || {ASSISTANT})"


def _bare(prompt: str) -> str:
    return f"({BARE} || {prompt} || {ASSISTANT})"


_CTES = {
    "pair_base": """
SELECT *, row_number() OVER (ORDER BY md5('pair:' || pair_id), pair_id) - 1 AS rk, count(*) OVER () AS n
FROM (SELECT a.conv_id * 4294967296 + a.turn AS pair_id, a.text AS prompt, b.text AS good
      FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
      WHERE a.role = 'user' AND b.role = 'assistant')""",
    "pairs": """
SELECT a.pair_id, a.prompt, a.good AS chosen, b.good AS rejected
FROM pair_base a JOIN pair_base b ON b.rk = (a.rk + 1) % a.n""",
    "responses": """
SELECT pair_id, prompt, chosen || ' </s>' AS chosen_response, rejected || ' </s>' AS rejected_response FROM pairs""",
    "doc_ranks": """
SELECT doc_id, lang, text, quality,
  row_number() OVER (PARTITION BY lang, quality ORDER BY md5('dp:' || doc_id), doc_id) - 1 AS rk,
  count(*) OVER (PARTITION BY lang, quality) AS n
FROM documents JOIN labels USING (doc_id)""",
    "doc_pairs": f"""
SELECT g.doc_id AS pair_id, p.text AS prompt, g.text AS chosen_response, b.text AS rejected_response
FROM doc_ranks g JOIN doc_ranks b ON b.lang = g.lang AND b.quality = 0 AND b.rk = g.rk % b.n
JOIN doc_ranks p ON p.lang = g.lang AND p.quality = 1 AND p.rk = (g.rk + 1) % g.n WHERE g.quality = 1""",
    "doc_lengths": f"""
SELECT *, len({_toks('prompt')}) AS prompt_length,
  len({_toks('prompt || chosen_response')}) AS chosen_response_length,
  len({_toks('prompt || rejected_response')}) AS rejected_response_length FROM doc_pairs""",
    "doc_dialogue_lengths": f"""
SELECT pair_id, p AS prompt, chosen_response, rejected_response, len({_toks('p')}) AS prompt_length,
  len({_toks('p || chosen_response')}) AS chosen_response_length,
  len({_toks('p || rejected_response')}) AS rejected_response_length
FROM (SELECT *, {_dialogue('prompt')} AS p FROM doc_pairs)""",
    "transcripts": f"""
SELECT c.conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN {HUMAN} ELSE {ASSISTANT} END || text, ''
    ORDER BY turn) FILTER (turn < last), '') || {ASSISTANT} AS prompt,
  max(text) FILTER (turn = last) AS response
FROM conversations c
JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1) l USING (conv_id)
WHERE role <> 'system' AND turn <= last GROUP BY 1""",
    "transcript_pairs": f"""
SELECT pair_id, {_dialogue('prompt')} AS prompt, chosen, rejected FROM pairs""",
    "summary_base": """
SELECT doc_id, lang, text, quality, row_number() OVER (PARTITION BY lang ORDER BY md5('summary:' || doc_id), doc_id) - 1 AS rk,
  count(*) OVER (PARTITION BY lang) AS n
FROM documents JOIN labels USING (doc_id)""",
    "summaries": """
SELECT a.doc_id, a.text AS post, b.text AS s0, c.text AS s1, a.quality AS choice
FROM summary_base a JOIN summary_base b ON b.lang IS NOT DISTINCT FROM a.lang AND b.rk = (a.rk + 1) % a.n
  JOIN summary_base c ON c.lang IS NOT DISTINCT FROM a.lang AND c.rk = (a.rk + 2) % a.n""",
    "mc_long": """
SELECT a.pair_id AS q, a.prompt AS question, ((k.k + a.rk) % 4)::INT AS choice, b.good AS answer, (k.k = 0)::INT AS label
FROM pair_base a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) k JOIN pair_base b ON b.rk = (a.rk + k.k) % a.n""",
    "token_scores": f"""
SELECT q, choice, p.p AS pos, (p.p > 0)::INT AS mask, -8 * {_u("'ts:' || q || ':' || choice || ':' || p.p")} AS logprob
FROM (SELECT q, choice, unnest(range(len({_toks('answer')})))::INT AS p FROM mc_long) p""",
    "sequence_scores": """
SELECT q, choice, sum(mask * logprob) AS logprob FROM token_scores GROUP BY 1, 2""",
    "scored": """
SELECT m.q, m.choice, m.label, s.logprob, s.logprob / length(m.answer) AS norm
FROM mc_long m JOIN sequence_scores s USING (q, choice)""",
    "verdicts": """
SELECT g.q, g.choice AS gold, p.choice AS predicted, n.choice AS predicted_norm,
  (p.choice = g.choice)::INT AS correct, (n.choice = g.choice)::INT AS correct_norm
FROM (SELECT q, min(choice) AS choice FROM scored WHERE label = 1 GROUP BY 1) g
JOIN (SELECT q, choice FROM scored QUALIFY row_number() OVER (PARTITION BY q ORDER BY logprob DESC, choice) = 1) p USING (q)
JOIN (SELECT q, choice FROM scored QUALIFY row_number() OVER (PARTITION BY q ORDER BY norm DESC, choice) = 1) n USING (q)""",
    "token_loss": f"""
SELECT pair_id AS id, c.c AS cond, p.p AS pos, CASE WHEN p.p < 4 THEN -100 ELSE p.p END AS label,
  8 * {_u("'tl:' || pair_id || ':' || c.c || ':' || p.p")} AS loss
FROM (SELECT pair_id, unnest(range(len({_toks('good')})))::INT AS p FROM pair_base) p
CROSS JOIN (SELECT unnest(['pos', 'neg']) AS c) c""",
    "preference_scores": """
SELECT id, -ln(pp / (pp + pn) + 1e-8) AS pos_lp, -ln(pn / (pp + pn) + 1e-8) AS neg_lp
FROM (SELECT id, exp(-avg(CASE WHEN label = -100 THEN 0 ELSE loss END) FILTER (cond = 'pos')) AS pp,
        exp(-avg(CASE WHEN label = -100 THEN 0 ELSE loss END) FILTER (cond = 'neg')) AS pn
      FROM token_loss GROUP BY 1)""",
    "logits": f"""
SELECT pair_id AS id, p.p AS pos, t.t AS token, 10 * {_u("'lg:' || pair_id || ':' || p.p || ':' || t.t")} AS logit,
  (('0x' || substr(md5(p.w), 1, 8))::BIGINT % 16)::INT AS target
FROM (SELECT pair_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS p FROM (SELECT pair_id, {_toks('good')} AS w FROM pair_base)) p
CROSS JOIN (SELECT unnest(range(16))::INT AS t) t""",
    "activations": """
SELECT (vec_id // 24) AS example_id, (10 + 2 * ((vec_id // 4) % 6))::INT AS layer, 0 AS pos,
  ['base', 'pos', 'neg', 'model'][(vec_id % 4)::INT + 1] AS variant, ((vec_id // 4) % 5 <> 0)::INT AS mask,
  embedding::DOUBLE[] AS vec
FROM embeddings""",
    "targets": """
SELECT b.example_id, b.layer, b.pos, b.mask,
  [(b.vec[i] + 5 * (p.vec[i] - n.vec[i])) * b.mask for i in range(1, len(b.vec) + 1)] AS target
FROM (SELECT * FROM activations WHERE variant = 'base') b
JOIN (SELECT * FROM activations WHERE variant = 'pos') p USING (example_id, layer, pos)
JOIN (SELECT * FROM activations WHERE variant = 'neg') n USING (example_id, layer, pos)""",
    "distances": """
SELECT t.layer, sqrt(list_sum([(m.vec[i] * t.mask - t.target[i]) ** 2 for i in range(1, len(t.target) + 1)])) AS distance
FROM targets t JOIN activations m ON m.variant = 'model' AND m.example_id = t.example_id AND m.layer = t.layer AND m.pos = t.pos""",
    "pair_text": f"""
SELECT pair_id, {_bare('prompt')} AS prompt, {_bare('prompt')} || chosen_response AS text FROM responses""",
    "vocab": f"""
SELECT token, n AS count, CASE token WHEN '</s>' THEN 2 WHEN '<s>' THEN 1 WHEN '<unk>' THEN 0 ELSE
  row_number() OVER (ORDER BY token IN ('</s>', '<s>', '<unk>'), n DESC, md5('vocab:' || token), token) + 2 END AS id
FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_toks('text')}) AS token FROM pair_text) GROUP BY 1)""",
    "document_vocab": f"""
SELECT token, n AS count, CASE token WHEN '</s>' THEN 2 WHEN '<s>' THEN 1 WHEN '<unk>' THEN 0 ELSE
  row_number() OVER (ORDER BY token IN ('</s>', '<s>', '<unk>'), n DESC, md5('vocab:' || token), token) + 2 END AS id
FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_toks('text')}) AS token FROM documents) GROUP BY 1)""",
    "instructions": """
SELECT pair_id AS id, prompt AS instruction FROM pair_base""",
    "completions": f"""
SELECT pair_id AS id, {_dialogue('prompt')} || good AS completion FROM pair_base WHERE rk % 10 <> 0""",
    "cleaned": f"""
SELECT i.id, i.instruction, replace(c.completion, {_dialogue('i.instruction')}, '') AS output, 'model-a' AS generator
FROM instructions i LEFT JOIN completions c USING (id)""",
    "split_pairs": """
SELECT *, CASE WHEN rk >= n - 10 THEN 'test' WHEN rk >= (n - 10) // 2 THEN 'ppo' ELSE 'rm' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) - 1 AS rk, count(*) OVER () AS n
      FROM responses)""",
    "hindsight": f"""
SELECT pair_id, 'chosen' AS type, {{good}} || {_bare(_strip('prompt'))} AS prompt,
  {{bad}} || {_bare(_strip('prompt'))} AS neg_prompt, chosen_response AS text FROM responses
UNION ALL
SELECT pair_id, 'rejected', {{bad}} || {_bare(_strip('prompt'))}, {{good}} || {_bare(_strip('prompt'))},
  rejected_response FROM responses""".format(
        good=_text(GOOD_INSTRUCTION + "\n\n"), bad=_text(BAD_INSTRUCTION + "\n\n")
    ),
    "short_hindsight": f"""
SELECT pair_id, 'chosen' AS type, 'good' || chr(10) || chr(10) || {_bare(_strip('prompt'))} AS prompt,
  'bad' || chr(10) || chr(10) || {_bare(_strip('prompt'))} AS neg_prompt, chosen_response AS text FROM responses
UNION ALL
SELECT pair_id, 'rejected', 'bad' || chr(10) || chr(10) || {_bare(_strip('prompt'))},
  'good' || chr(10) || chr(10) || {_bare(_strip('prompt'))}, rejected_response FROM responses""",
    "swapped": f"""
SELECT pair_id, len({_toks('prompt')}) AS prompt_length, {_bare('prompt')} AS prompt, chosen_response AS base,
  CASE WHEN u < 0.5 THEN rejected_response ELSE chosen_response END AS chosen, u AS random
FROM (SELECT *, {_u("'42:' || pair_id")} AS u FROM responses)""",
}



def _query(select: str, **extra: str) -> str:
    """Prefix the common table expressions a select needs, in dependency order."""
    known = {**_CTES, **extra}
    needed: list[str] = []

    def visit(sql: str) -> None:
        words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name, body in known.items():
            if name in words and name not in needed and body != sql:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + select


def _ids(source: str, key: str, text: str, length: int | None, vocab: str = "vocab") -> str:
    """(key, ids): vocabulary ids of the first ``length`` tokens of ``text``; no row without tokens."""
    cut = f"[1:{length}]" if length else ""
    return f"""
SELECT {key}, list(coalesce(v.id, 0) ORDER BY pos) AS ids
FROM (SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS pos
      FROM (SELECT {key}, {_toks(text)}{cut} AS t FROM {source})) LEFT JOIN {vocab} v USING (token) GROUP BY ALL"""


def _closed(ids: str, length: int) -> str:
    return f"CASE WHEN len({ids}) < {length} AND {ids}[-1] IS DISTINCT FROM 2 THEN list_append({ids}, 2) ELSE {ids} END"


def _repeat(value: int, n: str) -> str:
    return f"[{value} for _ in range(greatest({n}, 0))]"


def _contrast(prompt_ids: str, response_ids: str, left: int, right: int) -> str:
    p, r = prompt_ids, response_ids
    return (
        _joined(f"list_concat({_repeat(0, f'{left} - len({p})')}, {p}, {r}, {_repeat(0, f'{right} - len({r})')})")
        + " AS input_ids, "
        + _joined(
            f"list_concat({_repeat(0, f'{left} - len({p})')}, {_repeat(1, f'len({p})')}, "
            f"{_repeat(1, f'len({r})')}, {_repeat(0, f'{right} - len({r})')})"
        )
        + " AS attention_mask"
    )


_VARIANTS = """
SELECT *, v.variant, v.lead || prompt AS variant_prompt
FROM {source} CROSS JOIN (SELECT unnest([
  {{'variant': 'orig', 'lead': 'Give a ori answer' || chr(10) || chr(10)}},
  {{'variant': 'pos', 'lead': 'Give a good answer'}},
  {{'variant': 'neg', 'lead': 'Give a bad answer' || chr(10) || chr(10)}}]) AS v)"""

_WRAPPED = f"""
SELECT pair_id, {_dialogue('prompt')} AS prompt, chosen_response, rejected_response FROM responses"""

_DOC_ROWS = "(SELECT *, row_number() OVER ({order}) - 1 AS rk FROM documents)"


def _ranked(order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rk FROM documents"


_GROUPED = """
WITH shuffled AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS spot, count(*) OVER () AS n FROM documents),
  wide AS (SELECT *, greatest(least(n // 32, 50), 1) * 8 AS width FROM shuffled),
  placed AS (
    SELECT *, spot // width AS grp, row_number() OVER (PARTITION BY spot // width ORDER BY n_chars DESC, spot) - 1 AS place FROM wide),
  longest AS (SELECT grp AS top FROM placed WHERE place = 0 ORDER BY n_chars DESC, grp LIMIT 1)
SELECT doc_id, n_chars, source, CAST(CASE WHEN place = 0 AND grp = top THEN 0 WHEN place = 0 AND grp = 0 THEN top * width
  ELSE grp * width + place END AS BIGINT) AS rk FROM placed CROSS JOIN longest"""


def _batched(ranked: str) -> str:
    return f"""
SELECT doc_id, n_chars, source, rk AS batch_rank, rk // 8 AS batch_id,
  ((max(n_chars) OVER (PARTITION BY rk // 8) + 7) // 8) * 8 AS padded_length,
  ((max(n_chars) OVER (PARTITION BY rk // 8) + 7) // 8) * 8 - n_chars AS pad_waste
FROM ({ranked})"""


def _batches(order: str) -> str:
    return _batched(_ranked(order))


def _padding(by: str, ranked: str) -> str:
    return f"""SELECT '{by}' AS by, count(DISTINCT batch_id) AS batches, count(*) AS examples, CAST(sum(pad_waste) AS BIGINT) AS padding
FROM ({_batched(ranked)})"""


def _manifest(source: str) -> str:
    return f"""
SELECT split, count(*) AS num_examples,
  sum(octet_length(encode(prompt)) + octet_length(encode(chosen_response)) + octet_length(encode(rejected_response)))::BIGINT
    AS num_bytes FROM {source} GROUP BY 1"""


def _labelled(source: str) -> str:
    return f"""
SELECT *, CASE WHEN rk >= n - 10 THEN 'test' WHEN rk >= (n - 10) // 2 THEN 'ppo' ELSE 'rm' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) - 1 AS rk, count(*) OVER () AS n FROM {source})"""


def _alignment_rows(examples: str, key: str = "pair_id", budget: int = 48, vocab: str = "vocab") -> str:
    return _query(
        f"""SELECT e.{key}, e.branch, e.variant, {_contrast('p.ids', 'r.ids', budget, 64)}
FROM variants e JOIN prompt_ids p USING ({key}, branch, variant) JOIN response_ids r USING ({key}, branch)""",
        examples=examples,
        variants=_VARIANTS.format(source="examples"),
        prompt_ids=_ids("variants", f"{key}, branch, variant", "variant_prompt", budget, vocab),
        response_ids=_ids("examples", f"{key}, branch", "chosen", 64, vocab),
    )


_BUDGETED = f"""
SELECT * FROM (SELECT pair_id, {_dialogue('prompt')} AS prompt, chosen_response, rejected_response FROM responses)
WHERE len({_toks('prompt')}) <= 48 AND len({_toks('prompt || chosen_response')}) <= 192
  AND len({_toks('prompt || rejected_response')}) <= 192"""


ORACLES: dict[str, str] = {
    "read_examples_parquet": "SELECT conv_id, turn, role, text FROM conversations",
    "read_examples_json": _query(
        "SELECT pair_id, prompt, chosen AS chosen_response, rejected AS rejected_response FROM pairs"
    ),
    "read_examples_json_array": _query(
        "SELECT pair_id, prompt, chosen AS chosen_response, rejected AS rejected_response FROM pairs"
    ),
    "read_examples_saved": _query(
        "SELECT pair_id, prompt, chosen AS chosen_response, rejected AS rejected_response FROM pairs"
    ),
    "read_split_saved": _query("SELECT pair_id, prompt FROM split_pairs WHERE split = 'ppo'"),
    "read_split_sized": _query("SELECT pair_id, prompt FROM split_pairs WHERE split = 'ppo'"),
    "write_sized_splits": _query(_manifest("split_pairs")),
    "read_split": _query("SELECT pair_id, prompt FROM split_pairs WHERE split = 'ppo'"),
    "write_splits": _query("SELECT pair_id, prompt, chosen_response, split FROM split_pairs"),
    "write_completions": _query("SELECT instruction, output, generator FROM cleaned"),
    "split_manifest": _query(_manifest("split_pairs")),
    "extract_responses": _query(
        "SELECT pair_id, chosen AS chosen_response, rejected AS rejected_response FROM pairs"
    ),
    "format_prompts": _query(
        f"""SELECT pair_id, {_dialogue('prompt')} AS dialogue, {_bare('prompt')} AS bare,
  {_bare(_strip('prompt'))} AS bare_stripped, {BARE} || prompt || {TIGHT} AS bare_tight,
  {SUMMARY} || prompt || {ASSISTANT} AS summary FROM pairs"""
    ),
    "append_eos": _query(
        "SELECT pair_id, chosen || ' </s>' AS chosen, rejected || '</s>' AS rejected FROM transcript_pairs"
    ),
    "mark_turn_boundaries": _query(
        f"SELECT conv_id, {_marked('prompt')} AS marked, chr(10) || chr(10) || {_marked('prompt')} AS marked_leading "
        "FROM transcripts"
    ),
    "training_text_sft": _query(
        f"SELECT conv_id, {_marked('prompt')} || response || ' </s>' AS text FROM transcripts"
    ),
    "training_text_preference": _query(
        f"SELECT pair_id, {_dialogue('prompt')} || rejected_response AS text FROM responses"
    ),
    "training_text_transcript": _query(
        f"SELECT pair_id, chr(10) || chr(10) || {_marked('prompt')} || rejected || ' </s>' AS text FROM transcript_pairs"
    ),
    "training_text_summary": _query(
        f"SELECT doc_id, {SUMMARY} || post || {ASSISTANT} || CASE WHEN choice = 1 THEN s0 ELSE s1 END || '</s>' AS text "
        "FROM summaries"
    ),
    "select_by_preference": _query(
        "SELECT pair_id, chosen_response AS from_chosen, rejected_response AS from_rejected FROM responses"
    ),
    "hindsight_examples": _query("SELECT pair_id, type, prompt, neg_prompt, text FROM hindsight"),
    "summary_preferences": _query(
        f"""SELECT doc_id, {SUMMARY} || post || {ASSISTANT} AS prompt,
  CASE WHEN choice = 1 THEN s1 ELSE s0 END || '</s>' AS chosen,
  CASE WHEN choice = 1 THEN s0 ELSE s1 END || '</s>' AS rejected,
  {SUMMARY} || post || {ASSISTANT} || CASE WHEN choice = 1 THEN s1 ELSE s0 END || '</s>' AS text FROM summaries"""
    ),
    "contrast_prompts": _query(
        "SELECT pair_id, variant, variant_prompt AS prompt FROM variants",
        wrapped=_WRAPPED,
        variants=_VARIANTS.format(source="wrapped"),
    ),
    "random_preference_swap": _query(
        "SELECT pair_id, prompt_length, prompt, base, chosen, round(random, 6) AS random FROM swapped"
    ),
    "split_turns": _query(
        f"""SELECT conv_id, (pos - 1)::INT AS turn, parts[1] AS human, parts[2] AS assistant
FROM (SELECT conv_id, pos, string_split(told, {ASSISTANT}) AS parts
      FROM (SELECT conv_id, unnest(p) AS told, generate_subscripts(p, 1) AS pos
            FROM (SELECT conv_id, string_split(regexp_replace(prompt || response, '^(' || chr(10) || chr(10) || ')?Human: ', ''),
                    {HUMAN}) AS p FROM transcripts)))"""
    ),
    "clean_completions": _query("SELECT id, instruction, output, generator FROM cleaned"),
    "project_training_columns": _query("SELECT pair_id, prompt || chosen AS text, prompt, chosen FROM swapped"),
    "token_lengths": f"""SELECT doc_id, len({_toks('text')}) AS tokens, len({_toks('lang || text')}) AS with_lang,
  len({_toks('text || text')}) AS twice FROM documents""",
    "filter_pair_budget": _query(
        """SELECT pair_id, prompt_length, chosen_response_length, rejected_response_length FROM doc_lengths
WHERE prompt_length <= 256 AND chosen_response_length <= 768 AND rejected_response_length <= 768"""
    ),
    "filter_text_budget": _query(
        """SELECT pair_id, prompt_length, chosen_response_length AS text_length FROM doc_lengths
WHERE prompt_length <= 256 AND chosen_response_length <= 768"""
    ),
    "filter_prompt_budget": _query(
        f"""SELECT conv_id, len({_toks('prompt')}) AS prompt_length FROM transcripts WHERE len({_toks('prompt')}) <= 256"""
    ),
    "filter_token_budget": _query(
        """SELECT pair_id, prompt FROM doc_lengths
WHERE prompt_length <= 256 AND chosen_response_length <= 768 AND rejected_response_length <= 768"""
    ),
    "build_vocab": _query("SELECT token, count, id FROM document_vocab"),
    "build_vocab_sized": _query("SELECT token, count, id FROM document_vocab WHERE id < 2000"),
    "encode": _query(
        f"""SELECT pair_id, {_joined('c')} AS input_ids, {_joined(_repeat(1, 'len(c)'))} AS attention_mask,
  {_joined('c')} AS labels
FROM (SELECT pair_id, {_closed('ids', 96)} AS c FROM encoded)""",
        encoded=_ids("pair_text", "pair_id", "text", 96),
    ),
    "encode_documents": _query(
        f"""SELECT doc_id, {_joined(_closed("coalesce(ids, []::BIGINT[])", 768))} AS input_ids
FROM documents LEFT JOIN encoded USING (doc_id)""",
        encoded=_ids("documents", "doc_id", "text", 768, "document_vocab"),
    ),
    "encode_large_vocab": _query(
        f"""SELECT doc_id, {_joined(_closed("coalesce(ids, []::BIGINT[])", 768))} AS input_ids
FROM documents LEFT JOIN encoded USING (doc_id)""",
        encoded=_ids("documents", "doc_id", "text", 768, "document_vocab"),
    ),
    "mask_prompt_labels": _query(
        f"""SELECT pair_id, {_joined("[CASE WHEN i <= k THEN -100 ELSE c[i] END for i in range(1, len(c) + 1)]")} AS labels
FROM (SELECT pair_id, {_closed('ids', 40)} AS c, len({_toks('prompt')}) AS k FROM encoded JOIN pair_text USING (pair_id))""",
        encoded=_ids("pair_text", "pair_id", "text", 40),
    ),
    "encode_counter_condition": _query(
        f"""SELECT pair_id, type, {_joined(f"list_concat(ids, {_repeat(0, '96 - len(ids)')})")} AS input_ids_neg FROM encoded""",
        encoded=_ids("short_hindsight", "pair_id, type", "neg_prompt || text", 96),
    ),
    "project_training_columns_encoded": _query(
        f"""SELECT pair_id, type, {_joined('c')} AS input_ids, {_joined(_repeat(1, 'len(c)'))} AS attention_mask,
  {_joined("[CASE WHEN i <= k THEN -100 ELSE c[i] END for i in range(1, len(c) + 1)]")} AS labels,
  {_joined(f"list_concat(g, {_repeat(0, '96 - len(g)')})")} AS input_ids_neg
FROM (SELECT pair_id, type, {_closed('f.ids', 96)} AS c, g.ids AS g, least(len({_toks('prompt')}), 96) AS k
      FROM full_ids f JOIN neg_ids g USING (pair_id, type) JOIN short_hindsight USING (pair_id, type))""",
        full_ids=_ids("short_hindsight", "pair_id, type", "prompt || text", 96),
        neg_ids=_ids("short_hindsight", "pair_id, type", "neg_prompt || text", 96),
    ),
    "encode_contrast": _query(
        f"""SELECT pair_id, variant, {_contrast('p.ids', 'r.ids', 32, 64)}
FROM prompt_ids p JOIN response_ids r USING (pair_id)""",
        wrapped=_WRAPPED,
        variants=_VARIANTS.format(source="wrapped"),
        prompt_ids=_ids("variants", "pair_id, variant", "variant_prompt", 32),
        response_ids=_ids("wrapped", "pair_id", "rejected_response", 64),
    ),
    "encode_contrast_single": _query(
        f"SELECT pair_id, {_contrast('p.ids', 'r.ids', 32, 64)} FROM prompt_ids p JOIN response_ids r USING (pair_id)",
        wrapped=_WRAPPED,
        prompt_ids=_ids("wrapped", "pair_id", "prompt", 32),
        response_ids=_ids("wrapped", "pair_id", "chosen_response", 64),
    ),
    "position_ids": _query(
        f"""SELECT pair_id, {_joined("[CASE WHEN i > a AND i <= a + b THEN i - a - 1 ELSE 1 END for i in range(1, 97)]")}
  AS position_ids
FROM (SELECT pair_id, 32 - len(p.ids) AS a, len(p.ids) + len(r.ids) AS b
      FROM prompt_ids p JOIN response_ids r USING (pair_id))""",
        wrapped=_WRAPPED,
        prompt_ids=_ids("wrapped", "pair_id", "prompt", 32),
        response_ids=_ids("wrapped", "pair_id", "chosen_response", 64),
    ),
    "encode_qa_batch": _query(
        f"""SELECT pair_id, batch_id,
  {_joined(f"list_concat({_repeat(0, 'pm - len(p)')}, p, r, {_repeat(0, 'rm - len(r)')})")} AS input_ids,
  {_joined(f"list_concat({_repeat(0, 'pm - len(p)')}, {_repeat(1, 'len(p)')}, {_repeat(1, 'len(r)')}, {_repeat(0, 'rm - len(r)')})")}
    AS attention_mask,
  {_joined(f"list_concat({_repeat(0, 'pm')}, {_repeat(1, 'len(r)')}, {_repeat(0, 'rm - len(r)')})")} AS labels
FROM (SELECT pair_id, pair_id % 10 AS batch_id, p.ids AS p, r.ids AS r,
        max(len(p.ids)) OVER (PARTITION BY pair_id % 10) AS pm, max(len(r.ids)) OVER (PARTITION BY pair_id % 10) AS rm
      FROM prompt_ids p JOIN response_ids r USING (pair_id))""",
        asked=f"SELECT pair_id, {BARE} || prompt || {TIGHT} AS prompt, chosen_response FROM responses",
        prompt_ids=_ids("asked", "pair_id", "prompt", None),
        response_ids=_ids("asked", "pair_id", "chosen_response", None),
    ),
    "decode": _query(
        f"""SELECT pair_id, coalesce(string_agg(v.token, ' ' ORDER BY pos) FILTER (v.id > 2), '') AS decoded
FROM (SELECT pair_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
      FROM (SELECT pair_id, {_toks('rejected_response')}[1:96] AS t FROM responses)) LEFT JOIN vocab v USING (token)
GROUP BY 1"""
    ),
    "decode_large_vocab": _query(
        f"""SELECT pair_id, coalesce(string_agg(v.token, ' ' ORDER BY pos) FILTER (v.id > 2), '') AS decoded
FROM (SELECT pair_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
      FROM (SELECT pair_id, {_toks('rejected_response')}[1:96] AS t FROM responses)) LEFT JOIN vocab v USING (token)
GROUP BY 1"""
    ),
    "exact_rank": """SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rank,
  row_number() OVER (ORDER BY n_chars DESC, md5('42:' || doc_id), doc_id) - 1 AS size_rank FROM documents""",
    "exact_rank_within": """SELECT doc_id, lang, n_chars,
  row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rank,
  count(*) OVER (PARTITION BY lang) AS n,
  row_number() OVER (PARTITION BY lang ORDER BY n_chars, md5('42:' || doc_id), doc_id) - 1 AS size_rank FROM documents""",
    "random_split": """
SELECT doc_id, lang, CASE WHEN rk >= n - 100 THEN 'test' WHEN rk >= (n - 100) // 2 THEN 'ppo' ELSE 'rm' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rk, count(*) OVER () AS n
      FROM documents)""",
    "concat_examples": _query(
        """SELECT pair_id, 'chosen' AS branch, chosen_response AS output FROM responses
UNION ALL SELECT pair_id, 'rejected', rejected_response FROM responses"""
    ),
    "preference_branches": _query(
        """SELECT pair_id, 'chosen' AS branch, chosen_response AS output FROM responses
UNION ALL SELECT pair_id, 'rejected', rejected_response FROM responses"""
    ),
    "seeded_shuffle": _query(
        """SELECT pair_id, prompt, row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) - 1 AS shuffle_rank
FROM responses"""
    ),
    "head_examples": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 150",
    "assign_batches_by_length": _batches("n_chars, md5('42:' || doc_id), doc_id"),
    "assign_batches_by_order": _batches("md5('42:' || doc_id), doc_id"),
    "assign_batches_grouped": _batched(_GROUPED),
    "batch_padding": "\nUNION ALL\n".join(
        (
            _padding("order", _ranked("md5('42:' || doc_id), doc_id")),
            _padding("length", _ranked("n_chars, md5('42:' || doc_id), doc_id")),
            _padding("grouped", _GROUPED),
        )
    ),
    "explode_mc1": _query(f"SELECT q, {_bare('question')} AS question, choice, answer, label FROM mc_long"),
    "explode_keyed_choices": _query(
        f"SELECT q, {BARE} || question || {TIGHT} AS question, choice, answer, label FROM mc_long"
    ),
    "sequence_logprob": _query("SELECT q, choice, round(logprob, 6) AS logprob FROM sequence_scores"),
    "logprob_from_logits": _query(
        """SELECT id, pos, round(max(logit) FILTER (token = target) - max(m) - ln(sum(exp(logit - m))), 6) AS logprob
FROM (SELECT *, max(logit) OVER (PARTITION BY id, pos) AS m FROM logits) GROUP BY 1, 2"""
    ),
    "logprob_from_arrays": _query(
        """SELECT id, pos, round(max(logit) FILTER (token = target) - max(m) - ln(sum(exp(logit - m))), 6) AS logprob
FROM (SELECT *, max(logit) OVER (PARTITION BY id, pos) AS m FROM logits) GROUP BY 1, 2"""
    ),
    "logprob_from_tensor": _query(
        """SELECT l.id, l.pos, round(max(logit) FILTER (token = t.target) - max(m) - ln(sum(exp(logit - m))), 6) AS logprob
FROM (SELECT *, max(logit) OVER (PARTITION BY id, pos) AS m FROM logits) AS l
JOIN (SELECT DISTINCT id, pos - 1 AS pos, target FROM logits) AS t ON t.id = l.id AND t.pos = l.pos GROUP BY 1, 2"""
    ),
    "nan_report": _query(
        f"""SELECT 'logprob' AS column_name, count(*) AS rows, 0::BIGINT AS nan_rows FROM token_scores
UNION ALL SELECT 'spoiled', count(*), count(*) FILTER ({_u("'nan:' || q || ':' || pos")} < 0.01) FROM token_scores"""
    ),
    "assert_no_nan": _query("SELECT q, choice, pos, round(logprob, 6) AS logprob FROM token_scores"),
    "score_questions": _query(
        "SELECT q, gold, predicted, predicted_norm, correct, correct_norm, true AS valid FROM verdicts"
    ),
    "mc_accuracy": _query(
        """SELECT round(avg(correct), 6) AS acc, round(avg(correct_norm), 6) AS acc_norm, count(*) AS questions,
  0::BIGINT AS invalid FROM verdicts"""
    ),
    "eval_report": _query(
        """SELECT 'tqa' AS eval_set, 'tqa_accuracy' AS metric, round(avg(correct), 6) AS value FROM verdicts
UNION ALL SELECT 'arc-e', 'arc-e_accuracy', round(avg(correct_norm), 6) FROM verdicts"""
    ),
    "contrastive_preference": _query(
        """SELECT id, round(pos_lp, 6) AS pos_lp, round(neg_lp, 6) AS neg_lp,
  round(0.8 * pos_lp + 0.2 * neg_lp, 6) AS score FROM preference_scores"""
    ),
    "contrastive_loss": _query(
        "SELECT round(avg(0.8 * pos_lp + 0.2 * neg_lp), 6) AS score, count(*) AS examples FROM preference_scores"
    ),
    "steering_targets": _query(
        """SELECT example_id, layer, pos, mask, round(target[1], 6) AS target_0, round(target[32], 6) AS target_31,
  round(target[64], 6) AS target_63, round(list_sum(target), 6) AS target_sum FROM targets WHERE layer IN (10, 12, 14)"""
    ),
    "steering_targets_placed": _query(
        """SELECT example_id, layer, pos, mask, round(target[1], 6) AS target_0, round(target[32], 6) AS target_31,
  round(target[64], 6) AS target_63, round(list_sum(target), 6) AS target_sum FROM targets WHERE layer IN (10, 12, 14)"""
    ),
    "alignment_distance": _query("SELECT round(avg(distance), 6) AS distance, count(*) AS positions FROM distances"),
    "alignment_distance_by_layer": _query(
        "SELECT layer, round(avg(distance), 6) AS distance, count(*) AS positions FROM distances GROUP BY 1"
    ),
    "steered_distance_by_layer": _query(
        "SELECT layer, round(avg(distance), 6) AS distance, count(*) AS positions FROM distances GROUP BY 1"
    ),
    "preparation_manifest": _query(_manifest("labelled"), budgeted=_BUDGETED, labelled=_labelled("budgeted")),
    "document_preparation": _query(
        _manifest("labelled"),
        budgeted="""SELECT * FROM doc_dialogue_lengths
WHERE prompt_length <= 256 AND chosen_response_length <= 768 AND rejected_response_length <= 768""",
        labelled=_labelled("budgeted"),
    ),
    "hindsight_batches": _query(
        f"""SELECT pair_id, type, {_joined('c')} AS input_ids,
  {_joined(f"list_concat(g, {_repeat(0, '192 - len(g)')})")} AS input_ids_neg,
  {_joined(_repeat(1, 'len(c)'))} AS attention_mask,
  {_joined("[CASE WHEN i <= k THEN -100 ELSE c[i] END for i in range(1, len(c) + 1)]")} AS labels,
  len(c)::INT AS length, rk AS batch_rank, rk // 8 AS batch_id,
  ((max(len(c)) OVER (PARTITION BY rk // 8) + 7) // 8) * 8 AS padded_length,
  ((max(len(c)) OVER (PARTITION BY rk // 8) + 7) // 8) * 8 - len(c) AS pad_waste
FROM (SELECT pair_id, type, {_closed('f.ids', 192)} AS c, g.ids AS g, len({_toks('prompt')}) AS k,
        row_number() OVER (ORDER BY md5('42:' || pair_id || ':' || type), pair_id, type) - 1 AS rk
      FROM full_ids f JOIN neg_ids g USING (pair_id, type) JOIN hindsight USING (pair_id, type))""",
        full_ids=_ids("hindsight", "pair_id, type", "prompt || text", 192),
        neg_ids=_ids("hindsight", "pair_id, type", "neg_prompt || text", 192),
    ),
    "pad_batches": _query(
        f"""SELECT pair_id, type, batch_id, w AS padded_length,
  {_joined(f"list_concat(c, {_repeat(0, 'w - len(c)')})")} AS input_ids,
  {_joined(f"list_concat(g, {_repeat(0, '192 - len(g)')})[1:w]")} AS input_ids_neg,
  {_joined(f"list_concat({_repeat(1, 'len(c)')}, {_repeat(0, 'w - len(c)')})")} AS attention_mask,
  {_joined(f"list_concat([CASE WHEN i <= k THEN -100 ELSE c[i] END for i in range(1, len(c) + 1)], {_repeat(-100, 'w - len(c)')})")} AS labels
FROM (SELECT *, rk // 8 AS batch_id, ((max(len(c)) OVER (PARTITION BY rk // 8) + 7) // 8) * 8 AS w
FROM (SELECT pair_id, type, {_closed('f.ids', 192)} AS c, g.ids AS g, len({_toks('prompt')}) AS k,
        row_number() OVER (ORDER BY md5('42:' || pair_id || ':' || type), pair_id, type) - 1 AS rk
      FROM full_ids f JOIN neg_ids g USING (pair_id, type) JOIN hindsight USING (pair_id, type)))""",
        full_ids=_ids("hindsight", "pair_id, type", "prompt || text", 192),
        neg_ids=_ids("hindsight", "pair_id, type", "neg_prompt || text", 192),
    ),
    "alignment_rows": _alignment_rows(
        f"""SELECT pair_id, b.branch, {_dialogue('prompt')} AS prompt,
  CASE b.branch WHEN 'chosen' THEN chosen_response ELSE rejected_response END AS chosen
FROM responses CROSS JOIN (SELECT unnest(['chosen', 'rejected']) AS branch) b
WHERE len({_toks(_dialogue('prompt'))}) <= 48"""
    ),
    "alignment_rows_random": _alignment_rows(
        "SELECT pair_id, 'random' AS branch, prompt, chosen FROM swapped WHERE prompt_length <= 48"
    ),
    "alignment_rows_transcript": _alignment_rows(
        f"""SELECT pair_id, b.branch, chr(10) || chr(10) || {_marked('prompt')} AS prompt,
  CASE b.branch WHEN 'chosen' THEN chosen ELSE rejected END || ' </s>' AS chosen
FROM transcript_pairs CROSS JOIN (SELECT unnest(['chosen', 'rejected']) AS branch) b
WHERE len({_toks(_marked('prompt'))}) <= 48"""
    ),
    "alignment_rows_summary": _alignment_rows(
        f"""SELECT doc_id, 'rejected' AS branch, {SUMMARY} || post || {ASSISTANT} AS prompt,
  CASE WHEN choice = 1 THEN s0 ELSE s1 END || '</s>' AS chosen
FROM summaries WHERE len({_toks(f"({SUMMARY} || post || {ASSISTANT})")}) <= 256""",
        "doc_id",
        256,
        "document_vocab",
    ),
    "supervised_texts_preference": _query(
        """SELECT pair_id, prompt_length, rejected_response_length AS text_length, prompt || rejected_response AS text
FROM doc_dialogue_lengths WHERE prompt_length <= 256 AND rejected_response_length <= 768"""
    ),
    "supervised_texts_transcript": _query(
        f"""SELECT conv_id, prompt_length, text_length, text
FROM (SELECT conv_id, len({_toks('prompt')}) AS prompt_length, len({_toks('text')}) AS text_length, text
      FROM (SELECT *, {_marked('prompt')} || response || ' </s>' AS text FROM transcripts))
WHERE prompt_length <= 256 AND text_length <= 768"""
    ),
}
