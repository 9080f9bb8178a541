"""Vocabulary, encoding, masking, padding and decoding of token arrays.

Shape of every encode: truncate, explode all texts of a row in one pass, look ids up,
and collect them again per row. The collected element is one long (slot, position, id),
so the only shuffle carries eight bytes a token, already combined per row on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.arrays import filled, last, ones_like, pad_left, pad_right
from pairloom.functions.fixed_values import (
    CONTROL_TEMPLATE,
    EOS_ID,
    IGNORE_LABEL,
    NEGATIVE_TYPE,
    ORIGINAL_TYPE,
    PAD_ID,
    POSITIVE_TYPE,
    PROMPT_BUDGET,
    RESERVED_IDS,
    RESPONSE_LENGTH,
    SPECIAL_TOKENS,
    TOTAL_BUDGET,
)
from pairloom.functions.text import Tokenizer, token_count, word_tokens
from pairloom.operators.prompts import VARIANTS, apply_style, contrast_variants
from pairloom.operators.ranking import exact_rank
from pairloom.sources.staging import staged

# A vocabulary within both limits is broadcast whole; beyond either, see ``_look_up``.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Of a larger one, the most frequent entries that are broadcast, and their longest token.
HEAD_ROWS = 65_536
HEAD_TOKEN_BYTES = 128

# Layout of a collected element: slot | position | id, 63 bits in all.
ID_BITS = 37
POSITION_BITS = 24
MAX_SLOTS = 4


def _special_id(token: Column) -> Column:
    """Id of a special token, null for any other."""
    given = F.lit(None).cast("long")
    for text, number in SPECIAL_TOKENS.items():
        given = F.when(token == text, F.lit(number).cast("long")).otherwise(given)
    return given


def build_vocab(
    df: DataFrame,
    cols: Sequence[str],
    reserved: int = RESERVED_IDS,
    tokens: Tokenizer | None = None,
    size: int | None = None,
) -> DataFrame:
    """Table (token, count, id): ids follow falling frequency, after the reserved ones.

    With ``size`` only the ids below it: the rows of the whole table that have them, but only tokens frequent
    enough are ranked. How frequent that is comes from one row for each count that occurs.

    Special tokens found in the text keep their reserved id. Ties are ordered by the token's hash. Counting combines on the map side, so a token
    that makes up a third of the text costs one row per task. Write the result out (or
    stage it) before encoding with it.
    """
    tokenize = tokens or word_tokens
    words = [F.coalesce(tokenize(F.col(c)), F.array().cast("array<string>")) for c in cols]
    counts = (
        df.select(F.explode(F.concat(*words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    )
    # Specials are ranked behind all others rather than filtered out: a filter would slip
    # below the count and give each reader of it a count of its own.
    special = _special_id(F.col("token"))
    if size is not None:
        counts = _most_frequent(staged(counts, "token_counts"), size - reserved)
    ranked = exact_rank(
        counts, "token", "vocab", by=F.when(special.isNull(), -F.col("count")).otherwise(1), out="_rank"
    )
    vocab = ranked.select("token", "count", F.coalesce(special, F.col("_rank") + reserved).alias("id"))
    return vocab if size is None else vocab.where(F.col("id") < size)


def _most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The tokens as frequent as the ``n``-th, with all its ties, and special tokens."""
    plain = _special_id(F.col("token")).isNull()
    falling = Window.orderBy(F.desc("count"))
    # A count f is met by at most tokens / f entries, so there are few distinct counts.
    levels = counts.where(plain).groupBy("count").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.sum("n").over(falling))
    least = levels.where(F.col("n") >= n).agg(F.max("count")).scalar()
    return counts.where(~plain | least.isNull() | (F.col("count") >= least))


def _measured(vocab: DataFrame, most_rows: int, most_bytes: int) -> tuple[DataFrame, bool]:
    """The entries, and whether they are few and short enough to be sent to every task."""
    entries = vocab.select("token", "id")
    size = entries.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("bytes")
    ).first()
    return entries, size["rows"] <= most_rows and size["bytes"] <= most_bytes


def _look_up(
    rows: DataFrame,
    vocab: DataFrame,
    on: str,
    broadcast_rows: int,
    broadcast_bytes: int,
    head_rows: int,
) -> DataFrame:
    """Left join token occurrences with the vocabulary on ``token`` or ``id``.

    The vocabulary grows with the data, so its size is measured first. A small one is
    broadcast. Of a large one the ``head_rows`` most frequent entries are, which settles
    most occurrences in place and every hot key with them; only the occurrences left
    over are shuffled, against entries each rarer than ``1 / head_rows`` of all tokens.
    """
    entries, small = _measured(vocab, broadcast_rows, broadcast_bytes)
    if small:
        return rows.join(F.broadcast(entries), on, "left")

    in_head = (F.col("id") < head_rows + RESERVED_IDS) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    value = "id" if on == "token" else "token"
    hit = rows.join(F.broadcast(entries.where(in_head)), on, "left")
    # Kept, so that the input and the first lookup are gone through once.
    hit = staged(hit, "looked_up")
    settled = hit.where(F.col(value).isNotNull() | F.col(on).isNull())
    unsettled = hit.where(F.col(value).isNull() & F.col(on).isNotNull()).drop(value)
    return settled.unionByName(unsettled.join(entries.where(~in_head), on, "left"))


@dataclass(frozen=True)
class Limits:
    """Size limits of the vocabulary lookup; the defaults suit executors of a few GB."""

    broadcast_rows: int = BROADCAST_ROWS
    broadcast_bytes: int = BROADCAST_BYTES
    head_rows: int = HEAD_ROWS


def _looked_up_rows(occurrences: DataFrame, kept: list[str], keys: list[str], vocab: DataFrame, limits: Limits) -> DataFrame:
    """One row per ``kept`` with ``_packed``: slot, position and id of each token in one long, in order.

    With a large vocabulary the texts are still read and tokenized once: the head of the
    vocabulary is looked up in place, the occurrences it lacks are kept with their places in the
    row, and only these are exploded, shuffled against the rest of the vocabulary, and added.
    """
    place = F.shiftleft(F.col("_slot").cast("long"), ID_BITS + POSITION_BITS).bitwiseOR(F.shiftleft(F.col("_pos").cast("long"), ID_BITS))

    def packed(place: Column, number: Column) -> Column:
        inside = F.when((number >= 0) & (number < (1 << ID_BITS)), number).otherwise(
            F.raise_error(F.concat(F.lit("vocabulary id out of range: "), number.cast("string")))
        )
        return place.bitwiseOR(inside)

    # collect_list skips nulls: the places of texts without tokens, and here those of other occurrences.
    special, unknown = _special_id(F.col("token")), F.lit(PAD_ID).cast("long")
    entries, small = _measured(vocab, limits.broadcast_rows, limits.broadcast_bytes)
    if small:
        found = occurrences.join(F.broadcast(entries), "token", "left")
        number = F.coalesce(special, F.col("id").cast("long"), unknown)
        # What gathers the rows of many keys sorts, and spills, whatever its input holds: no more than the one number.
        one = found.select(*kept, F.when(F.col("_pos").isNotNull(), packed(place, number)).alias("_one"))
        return one.groupBy(*kept).agg(F.sort_array(F.collect_list("_one")).alias("_packed"))

    in_head = (F.col("id") < limits.head_rows + RESERVED_IDS) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    hit = occurrences.join(F.broadcast(entries.where(in_head)), "token", "left")
    number = F.coalesce(special, F.col("id").cast("long"))
    settled = F.col("_pos").isNotNull() & number.isNotNull()
    missing = F.col("_pos").isNotNull() & number.isNull()
    one = hit.select(
        *kept,
        F.when(settled, packed(place, number)).alias("_one"),
        F.when(missing, F.struct(place.alias("place"), "token")).alias("_left"),
    )
    rows = one.groupBy(*kept).agg(F.collect_list("_one").alias("_settled"), F.collect_list("_left").alias("_missing"))
    rows = staged(rows, "head_ids")
    rest = rows.select(*keys, F.explode("_missing").alias("_m")).select(*keys, "_m.place", "_m.token")
    rest = rest.join(entries.where(~in_head), "token", "left")
    added = rest.select(*keys, packed(F.col("place"), F.coalesce(F.col("id").cast("long"), unknown)).alias("_one"))
    late = added.groupBy(*keys).agg(F.collect_list("_one").alias("_late"))
    both = F.concat("_settled", F.coalesce("_late", F.array().cast("array<bigint>")))
    return rows.join(late, keys, "left").select(*kept, F.sort_array(both).alias("_packed"))


def encode_texts(
    df: DataFrame,
    key: str | Sequence[str],
    texts: Mapping[str, tuple[Column, int | None]],
    vocab: DataFrame,
    keep: Sequence[str] = (),
    tokens: Tokenizer | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Encode several texts of each row in one pass: ``key``, ``keep`` and one id array each.

    ``texts`` maps an output column to (text, maximum length or None). ``key`` must
    identify rows, and ``keep`` columns should be small: they travel with every token.
    Unknown tokens get id 0 and special ones their own id, in the vocabulary or not; a text
    without tokens gives an empty array.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if len(texts) > MAX_SLOTS:
        raise ValueError(f"at most {MAX_SLOTS} texts in one pass")
    tokenize = tokens or word_tokens
    longest = 1 << POSITION_BITS
    slots = []
    for text, max_len in texts.values():
        words = F.coalesce(tokenize(text), F.array().cast("array<string>"))
        if max_len is not None:
            words = F.slice(words, 1, max_len)
        # Positions are packed into a fixed number of bits: more tokens than that fail, whatever max_len asks for.
        slots.append(F.when(F.size(words) <= longest, words).otherwise(F.raise_error(F.lit(f"a text has more than {longest} tokens"))))

    occurrences = df.select(*keys, *keep, F.posexplode(F.array(*slots)).alias("_slot", "_words")).select(
        *keys, *keep, "_slot", F.posexplode_outer("_words").alias("_pos", "token")
    )
    rows = _looked_up_rows(occurrences, [*keys, *keep], keys, vocab, limits)
    id_mask = F.lit((1 << ID_BITS) - 1)

    def ids_of(slot: int) -> Column:
        mine = F.filter("_packed", lambda x: F.shiftright(x, ID_BITS + POSITION_BITS) == slot)
        return F.transform(mine, lambda x: x.bitwiseAND(id_mask))

    return rows.select(*keys, *keep, *[ids_of(i).alias(out) for i, out in enumerate(texts)])


def _close(ids: Column, max_len: int) -> Column:
    """Append the end id when there is room and the text does not end in one already."""
    room = (F.size(ids) < max_len) & F.coalesce(last(ids) != EOS_ID, F.lit(True))
    return F.when(room, F.concat(ids, filled(EOS_ID, 1))).otherwise(ids)


def encode(
    df: DataFrame,
    key: str | Sequence[str],
    col: str,
    vocab: DataFrame,
    max_len: int = TOTAL_BUDGET,
    add_eos: bool = True,
    keep: Sequence[str] = (),
    tokens: Tokenizer | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """``input_ids`` (truncated, closed), ``attention_mask`` and ``labels`` for a text column."""
    encoded = encode_texts(df, key, {"input_ids": (F.col(col), max_len)}, vocab, keep, tokens, limits)
    if add_eos:
        encoded = encoded.withColumn("input_ids", _close(F.col("input_ids"), max_len))
    return encoded.withColumns({"attention_mask": ones_like(F.col("input_ids")), "labels": F.col("input_ids")})


def mask_prompt_labels(
    df: DataFrame, labels: str = "labels", prompt_length: str = "prompt_length", ignore: int = IGNORE_LABEL
) -> DataFrame:
    """Set the labels of the prompt's positions to ``ignore``."""
    masked = F.least(F.col(prompt_length), F.size(labels)).cast("int")
    kept = F.slice(F.col(labels), masked + 1, F.size(labels))
    return df.withColumn(labels, F.concat(filled(ignore, masked), kept))


def encode_counter_condition(
    df: DataFrame,
    key: str | Sequence[str],
    vocab: DataFrame,
    max_len: int = TOTAL_BUDGET,
    keep: Sequence[str] = (),
    tokens: Tokenizer | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """``input_ids_neg``: ``neg_prompt || text``, truncated and right-padded to ``max_len``, not closed."""
    text = F.concat("neg_prompt", "text")
    encoded = encode_texts(df, key, {"input_ids_neg": (text, max_len)}, vocab, keep, tokens, limits)
    return encoded.withColumn("input_ids_neg", pad_right(F.col("input_ids_neg"), max_len, PAD_ID))


def encode_hindsight(
    df: DataFrame,
    key: str | Sequence[str],
    vocab: DataFrame,
    max_len: int = TOTAL_BUDGET,
    keep: Sequence[str] = (),
    tokens: Tokenizer | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Encode, mask and counter-condition hindsight examples with a single token shuffle.

    Same columns as ``encode`` + ``mask_prompt_labels`` + ``encode_counter_condition``:
    both texts of a row are exploded together.
    """
    prompt_length = F.least(token_count(F.col("prompt"), tokens), F.lit(max_len))
    encoded = encode_texts(
        df.withColumn("_prompt_length", prompt_length),
        key,
        {
            "input_ids": (F.concat("prompt", "text"), max_len),
            "input_ids_neg": (F.concat("neg_prompt", "text"), max_len),
        },
        vocab,
        [*keep, "_prompt_length"],
        tokens,
        limits,
    ).withColumns(
        {
            "input_ids": _close(F.col("input_ids"), max_len),
            "input_ids_neg": pad_right(F.col("input_ids_neg"), max_len, PAD_ID),
        }
    )
    labelled = encoded.withColumns({"attention_mask": ones_like(F.col("input_ids")), "labels": F.col("input_ids")})
    return mask_prompt_labels(labelled, prompt_length="_prompt_length").drop("_prompt_length")


def encode_hindsight_pairs(
    df: DataFrame,
    key: str | Sequence[str],
    vocab: DataFrame,
    good_instruction: str,
    bad_instruction: str,
    max_len: int = TOTAL_BUDGET,
    keep: Sequence[str] = (),
    limits: Limits = Limits(),
) -> DataFrame:
    """``encode_hindsight`` of both examples of each pair, with no token looked up twice.

    Word tokens do not merge across the white space between instruction, prompt and response.
    So the prompt and both responses are encoded once a pair, the two instructions once in all,
    and the two rows (``type`` chosen and rejected) are put together from the arrays.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    told = spark.createDataFrame([(0, good_instruction + "\n\n", bad_instruction + "\n\n")], "_row int, _good string, _bad string")
    led = encode_texts(told, "_row", {"_good": (F.col("_good"), max_len), "_bad": (F.col("_bad"), max_len)}, vocab, limits=limits)
    lead = staged(led, "instructions").select(F.struct("_good", "_bad")).scalar()
    texts = {
        "_prompt": (apply_style(F.col("prompt"), "bare_stripped"), max_len),
        "_chosen": (F.col("chosen_response"), max_len),
        "_rejected": (F.col("rejected_response"), max_len),
    }
    encoded = encode_texts(df, keys, texts, vocab, keep, limits=limits).withColumn("_lead", lead)

    def example(side: str, own: str, opposite: str) -> Column:
        def whole(instruction: str) -> Column:
            return F.slice(F.concat(F.col("_lead")[instruction], F.col("_prompt"), F.col(f"_{side}")), 1, max_len)

        return F.struct(
            F.lit(side).alias("type"),
            _close(whole(own), max_len).alias("input_ids"),
            pad_right(whole(opposite), max_len, PAD_ID).alias("input_ids_neg"),
            F.least(F.size(F.col("_lead")[own]) + F.size("_prompt"), F.lit(max_len)).alias("_prompt_length"),
        )

    both = F.explode(F.array(example("chosen", "_good", "_bad"), example("rejected", "_bad", "_good"))).alias("_example")
    rows = encoded.select(*keys, *keep, both).select(*keys, *keep, "_example.*")
    labelled = rows.withColumns({"attention_mask": ones_like(F.col("input_ids")), "labels": F.col("input_ids")})
    return mask_prompt_labels(labelled, prompt_length="_prompt_length").drop("_prompt_length")


def pad_batches(df: DataFrame, width: str = "padded_length", ignore: int = IGNORE_LABEL) -> DataFrame:
    """Bring the arrays of each row to its batch's width: ids and mask with 0, labels with ``ignore``.

    ``input_ids_neg``, already padded to the longest length allowed, is cut to the width.
    """
    w = F.col(width)
    padded = {
        "input_ids": pad_right(F.col("input_ids"), w, PAD_ID),
        "attention_mask": pad_right(F.col("attention_mask"), w, 0),
        "labels": pad_right(F.col("labels"), w, ignore),
        "input_ids_neg": F.slice("input_ids_neg", 1, w.cast("int")),
    }
    return df.withColumns({c: v for c, v in padded.items() if c in df.columns})


def _prompt_and_response(prompt: Column, response: Column, prompt_len: Column | int, res_len: Column | int) -> dict[str, Column]:
    """Left-padded prompt followed by right-padded response, with their mask."""
    return {
        "input_ids": F.concat(pad_left(prompt, prompt_len, PAD_ID), pad_right(response, res_len, PAD_ID)),
        "attention_mask": F.concat(
            pad_left(ones_like(prompt), prompt_len), pad_right(ones_like(response), res_len)
        ),
    }


def encode_contrast(
    df: DataFrame,
    key: str | Sequence[str],
    vocab: DataFrame,
    prompt: str = "prompt",
    response: str = "chosen",
    variants: bool = True,
    prompt_len: int = PROMPT_BUDGET,
    max_res_len: int = RESPONSE_LENGTH,
    ori_type: str = ORIGINAL_TYPE,
    pos_type: str = POSITIVE_TYPE,
    neg_type: str = NEGATIVE_TYPE,
    control_template: str = CONTROL_TEMPLATE,
    tokens: Tokenizer | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Fixed-width prompt + response rows: three per example (``variant``), or one plain row.

    The response is encoded once and shared by the three prompts.
    """
    keys = [key] if isinstance(key, str) else list(key)
    prompts = (
        contrast_variants(F.col(prompt), ori_type, pos_type, neg_type, control_template)
        if variants
        else {"orig": F.col(prompt)}
    )
    texts = {f"_{name}": (text, prompt_len) for name, text in prompts.items()}
    texts["_response"] = (F.col(response), max_res_len)
    encoded = encode_texts(df, keys, texts, vocab, (), tokens, limits)
    if not variants:
        return encoded.select(
            *keys,
            *[c.alias(n) for n, c in _prompt_and_response(F.col("_orig"), F.col("_response"), prompt_len, max_res_len).items()],
        )
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"_{v}").alias("ids")) for v in VARIANTS])
    exploded = encoded.select(*keys, "_response", F.explode(rows).alias("_row"))
    columns = _prompt_and_response(F.col("_row")["ids"], F.col("_response"), prompt_len, max_res_len)
    return exploded.select(*keys, F.col("_row")["variant"].alias("variant"), *[c.alias(n) for n, c in columns.items()])


def position_ids(df: DataFrame, mask: str = "attention_mask", out: str = "position_ids") -> DataFrame:
    """Running sum of the mask less one; 1 where the mask is 0.

    Padding only at the ends makes the ones one block, whose running sum is the offset
    in it; a mask with holes is summed position by position.
    """
    one = F.lit(1).cast("long")
    ones = F.aggregate(mask, F.lit(0).cast("long"), lambda n, x: n + x)
    before = F.array_position(mask, one) - 1
    after = F.array_position(F.reverse(F.col(mask)), one) - 1
    one_block = ones == F.size(mask) - before - after
    offsets = F.concat(filled(1, before), F.sequence(F.lit(0).cast("long"), ones - 1), filled(1, after))
    sums = F.transform(
        mask,
        lambda x, i: F.when(x == 0, 1)
        .otherwise(F.aggregate(F.slice(F.col(mask), 1, i + 1), F.lit(0).cast("long"), lambda n, y: n + y) - 1)
        .cast("long"),
    )
    return df.withColumn(
        out, F.when(ones == 0, filled(1, F.size(mask))).when(one_block, offsets).otherwise(sums)
    )


def encode_qa_batch(
    df: DataFrame,
    key: str | Sequence[str],
    batch: str,
    vocab: DataFrame,
    prompt: str = "question",
    target: str = "answer",
    tokens: Tokenizer | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Whole prompt and target of each row, padded to its batch's longest of each.

    Adds ``labels``: the mask with the prompt region set to 0. Batch maxima combine on
    the map side and are joined back, so one very large batch can be split by the join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    encoded = encode_texts(
        df, keys, {"_prompt": (F.col(prompt), None), "_target": (F.col(target), None)}, vocab, [batch], tokens, limits
    )
    # Kept, so that no text is tokenized again for the maxima.
    encoded = staged(encoded, "qa_rows")
    longest = encoded.groupBy(batch).agg(F.max(F.size("_prompt")).alias("_prompt_max"), F.max(F.size("_target")).alias("_target_max"))
    columns = _prompt_and_response(F.col("_prompt"), F.col("_target"), F.col("_prompt_max"), F.col("_target_max"))
    columns["labels"] = F.concat(
        filled(0, F.col("_prompt_max")), pad_right(ones_like(F.col("_target")), F.col("_target_max"))
    )
    return encoded.join(longest, batch).select(*keys, batch, *[c.alias(n) for n, c in columns.items()])


def decode(
    df: DataFrame,
    key: str | Sequence[str],
    ids: str,
    vocab: DataFrame,
    out: str = "decoded",
    separator: str = " ",
    limits: Limits = Limits(),
) -> DataFrame:
    """Ids -> text, special ids skipped; a row of special ids only gives the empty string."""
    keys = [key] if isinstance(key, str) else list(key)
    plain = F.filter(ids, lambda x: x >= RESERVED_IDS)
    occurrences = df.select(*keys, F.posexplode_outer(plain).alias("_pos", "id"))
    found = _look_up(occurrences, vocab, "id", limits.broadcast_rows, limits.broadcast_bytes, limits.head_rows)
    known = F.when(F.col("token").isNotNull(), F.struct("_pos", "token"))
    ordered = F.transform(F.array_sort(F.collect_list(known)), lambda x: x["token"])
    return found.groupBy(*keys).agg(F.array_join(ordered, separator).alias(out))
