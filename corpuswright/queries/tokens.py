"""Vocabulary, encoding, padding, masks, labels and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import filters as R
from ..operators import prompts as P
from ..operators import tokens as T
from ..operators import vocab as V
from ..operators.packing import mono_ids, pack_blocks, two_sided_ids
from ..session import cut_lineage
from . import fixtures as X
from .fixtures import arr, encoded_ctes, joined, ones_zeros_sql, pad_mask_sql, pad_sql, with_ctes
from .prompts import expanded
from .registry import query

S = X.SPECIALS
SRC, NEW = 256, 256
WIDTH = 64


@query(with_ctes("vocab", "SELECT token, n, id FROM vocab"))
def build_vocab(spark, sf):
    return V.build_vocab(X.table(spark, sf, "documents"), "text", X.VOCAB_SIZE, S)


DOC_IDS = encoded_ctes("enc", "documents", "doc_id", "text")


@query(with_ctes("vocab", f"SELECT doc_id, {arr('ids')} AS ids, {arr(f'list_concat([{S.bos}], ids)[1:{SRC}]')} AS cut FROM enc", DOC_IDS))
def encode(spark, sf):
    v, text = X.vocabulary(spark, sf), F.col("raw_text")
    return X.mono(spark, sf).select(
        "doc_id", joined(v.encode(text)).alias("ids"), joined(v.encode(text, SRC, bos=True)).alias("cut")
    )


@query(with_ctes("vocab", f"SELECT doc_id, {arr('ids')} AS ids FROM enc", DOC_IDS))
def encode_by_join(spark, sf):
    docs = X.mono(spark, sf).select("doc_id", "raw_text")
    vocab = V.build_vocab(docs, "raw_text", X.VOCAB_SIZE, S)
    return V.encode_by_join(docs, "doc_id", "raw_text", vocab, S).select("doc_id", joined("ids").alias("ids"))


def _char_counts():
    return lambda texts: [[len(line) for line in t.split("\n")] for t in texts]


@query(f"SELECT doc_id, {arr('list_transform(string_split(text, chr(10)), lambda t: length(t))')} AS ids FROM documents")
def encode_external(spark, sf):
    """An external tokenizer plugged in as an Arrow function (here: one id per line, its length)."""
    tokenizer = V.encode_with(_char_counts)
    return X.mono(spark, sf).select("doc_id", joined(tokenizer(F.col("raw_text"))).alias("ids"))


# --- token rows: whole texts in rows of 64 ids ------------------------------------------------------------

ROW_CTES = {
    **DOC_IDS,
    "chunks": f"""SELECT doc_id, unnest(list_transform(range((len(ids) + {WIDTH - 1}) // {WIDTH}),
        lambda i: {{'i': i, 'ids': ids[i * {WIDTH} + 1 : (i + 1) * {WIDTH}]}})) AS w FROM enc""",
    "rows": f"""SELECT doc_id||':'||w.i AS row_id, w.ids AS raw, {pad_sql('w.ids', WIDTH, S.pad)} AS ids,
        {pad_mask_sql('w.ids', WIDTH)} AS mask FROM chunks""",
}


def token_rows(spark, sf):
    v = X.vocabulary(spark, sf)
    ids = X.mono(spark, sf).select("doc_id", v.encode(F.col("raw_text")).alias("ids"))
    return T.token_windows(ids, "ids", WIDTH, S.pad, "doc_id")


@query(with_ctes("vocab", f"SELECT row_id, {arr('ids')} AS input_ids, {arr('mask')} AS attention_mask FROM rows", ROW_CTES))
def token_windows(spark, sf):
    return token_rows(spark, sf).select("row_id", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


@query(with_ctes("vocab", f"""
SELECT row_id, {arr(pad_sql('raw', 80, S.pad))} AS right_ids, {arr(pad_sql('raw', 80, S.pad, 'left'))} AS left_ids,
       {arr(pad_mask_sql('raw', 80, 'left'))} AS left_mask, {arr(pad_mask_sql('raw', 80))} AS right_mask FROM rows""", ROW_CTES))
def pad(spark, sf):
    raw = F.filter("input_ids", lambda x: x != S.pad)
    rows = token_rows(spark, sf).withColumn("raw", raw)
    return rows.select(
        "row_id",
        joined(A.pad_to(F.col("raw"), 80, S.pad)).alias("right_ids"),
        joined(A.pad_to(F.col("raw"), 80, S.pad, "left")).alias("left_ids"),
        joined(A.pad_mask(F.col("raw"), 80, "left")).alias("left_mask"),
        joined(A.pad_mask(F.col("raw"), 80)).alias("right_mask"),
    )


@query(with_ctes("vocab", f"""
SELECT row_id, {arr(f'CASE WHEN raw[-1] = {S.unk} THEN raw ELSE list_concat(raw, [{S.unk}]) END')} AS ended FROM rows""", ROW_CTES))
def append_eos(spark, sf):
    """Rows that end in the id already stay as they are (the unknown id plays the end, so both cases occur)."""
    raw = F.filter("input_ids", lambda x: x != S.pad)
    return token_rows(spark, sf).select("row_id", joined(A.append_eos(raw, S.unk)).alias("ended"))


SLOT = f"coalesce(list_position(ids, {S.pad}), {WIDTH})"


@query(with_ctes("vocab", f"""
SELECT row_id, {arr(f'[CASE WHEN i = {SLOT} THEN {S.eos} ELSE x END for x, i in ids]')} AS input_ids,
       {arr(f'[CASE WHEN i = {SLOT} THEN 1 ELSE x END for x, i in mask]')} AS attention_mask FROM rows""", ROW_CTES))
def append_eos_right_pad(spark, sf):
    slot = A.eos_slot(F.col("input_ids"), S.pad)
    rows = token_rows(spark, sf).withColumn("slot", slot)
    return rows.select(
        "row_id",
        joined(A.put_at(F.col("input_ids"), F.col("slot"), S.eos)).alias("input_ids"),
        joined(A.put_at(F.col("attention_mask"), F.col("slot"), 1)).alias("attention_mask"),
    )


@query(with_ctes("vocab", f"""
SELECT row_id, (coalesce(list_position(ids, {S.pad}), 0) - 1)::INT AS first_pad,
       (coalesce(list_position(ids, {S.unk}), 0) - 1)::INT AS first_unknown,
       (coalesce(list_position(list_transform(ids, lambda x: x <> {S.unk}), true), 0) - 1)::INT AS first_known FROM rows""", ROW_CTES))
def first_index(spark, sf):
    ids = F.col("input_ids")
    return token_rows(spark, sf).select(
        "row_id",
        A.first_index(ids, S.pad).alias("first_pad"),
        A.first_index(ids, S.unk).alias("first_unknown"),
        A.first_index_not(ids, S.unk).alias("first_known"),
    )


@query(with_ctes("vocab", f"SELECT row_id, {arr(f'[CASE WHEN x = {S.pad} THEN -100 ELSE x END for x in ids]')} AS labels FROM rows", ROW_CTES))
def labels_ignore_pad(spark, sf):
    return token_rows(spark, sf).select("row_id", joined(A.ignore_value(F.col("input_ids"), S.pad)).alias("labels"))


@query(with_ctes("vocab", f"""
SELECT row_id, {arr(f'[CASE WHEN i <= n OR x = {S.pad} THEN -100 ELSE x END for x, i in ids]')} AS right_labels,
       {arr(f'[CASE WHEN i > first AND i <= first + n OR x = {S.pad} THEN -100 ELSE x END for x, i in lids]')} AS left_labels,
       {arr(ones_zeros_sql(WIDTH, 'n'))} AS prefix_mask
FROM (SELECT row_id, ids, len(raw) // 3 AS n, {WIDTH} - len(raw) AS first, {pad_sql('raw', WIDTH, S.pad, 'left')} AS lids FROM rows)""", ROW_CTES))
def labels_ignore_prompt(spark, sf):
    """The first third of a row is its prompt, in right-padded and in left-padded rows."""
    raw = F.filter("input_ids", lambda x: x != S.pad)
    rows = token_rows(spark, sf).withColumn("raw", raw).withColumn("n", F.floor(F.size("raw") / 3).cast("int"))
    rows = rows.withColumn("right", A.ignore_value(F.col("input_ids"), S.pad)).withColumn(
        "left", A.ignore_value(A.pad_to(F.col("raw"), WIDTH, S.pad, "left"), S.pad)
    )
    start = A.first_index_not(F.col("left"), A.IGNORE)
    return rows.select(
        "row_id",
        joined(A.ignore_span(F.col("right"), F.lit(0), F.col("n"))).alias("right_labels"),
        joined(A.ignore_span(F.col("left"), start, F.col("n"))).alias("left_labels"),
        joined(A.leading_ones(F.lit(WIDTH), F.col("n"))).alias("prefix_mask"),
    )


SHIFT = f"list_concat([{S.bos}], [CASE WHEN x = {S.pad} THEN -100 ELSE x END for x in ids][1:{WIDTH - 1}])"


@query(with_ctes("vocab", f"""
SELECT row_id, {arr(f'[CASE WHEN x = -100 THEN {S.pad} ELSE x END for x in {SHIFT}]')} AS decoder_input_ids,
       {arr(f'[CASE WHEN x = -100 THEN 0 ELSE 1 END for x in {SHIFT}]')} AS decoder_attention_mask FROM rows""", ROW_CTES))
def shift_right(spark, sf):
    rows = token_rows(spark, sf).withColumn("labels", A.ignore_value(F.col("input_ids"), S.pad))
    return rows.select(
        "row_id",
        joined(A.shift_right(F.col("labels"), S.bos, S.pad)).alias("decoder_input_ids"),
        joined(A.shift_right_mask(F.col("labels"), S.bos)).alias("decoder_attention_mask"),
    )


@query(with_ctes("vocab", f"""
SELECT doc_id, {arr(pad_sql('ids', '(SELECT max(len(ids)) FROM enc)', S.pad))} AS ids FROM enc""", DOC_IDS))
def pad_to_max(spark, sf):
    """Right-padded to the longest row: texts are encoded once, and the length is one aggregate, read back as a number."""
    v = X.vocabulary(spark, sf)
    rows = cut_lineage(X.mono(spark, sf).select("doc_id", v.encode(F.col("raw_text")).alias("ids")), "pad-to-max")
    longest = rows.agg(F.max(F.size("ids"))).first()[0]
    return rows.select("doc_id", joined(A.pad_to(F.col("ids"), longest, S.pad)).alias("ids"))


DECODE_CTES = {
    **ROW_CTES,
    "named": """SELECT row_id, string_agg(v.token, ' ' ORDER BY ix) AS text
        FROM (SELECT row_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS ix FROM rows) t JOIN vocab v ON v.id = t.id
        GROUP BY row_id""",
}


@query(with_ctes("vocab", f"SELECT r.row_id, coalesce({X.strip_sql('n.text')}, '') AS text FROM rows r LEFT JOIN named n ON n.row_id = r.row_id", DECODE_CTES))
def decode(spark, sf):
    v = X.vocabulary(spark, sf)
    rows = token_rows(spark, sf).withColumn("ids", A.ignore_value(F.col("input_ids"), S.pad))
    return rows.select("row_id", v.decode(F.col("ids")).alias("text"))


# --- chains -----------------------------------------------------------------------------------------------

TRAIN_CTES = {
    **encoded_ctes("penc", "prompted", "seq, direction", "prompt"),
    **encoded_ctes("fenc", "prompted", "seq, direction", "prompt||tgt_text"),
    "pair_ids": """SELECT f.seq, f.direction, f.ids AS full_ids, p.ids AS prompt_ids
        FROM fenc f JOIN penc p ON p.seq = f.seq AND p.direction = f.direction""",
    "train_left": f"""SELECT *, [CASE WHEN x = {S.pad} THEN -100 ELSE x END for x in input_ids] AS labels0,
            coalesce(list_position(list_transform(input_ids, lambda q: q <> {S.pad}), true), 0) AS first
        FROM (SELECT seq, direction, least(len(prompt_ids), {SRC}) AS n,
            {pad_sql(f'list_concat(list_concat([{S.bos}], full_ids)[1:{SRC + NEW - 1}], [{S.eos}])', SRC + NEW, S.pad, 'left')} AS input_ids,
            {pad_mask_sql(f'list_concat(list_concat([{S.bos}], full_ids)[1:{SRC + NEW - 1}], [{S.eos}])', SRC + NEW, 'left')} AS attention_mask
        FROM pair_ids)""",
    "train_right": f"""SELECT seq, direction, n,
            [CASE WHEN i = slot THEN {S.eos} ELSE x END for x, i in padded] AS input_ids,
            [CASE WHEN i = slot THEN 1 ELSE x END for x, i in mask] AS attention_mask
        FROM (SELECT *, coalesce(list_position(padded, {S.pad}), {SRC + NEW}) AS slot
            FROM (SELECT seq, direction, least(len(prompt_ids), {SRC}) AS n,
                {pad_sql(f'list_concat([{S.bos}], full_ids)[1:{SRC + NEW}]', SRC + NEW, S.pad)} AS padded,
                {pad_mask_sql(f'list_concat([{S.bos}], full_ids)[1:{SRC + NEW}]', SRC + NEW)} AS mask FROM pair_ids))""",
}


def rendered(spark, sf):
    return P.full_text(P.render_prompt(expanded(spark, sf)))


def texts(df, *keys):
    """Model columns as text."""
    return df.select(*keys, *[joined(c).alias(c) for c in R.MODEL_COLUMNS if c in df.columns])


@query(with_ctes("prompted vocab", f"""
SELECT seq, direction, {arr('input_ids')} AS input_ids, {arr('attention_mask')} AS attention_mask,
       {arr('[CASE WHEN i >= first AND i < first + n THEN -100 ELSE x END for x, i in labels0]')} AS labels FROM train_left""", TRAIN_CTES))
def encode_train_left(spark, sf):
    rows = T.encode_train_left(rendered(spark, sf), X.vocabulary(spark, sf), SRC, NEW, ignore_prompt=True)
    return texts(R.select_model_columns(rows, ("seq", "direction")), "seq", "direction")


@query(with_ctes("prompted vocab", f"SELECT seq, direction, {arr('labels0')} AS labels FROM train_left", TRAIN_CTES))
def encode_train_left_whole_loss(spark, sf):
    rows = T.encode_train_left(rendered(spark, sf), X.vocabulary(spark, sf), SRC, NEW)
    return rows.select("seq", "direction", joined("labels").alias("labels"))


@query(with_ctes("prompted vocab", f"""
SELECT seq, direction, {arr('input_ids')} AS input_ids, {arr('attention_mask')} AS attention_mask,
       {arr(f'[CASE WHEN i <= n THEN -100 WHEN x = {S.pad} THEN -100 ELSE x END for x, i in input_ids]')} AS labels,
       {arr(ones_zeros_sql(SRC + NEW, 'n'))} AS prefix_mask FROM train_right""", TRAIN_CTES))
def encode_train_right(spark, sf):
    rows = T.encode_train_right(rendered(spark, sf), X.vocabulary(spark, sf), SRC, NEW)
    return texts(R.select_model_columns(rows, ("seq", "direction")), "seq", "direction")


IN_SQL = f"list_concat([{S.bos}], i.ids)[1:{SRC}]"
OUT_SQL = f"list_concat([{S.bos}], o.ids)[1:{NEW}]"


@query(with_ctes("prompted vocab", f"""
SELECT seq, direction, {arr('input_ids')} AS input_ids, {arr('attention_mask')} AS attention_mask,
       {arr(f'[CASE WHEN x = {S.pad} THEN -100 ELSE x END for x in target]')} AS labels
FROM (SELECT i.seq, i.direction, {pad_sql(IN_SQL, SRC, S.pad, 'left')} AS input_ids,
             {pad_mask_sql(IN_SQL, SRC, 'left')} AS attention_mask, {pad_sql(OUT_SQL, NEW, S.pad, 'left')} AS target
      FROM ienc i JOIN oenc o ON o.seq = i.seq AND o.direction = i.direction)""", {
    **encoded_ctes("ienc", "prompted", "seq, direction", "'Translate to '||tgt_name||': '||src_text"),
    **encoded_ctes("oenc", "prompted", "seq, direction", "tgt_text"),
}))
def encode_pair(spark, sf):
    rows = P.render_encdec(expanded(spark, sf), "instruct")
    return texts(T.encode_pair(rows, X.vocabulary(spark, sf), SRC, NEW), "seq", "direction")


CHAT_CTES = {
    **encoded_ctes("penc", "instr", "conv_id, turn", "'<s>[INST] '||inputs||' [/INST]'"),
    **encoded_ctes("fenc", "instr", "conv_id, turn", "'<s>[INST] '||inputs||' [/INST] '||targets||'</s>'"),
    "chat": f"""SELECT conv_id, turn, n, input_ids, attention_mask,
            coalesce(list_position(list_transform(input_ids, lambda q: q <> {S.pad}), true), 0) AS first
        FROM (SELECT f.conv_id, f.turn, least(len(p.ids), {SRC}) AS n,
            {pad_sql(f'f.ids[1:{SRC + NEW - 1}]', SRC + NEW - 1, S.pad, 'left')} AS input_ids,
            {pad_mask_sql(f'f.ids[1:{SRC + NEW - 1}]', SRC + NEW - 1, 'left')} AS attention_mask
        FROM fenc f JOIN penc p ON p.conv_id = f.conv_id AND p.turn = f.turn)""",
}


@query(with_ctes("instr vocab", f"""
SELECT conv_id, turn, {arr('input_ids')} AS input_ids, {arr('attention_mask')} AS attention_mask,
       {arr(f'[CASE WHEN i >= first AND i < first + n THEN -100 WHEN x = {S.pad} THEN -100 ELSE x END for x, i in input_ids]')} AS labels
FROM chat""", CHAT_CTES))
def encode_instruction(spark, sf):
    rows = T.encode_instruction(X.instructions(spark, sf), X.vocabulary(spark, sf), src_len=SRC, new_len=NEW)
    return texts(rows, "conv_id", "turn")


@query(with_ctes("prompted vocab", f"""
SELECT seq, direction, {arr(pad_sql(f'list_concat([{S.bos}], ids)[1:{SRC}]', SRC, S.pad, 'left'))} AS input_ids,
       {arr(pad_mask_sql(f'list_concat([{S.bos}], ids)[1:{SRC}]', SRC, 'left'))} AS attention_mask,
       {arr(pad_mask_sql(f'list_concat([{S.bos}], ids)[1:{SRC}]', SRC, 'left'))} AS prefix_mask FROM penc""",
    encoded_ctes("penc", "prompted", "seq, direction", "prompt")))
def encode_test(spark, sf):
    rows = T.encode_test(P.render_prompt(expanded(spark, sf)), X.vocabulary(spark, sf), SRC, prefix_lm=True)
    return texts(rows, "seq", "direction")


@query(with_ctes("instr vocab", f"""
SELECT conv_id, turn, {arr(pad_sql(f'ids[1:{SRC}]', SRC, S.pad, 'left'))} AS input_ids,
       {arr(pad_mask_sql(f'ids[1:{SRC}]', SRC, 'left'))} AS attention_mask FROM penc""",
    encoded_ctes("penc", "instr", "conv_id, turn", "'<s>[INST] '||inputs||' [/INST]'")))
def encode_instruction_test(spark, sf):
    rows = T.encode_instruction_test(X.instructions(spark, sf), X.vocabulary(spark, sf), src_len=SRC)
    return texts(rows, "conv_id", "turn")


# --- packing ----------------------------------------------------------------------------------------------

BLOCK, BATCH = 512, 100


def pack_sql(src: dict[str, str], by: str, key: str, batch: int | None = None) -> dict[str, str]:
    """Token-level packing: number the tokens of a source or batch, cut by position."""
    number = f"(row_number() OVER (PARTITION BY {by} ORDER BY {key}) - 1) // {batch}" if batch else "0::BIGINT"
    return {
        **src,
        "batched": f"SELECT *, {number} AS batch FROM items",
        "toks": f"SELECT {by}, batch, {key}, unnest(ids) AS id, generate_subscripts(ids, 1) AS ix FROM batched",
        "numbered": f"SELECT *, row_number() OVER (PARTITION BY {by}, batch ORDER BY {key}, ix) - 1 AS p FROM toks",
        "blocks": f"""SELECT {by}, batch, p // {BLOCK} AS block_no, list(id ORDER BY p) AS ids FROM numbered
            GROUP BY ALL HAVING count(*) = {BLOCK}""",
    }


PACK_OUT = f"SELECT lang, batch, block_no, {arr('ids')} AS input_ids FROM blocks"
STRIPPED = encoded_ctes("enc", "documents", "doc_id", X.strip_sql("text"))


def mono_items(cap: int | None) -> dict[str, str]:
    cut = f"[1:{cap}]" if cap else ""
    return {**STRIPPED, "items": f"""SELECT d.lang, e.doc_id, list_concat(list_concat([{S.bos}], e.ids){cut}, [{S.eos}]) AS ids
        FROM enc e JOIN documents d ON d.doc_id = e.doc_id"""}


def packed(spark, sf, cap=None, batch=None):
    v = X.vocabulary(spark, sf)
    ids = X.mono(spark, sf).select("lang", "doc_id", mono_ids(v, F.col("raw_text"), cap).alias("ids"))
    blocks = pack_blocks(ids, "ids", "doc_id", BLOCK, ("lang",), batch)
    return blocks.select("lang", "batch", "block_no", joined("input_ids").alias("input_ids"))


@query(with_ctes("vocab", PACK_OUT, pack_sql(mono_items(None), "lang", "doc_id")))
def pack_mono(spark, sf):
    """Whole texts, one remainder per language."""
    return packed(spark, sf)


@query(with_ctes("vocab", PACK_OUT, pack_sql(mono_items(None), "lang", "doc_id", BATCH)))
def pack_mono_batches(spark, sf):
    """Whole texts, a remainder per batch of rows."""
    return packed(spark, sf, None, BATCH)


@query(with_ctes("vocab", PACK_OUT, pack_sql(mono_items(64), "lang", "doc_id", BATCH)))
def pack_mono_limit(spark, sf):
    """The token limit per text is the feature here."""
    return packed(spark, sf, 64, BATCH)


SPARSE = "('0x'||substr(md5(doc_id::VARCHAR),1,15))::BIGINT"
SPARSE_ITEMS = {**STRIPPED, "items": f"""SELECT CASE WHEN d.doc_id % 5 <> 0 THEN d.lang END AS lang, {SPARSE.replace('doc_id', 'd.doc_id')} AS key,
    list_concat(list_concat([{S.bos}], e.ids), [{S.eos}]) AS ids FROM enc e JOIN documents d ON d.doc_id = e.doc_id"""}


def sparse(df):
    """Hashed keys, and no language for every fifth row."""
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    return df.withColumn("key", key).withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))


@query(with_ctes("vocab", PACK_OUT, pack_sql(SPARSE_ITEMS, "lang", "key")))
def pack_sparse_keys(spark, sf):
    v = X.vocabulary(spark, sf)
    rows = sparse(X.mono(spark, sf)).select("lang", "key", mono_ids(v, F.col("raw_text")).alias("ids"))
    blocks = pack_blocks(rows, "ids", "key", BLOCK, ("lang",))
    return blocks.select("lang", "batch", "block_no", joined("input_ids").alias("input_ids"))


@query(with_ctes("parallel vocab", f"""
SELECT lang_a, batch, block_no, {arr('ids')} AS input_ids, {arr(f"list_transform(range({BLOCK}), lambda q: 0)")} AS prefix_mask FROM blocks""",
    pack_sql({
        **encoded_ctes("ea", "parallel", "seq", "text_a"),
        **encoded_ctes("eb", "parallel", "seq", "text_b"),
        "items": f"""SELECT p.lang_a, p.seq, list_concat(
            CASE WHEN p.text_a = '' THEN [] ELSE list_concat(list_concat([{S.bos}], ea.ids), [{S.eos}]) END,
            CASE WHEN p.text_b = '' THEN [] ELSE list_concat(list_concat([{S.bos}], eb.ids), [{S.eos}]) END) AS ids
            FROM parallel p JOIN ea ON ea.seq = p.seq JOIN eb ON eb.seq = p.seq""",
    }, "lang_a", "seq")))
def pack_two_sided(spark, sf):
    v = X.vocabulary(spark, sf)
    ids = two_sided_ids(v, [F.col("text_a"), F.col("text_b")])
    rows = X.parallel(spark, sf).select("lang_a", "seq", ids.alias("ids"))
    blocks = pack_blocks(rows, "ids", "seq", BLOCK, ("lang_a",), prefix_mask=True)
    return blocks.select("lang_a", "batch", "block_no", joined("input_ids").alias("input_ids"), joined("prefix_mask").alias("prefix_mask"))


@query(with_ctes("parallel vocab", f"SELECT lang_a, batch, block_no, {arr('ids')} AS input_ids FROM blocks",
    pack_sql({
        "combined": f"""SELECT lang_a, seq, CASE WHEN {X.uniform_sql('seq')} < 0.5 THEN text_a||' '||text_b
            ELSE text_b||' '||text_a END AS raw_text FROM parallel""",
        **encoded_ctes("enc", "combined", "seq", X.strip_sql("raw_text")),
        "items": f"""SELECT c.lang_a, c.seq, list_concat(list_concat([{S.bos}], e.ids), [{S.eos}]) AS ids
            FROM combined c JOIN enc e ON e.seq = c.seq""",
    }, "lang_a", "seq")))
def pack_web_parallel(spark, sf):
    v = X.vocabulary(spark, sf)
    rows = R.join_sides_random(X.parallel(spark, sf), X.SEED)
    ids = rows.select("lang_a", "seq", mono_ids(v, F.col("raw_text")).alias("ids"))
    blocks = pack_blocks(ids, "ids", "seq", BLOCK, ("lang_a",))
    return blocks.select("lang_a", "batch", "block_no", joined("input_ids").alias("input_ids"))
