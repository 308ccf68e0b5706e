"""Queries for chat rendering, token lengths, packing and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.chat import render_chat, render_turn
from weft.functions.text import token_count, tokens
from weft.operators.ordering import (
    default_shards,
    running_offsets,
    shard_bounds,
    with_range_shards,
)
from weft.operators.records import collect_messages
from weft.operators.sequences import (
    group_by_length,
    pack,
    pack_pieces,
    pack_summary,
    padding_waste,
    rank_shards,
)
from weft.plans.registry import query
from weft.plans.sql_snippets import sql_chatml_turn, sql_hash_order, sql_token_count, sql_tokens
from weft.plans.tables import table

PACK_LEN = 512
SEP = 1


def chat_packs_df(spark: SparkSession, sf_dir: str, length: int = PACK_LEN,
                  sep: int = SEP) -> DataFrame:
    """Flagship: conversations -> messages -> ChatML text -> token packs.

    Rendered ChatML ends every message with a newline, so the token count of a
    conversation is the sum of its messages' counts.  Per-turn counts are
    computed where the turns are read and summed per conversation with a
    map-side partial aggregate, so a conversation holding a third of all
    turns leaves each map task as one row and is never gathered.  Only one
    row per conversation then goes to the range shards for the exact,
    shard-wise packing offsets.
    """
    turns = table(spark, sf_dir, "conversations")
    per_turn = turns.select("conv_id", token_count(render_turn("role", "text")).alias("n"))
    convs = per_turn.groupBy("conv_id").agg((F.sum("n") + F.lit(sep)).alias("_len"))
    sharded = with_range_shards(convs, "conv_id", bounds=shard_bounds(turns, "conv_id", default_shards(turns)))
    offs = running_offsets(sharded, ["conv_id"], "_len")
    return pack_summary(pack_pieces(offs, "conv_id", length), length).select(
        F.col("pack_id").cast("long").alias("pack_id"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_docs").cast("long").alias("n_docs"))


_TURN_TOKENS = sql_token_count(sql_chatml_turn("role", "text"))

query("chat_packs", "A6 P5 P15 W2", sql=f"""
WITH t AS (SELECT conv_id, {_TURN_TOKENS} AS n FROM conversations),
c AS (SELECT conv_id, CAST(sum(n) + {SEP} AS BIGINT) AS len FROM t GROUP BY conv_id),
o AS (SELECT conv_id, len,
             CAST(sum(len) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len AS BIGINT) AS start
      FROM c),
p AS (SELECT start, len, unnest(range(start // {PACK_LEN}, (start + len - 1) // {PACK_LEN} + 1)) AS pack_id
      FROM o)
SELECT CAST(pack_id AS BIGINT) AS pack_id,
       CAST(sum(least(start + len, (pack_id + 1) * {PACK_LEN}) - greatest(start, pack_id * {PACK_LEN})) AS BIGINT) AS n_tokens,
       CAST(count(*) AS BIGINT) AS n_docs
FROM p GROUP BY pack_id
""")(chat_packs_df)


@query("chat_render", "A6 P5", sql="""
SELECT conv_id,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text,
       CAST(count(*) AS BIGINT) AS n_turns
FROM conversations GROUP BY conv_id
""")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = collect_messages(table(spark, sf_dir, "conversations"))
    return msgs.select("conv_id", render_chat("messages").alias("text"),
                       F.size("messages").cast("long").alias("n_turns"))


# ---------------------------------------------------------------- documents

MAX_LEN = 512
BATCH = 8
MEGABATCH = 50
WORLD = 4

_DOC_TOKENS = sql_token_count("text")


def _doc_lengths(spark: SparkSession, sf_dir: str, cut: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = token_count("text")
    return docs.select("doc_id", (F.least(n, F.lit(cut)) if cut else n).alias("len"))


@query("doc_tokens", "P15 P16", sql=f"""
SELECT doc_id,
       {_DOC_TOKENS} AS n_tokens,
       CAST(least({_DOC_TOKENS}, {MAX_LEN}) AS INTEGER) AS kept_tokens,
       {_DOC_TOKENS} > {MAX_LEN} AS truncated,
       list_extract(list_slice({{tok}}, 1, {MAX_LEN}), -1) AS last_kept
FROM documents
""".replace("{tok}", __import__("weft.plans.sql_snippets", fromlist=["x"]).sql_tokens("text")))
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Split once; count, cut and pick from the same token array.
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("_t"))
    kept = F.slice("_t", 1, MAX_LEN)
    return docs.select(
        "doc_id",
        F.size("_t").alias("n_tokens"),
        F.size(kept).alias("kept_tokens"),
        (F.size("_t") > MAX_LEN).alias("truncated"),
        F.try_element_at(kept, F.lit(-1)).alias("last_kept"),
    )


@query("doc_packs", "P15 W2", sql=f"""
WITH c AS (SELECT doc_id, CAST({_DOC_TOKENS} + {SEP} AS BIGINT) AS len FROM documents),
o AS (SELECT doc_id, len,
             CAST(sum(len) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len AS BIGINT) AS start
      FROM c),
p AS (SELECT start, len, unnest(range(start // {PACK_LEN}, (start + len - 1) // {PACK_LEN} + 1)) AS pack_id FROM o)
SELECT CAST(pack_id AS BIGINT) AS pack_id,
       CAST(sum(least(start + len, (pack_id + 1) * {PACK_LEN}) - greatest(start, pack_id * {PACK_LEN})) AS BIGINT) AS n_tokens,
       CAST(count(*) AS BIGINT) AS n_docs
FROM p GROUP BY pack_id
""")
def doc_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_doc_lengths(spark, sf_dir), "doc_id", "len", PACK_LEN, sep=SEP).select(
        F.col("pack_id").cast("long").alias("pack_id"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_docs").cast("long").alias("n_docs"))


SEP_TOKEN = "<|endoftext|>"


@query("doc_pack_texts", "W2 P15", sql=f"""
WITH d AS (SELECT doc_id, list_concat({sql_tokens('text')}, ['{SEP_TOKEN}']) AS toks FROM documents),
l AS (SELECT doc_id, toks,
             CAST(sum(len(toks)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  - len(toks) AS BIGINT) AS start FROM d),
u AS (SELECT doc_id, start, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM l),
p AS (SELECT doc_id, tok, start + i - 1 AS pos, (start + i - 1) // {PACK_LEN} AS pack_id FROM u)
SELECT CAST(pack_id AS BIGINT) AS pack_id, string_agg(tok, ' ' ORDER BY pos) AS text,
       CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs
FROM p GROUP BY pack_id
""")
def doc_pack_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.operators.sequences import pack_texts

    docs = table(spark, sf_dir, "documents")
    out = pack_texts(docs, "doc_id", "text", PACK_LEN, sep_token=SEP_TOKEN)
    return out.select(F.col("pack_id").cast("long").alias("pack_id"), "text",
                      F.col("n_tokens").cast("long").alias("n_tokens"),
                      F.col("n_docs").cast("long").alias("n_docs"))


_GROUPED = f"""
WITH d AS (SELECT doc_id, CAST(least({_DOC_TOKENS}, {MAX_LEN}) AS INTEGER) AS len,
                  {sql_hash_order('doc_id')} AS h FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS rn FROM d),
m AS (SELECT *, (rn - 1) // {BATCH * MEGABATCH} AS megabatch_id, (rn - 1) // {BATCH} AS plain_batch_id FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY megabatch_id ORDER BY len DESC, h, doc_id) AS rank_in_megabatch FROM m),
b AS (SELECT *, megabatch_id * {MEGABATCH} + (rank_in_megabatch - 1) // {BATCH} AS batch_id FROM g)
"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by_length(_doc_lengths(spark, sf_dir, MAX_LEN), "doc_id", "len", BATCH, MEGABATCH)


def _batches_out(df: DataFrame) -> DataFrame:
    return df.select(
        F.col(df.columns[0]).cast("long").alias("batch_id"),
        F.col("n_rows").cast("long").alias("n_rows"),
        F.col("sum_len").cast("long").alias("sum_len"),
        F.col("max_len").cast("int").alias("max_len"),
        F.round("waste", 6).alias("waste"))


_BATCH_AGG = """SELECT CAST({b} AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(len) AS BIGINT) AS sum_len, CAST(max(len) AS INTEGER) AS max_len,
       round(1 - sum(len) / (max(len) * count(*)), 6) AS waste
FROM b GROUP BY {b}"""


@query("length_grouped_batches", "W3 L3 A7", sql=_GROUPED + _BATCH_AGG.format(b="batch_id"))
def length_grouped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches_out(padding_waste(_grouped(spark, sf_dir), "batch_id", "len"))


@query("hash_order_batches", "W3 A7", sql=_GROUPED + _BATCH_AGG.format(b="plain_batch_id"))
def hash_order_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches_out(padding_waste(_grouped(spark, sf_dir), "plain_batch_id", "len"))


@query("padding_summary", "A7 W3", sql=_GROUPED + f""",
per AS (SELECT 'length_grouped' AS ordering, batch_id AS k, count(*) AS n, sum(len) AS s, max(len) AS mx FROM b GROUP BY batch_id
        UNION ALL
        SELECT 'hash_order', plain_batch_id, count(*), sum(len), max(len) FROM b GROUP BY plain_batch_id)
SELECT ordering, CAST(count(*) AS BIGINT) AS n_batches, CAST(sum(n) AS BIGINT) AS n_rows,
       CAST(sum(s) AS BIGINT) AS sum_len, round(1 - sum(s) / sum(mx * n), 6) AS waste
FROM per GROUP BY ordering
""")
def padding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.operators.sequences import padding_waste_total

    g = _grouped(spark, sf_dir)
    after = padding_waste_total(padding_waste(g, "batch_id", "len")).withColumn(
        "ordering", F.lit("length_grouped"))
    before = padding_waste_total(padding_waste(g, "plain_batch_id", "len")).withColumn(
        "ordering", F.lit("hash_order"))
    return after.unionByName(before).select(
        "ordering", F.col("n_batches").cast("long").alias("n_batches"),
        F.col("n_rows").cast("long").alias("n_rows"),
        F.col("sum_len").cast("long").alias("sum_len"), F.round("waste", 6).alias("waste"))


@query("rank_balance", "W5 W3", sql=_GROUPED + f""",
k AS (SELECT *, CASE WHEN ((rank_in_megabatch - 1) // {WORLD}) % 2 = 0 THEN (rank_in_megabatch - 1) % {WORLD}
                     ELSE {WORLD} - 1 - (rank_in_megabatch - 1) % {WORLD} END AS rank FROM b)
SELECT CAST(rank AS INTEGER) AS rank, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(len) AS BIGINT) AS n_tokens
FROM k GROUP BY rank
""")
def rank_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_shards(_grouped(spark, sf_dir), WORLD)
    return ranked.groupBy("rank").agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                                      F.sum("len").cast("long").alias("n_tokens"))
