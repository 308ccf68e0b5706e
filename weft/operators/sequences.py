"""Sequence shaping: token length (P15), truncation (P16), packing (W2),
length-grouped batches (W3), rank shards (W5), padding waste (A7).

Packing and hash-order batching need *global* positions.  They never use a
window without a partition over the rows: positions come from
:mod:`weft.operators.ordering` (range shards + broadcast shard offsets).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import col_, token_count, tokens
from weft.operators.ordering import SHARD, running_offsets, with_range_shards


# ---------------------------------------------------------------- P15 / P16

def token_length(c, tokenizer: Callable[[list[str]], list[int]] | None = None) -> Column:
    """Length in tokens.

    Default: whitespace tokens (``str.split()``), a JVM expression.  A model
    tokenizer can be given as ``texts -> lengths``; it runs in an Arrow-batched
    pandas UDF (one call per batch, never per row).
    """
    if tokenizer is None:
        return token_count(c)

    @F.pandas_udf(T.IntegerType())
    def _len(s: pd.Series) -> pd.Series:
        vals = s.fillna("").tolist()
        return pd.Series(list(tokenizer(vals)), dtype="int32")

    return _len(col_(c))


def truncate_tokens(c, max_length: int) -> Column:
    """The first ``max_length`` whitespace tokens (P16), as an array."""
    return F.slice(tokens(c), 1, max_length)


# ---------------------------------------------------------------- W2 packing

def pack_pieces(offsets: DataFrame, id_col: str, length: int, len_col: str = "_len",
                start_col: str = "_start") -> DataFrame:
    """Cut samples at multiples of ``length``.

    One row per (sample, pack) it touches: ``pack_id``, ``piece_start`` (offset
    inside the sample) and ``piece_len``.  A sample of n tokens touches at most
    ceil(n / length) + 1 packs, so the output grows linearly with the input.
    """
    s, n = F.col(start_col), F.col(len_col)
    first = F.floor(s / length)
    last = F.floor((s + n - 1) / length)
    packs = F.when(n > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return (
        offsets.select(id_col, start_col, len_col, *[c for c in offsets.columns
                                                     if c not in (id_col, start_col, len_col, SHARD)],
                       F.explode(packs).alias("pack_id"))
        .withColumn("piece_start", F.greatest(s, F.col("pack_id") * length) - s)
        .withColumn("piece_len",
                    F.least(s + n, (F.col("pack_id") + 1) * length) - s - F.col("piece_start"))
    )


def pack_summary(pieces: DataFrame, length: int, drop_last: bool = False) -> DataFrame:
    """Per pack: ``pack_id, n_tokens, n_docs``.  Exact packing leaves at most
    the final pack partial; ``drop_last`` removes it."""
    out = pieces.groupBy("pack_id").agg(
        F.sum("piece_len").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    if drop_last:
        out = out.where(F.col("n_tokens") == length)
    return out


def pack(df: DataFrame, id_col: str, len_col: str, length: int, sep: int = 1,
         drop_last: bool = False, n_shards: int | None = None) -> DataFrame:
    """Concatenate samples in ``id_col`` order into windows of ``length``
    tokens; every sample is followed by ``sep`` separator tokens.  Returns
    ``pack_id, n_tokens, n_docs``.  Tokens are conserved; no pack exceeds
    ``length``; a long sample spans several packs."""
    base = df.select(id_col, (F.col(len_col) + F.lit(sep)).alias("_len"))
    sharded = with_range_shards(base, id_col, n_shards)
    offs = running_offsets(sharded, [id_col], "_len")
    return pack_summary(pack_pieces(offs, id_col, length), length, drop_last)


def pack_texts(df: DataFrame, id_col: str, text_col: str, length: int,
               sep_token: str = "<|endoftext|>", n_shards: int | None = None) -> DataFrame:
    """W2 with the text of each pack: the pack's token slices re-joined with
    single spaces, in sample order; ``pack_id, text, n_tokens, n_docs``.

    Each sample is cut into its pieces *before* the explode (one slice per
    pack it touches), so a long sample is copied once, not once per pack.
    A pack holds at most ``length`` tokens, so the per-pack collect is
    bounded by ``length``.
    """
    toks = F.concat(tokens(text_col), F.array(F.lit(sep_token)))
    base = df.select(id_col, toks.alias("_toks")).withColumn("_len", F.size("_toks"))
    sharded = with_range_shards(base, id_col, n_shards)
    offs = running_offsets(sharded, [id_col], "_len")
    s, n = F.col("_start"), F.col("_len")
    first, last = F.floor(s / length), F.floor((s + n - 1) / length)

    def piece(p):
        lo = F.greatest(s, p * length)
        hi = F.least(s + n, (p + 1) * length)
        return F.struct(p.alias("pack_id"), F.slice("_toks", lo - s + 1, hi - lo).alias("piece"))

    pieces = F.when(n > 0, F.transform(F.sequence(first, last), piece))
    exploded = offs.select("_start", F.explode(pieces).alias("_p")).select(
        "_start", F.col("_p.pack_id").alias("pack_id"), F.col("_p.piece").alias("piece"))
    return exploded.groupBy("pack_id").agg(
        F.array_join(F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct(F.col("_start"), F.col("piece")))),
            lambda x: x["piece"])), " ").alias("text"),
        F.sum(F.size("piece")).alias("n_tokens"),
        F.count(F.lit(1)).alias("n_docs"))


# ---------------------------------------------------------------- W3 / W5 / A7

def hash_order_key(c) -> Column:
    """A 60-bit integer from md5 of the value's string form: a seeded shuffle
    order that both Spark and the SQL oracle can compute."""
    return F.conv(F.substring(F.md5(col_(c).cast("string")), 1, 15), 16, 10).cast("long")


def group_by_length(df: DataFrame, id_col: str, len_col: str, batch_size: int,
                    megabatch: int = 50, n_shards: int | None = None) -> DataFrame:
    """Shuffle (hash order), cut into megabatches of ``batch_size *
    megabatch`` rows, sort each by length descending, cut into batches.

    Adds ``h`` (hash order), ``rn`` (1-based position in hash order),
    ``megabatch_id``, ``batch_id`` (length grouped) and ``plain_batch_id``
    (hash order only, the "before").  Megabatches are bounded groups.
    """
    mb_rows = batch_size * megabatch
    keyed = df.withColumn("h", hash_order_key(id_col))
    sharded = with_range_shards(keyed, "h", n_shards)
    ranked = (running_offsets(sharded, ["h", id_col], F.lit(1), "_rn0")
              .withColumn("rn", F.col("_rn0") + 1).drop("_rn0", SHARD))
    ranked = (ranked.withColumn("megabatch_id", F.floor((F.col("rn") - 1) / mb_rows))
              .withColumn("plain_batch_id", F.floor((F.col("rn") - 1) / batch_size)))
    w = Window.partitionBy("megabatch_id").orderBy(F.col(len_col).desc(), "h", id_col)
    return (ranked.withColumn("_rn_mb", F.row_number().over(w))
            .withColumn("batch_id", F.col("megabatch_id") * megabatch
                        + F.floor((F.col("_rn_mb") - 1) / batch_size))
            .withColumn("rank_in_megabatch", F.col("_rn_mb")).drop("_rn_mb"))


def snake_rank(rn0: Column, world_size: int) -> Column:
    """Deal 0-based positions to ``world_size`` ranks in snake order."""
    w = F.lit(world_size)
    return F.when(F.pmod(F.floor(rn0 / w), F.lit(2)) == 0, F.pmod(rn0, w)) \
        .otherwise(w - 1 - F.pmod(rn0, w)).cast("int")


def rank_shards(grouped: DataFrame, world_size: int, bucket_col: str = "megabatch_id",
                pos_col: str = "rank_in_megabatch") -> DataFrame:
    """Balance tokens over ``world_size`` ranks.  Inside each bucket rows
    are taken in length-descending order (``pos_col``, 1-based) and dealt in
    snake order; no global sort."""
    return grouped.withColumn("rank", snake_rank(F.col(pos_col) - 1, world_size))


def padding_waste(df: DataFrame, batch_col: str, len_col: str) -> DataFrame:
    """A7 per batch: rows, tokens, longest, waste = 1 - tokens / (longest * rows)."""
    return df.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(len_col).alias("sum_len"),
        F.max(len_col).alias("max_len"),
    ).withColumn("waste", F.lit(1.0) - F.col("sum_len") / (F.col("max_len") * F.col("n_rows")))


def padding_waste_total(per_batch: DataFrame) -> DataFrame:
    """A7 overall: 1 - sum(tokens) / sum(longest * rows)."""
    return per_batch.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("sum_len").alias("sum_len"),
        (F.lit(1.0) - F.sum("sum_len") / F.sum(F.col("max_len") * F.col("n_rows"))).alias("waste"),
    )
