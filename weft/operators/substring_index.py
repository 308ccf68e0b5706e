"""Substring joins through an inverted index of n-grams and words.

"Which texts contain which needles" has no equi-key.  Here a needle stands for
one of its grams (six characters, three, or the whole needle if it is shorter) or of the
whole words that its texts must hold: the one that fewest texts hold.  Texts list
their grams and words, only those that some needle has are kept, and a needle
meets the texts of its rarest one alone; the exact test follows on those pairs.
Everything is a shuffle on (group, gram), of what a sieve of bits lets through where the
texts are read: first the grams that some needle has, then the rarest ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM, LONG_GRAM = 3, 6
#: Bits of a sieve, 64 in a row that every task gets.
SIEVE_BITS = 1 << 24


def grams(text: str, size: int) -> Column:
    """The distinct substrings of ``size`` characters of a column."""
    if size == 0:
        return F.array(F.lit(""))
    all_ = F.expr(f"transform(sequence(1, length({text}) - {size - 1}), i -> substring({text}, i, {size}))")
    return F.when(F.length(text) >= size, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame, text: str, sizes: list[int], words: bool, not_word: str) -> tuple[DataFrame, Column]:
    """A row with ``_gram`` for every gram of these sizes and every word of a text, and the test
    that leaves one row for a gram that comes again in its text.  Grams are numbers, 8 x place +
    size (7: a word), until a row is made of them."""
    codes = [F.array(F.lit(8)) if g == 0 else F.when(
        F.length(text) >= g, F.expr(f"sequence({8 + g}, 8 * (length({text}) - {g - 1}) + {g}, 8)"))
        .otherwise(F.array().cast("array<int>")) for g in sizes]
    df = texts.where(F.col(text).isNotNull())
    gram = F.expr(f"substring({text}, _code >> 3, _code & 7)")
    marked, first = F.concat(F.lit("g"), gram), F.instr(F.col(text), gram) == F.expr("_code >> 3")
    if words:
        df = df.withColumn("_held", F.array_distinct(F.split(text, not_word)))
        codes.append(F.expr("sequence(15, 8 * size(_held) + 7, 8)"))
        is_word = F.expr("_code & 7") == 7
        marked = F.when(is_word, F.concat(F.lit("w"), F.expr("element_at(_held, _code >> 3)"))).otherwise(marked)
        first = is_word | first
    return df.withColumn("_code", F.explode(F.concat(*codes))).withColumn("_gram", marked), first


def sifted(posts: DataFrame, first: Column, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The :func:`postings` whose ``keys`` are in ``wanted``, and few others: at most SIEVE_BITS
    bits, set by hashes of the wanted keys, are sent to the tasks, however many keys there are.
    It loses no row that meets one of ``wanted`` in an equi-join."""
    alike = [k for k in keys if posts.schema[k].dataType == wanted.schema[k].dataType
             and isinstance(posts.schema[k].dataType, (T.StringType, T.IntegralType))]  # equal values, equal hashes
    slot = F.xxhash64(*alike).bitwiseAND(SIEVE_BITS - 1)
    bit = F.expr("shiftleft(1L, CAST(_slot & 63 AS INT))")
    sieve = (wanted.select(slot.alias("_slot")).groupBy(F.expr("_slot >> 6").alias("_row"))
             .agg(F.bit_or(bit).alias("_bits")))
    found = posts.withColumn("_slot", slot).join(F.broadcast(sieve), F.expr("_slot >> 6") == F.col("_row"))
    return (found.where(F.when(F.col("_bits").bitwiseAND(bit) != 0, first).otherwise(F.lit(False)))
            .drop("_slot", "_row", "_bits", "_code", "_held"))


def candidates(texts: DataFrame, needles: DataFrame, text: str, needle: str, by: list[str],
               words: str | None = None, not_word: str = "") -> DataFrame:
    """All columns of both sides for pairs, equal in ``by``, whose text holds the needle's
    rarest gram: every pair whose text contains the needle, and some more.

    ``needle`` is a string, or a list of strings that a text must all contain; ``words`` is a
    list of words that it must hold too, as they are between matches of ``not_word``.
    ``needles`` are distinct rows; the sides share no other column names.  Null texts
    and needles meet nothing; an empty needle meets every text."""
    needles = needles.where(F.col(needle).isNotNull())
    many = isinstance(needles.schema[needle].dataType, T.ArrayType)
    parts = needles.withColumn("_part", F.explode(needle) if many else F.col(needle))
    size = F.when(F.length("_part") >= LONG_GRAM, F.lit(LONG_GRAM)).otherwise(F.least(F.length("_part"), F.lit(GRAM)))
    sizes = sorted(r[0] for r in parts.select(size.alias("g")).distinct().collect())  # at most five numbers
    keys = [*by, "_gram"]
    marked = lambda c, mark: F.transform(c, lambda x: F.concat(F.lit(mark), x))
    own = []
    if sizes:
        own.append(parts.withColumn("_gram", F.explode(marked(F.coalesce(
            *[F.when(size == g, grams("_part", g)) for g in sizes]), "g"))).drop("_part"))
    if words:
        own.append(needles.withColumn("_gram", F.explode(marked(F.col(words), "w"))))
    if not own:
        return texts.limit(0).join(needles, by) if by else texts.limit(0).join(needles, F.lit(True))
    wanted = reduce(DataFrame.unionByName, own)
    posts, first = postings(texts, text, sizes, bool(words), not_word)
    # counted where texts are read: a gram that most texts hold sends one row a task
    counts = sifted(posts, first, wanted, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # merge: the sizes that Spark expects here may be far too small for a broadcast
    rarest = (wanted.join(counts.hint("merge"), keys, "left").groupBy(*needles.columns)
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
              .where(F.col("_r.n") > 0).select(*needles.columns, F.col("_r._gram").alias("_gram")))
    return sifted(posts, first, rarest, keys).join(rarest.hint("merge"), keys).drop("_gram")
