"""The corpus pipeline: quality, near-duplicates, repeated passages, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Stages are written as Parquet and reread.

Cases: a null or empty text, or one without words, is rejected by the first stage; null ids, sources
and languages pass (a null source is a source of its own in the mix); of exactly repeated rows one
stays after near-duplicates; an empty table, or one whose rows are all rejected, gives an
empty result; further columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, mixing, neardup, quality, substrings
from weft.llm.queries import tokenizer_file
from weft.llm.ship import ship_package
from weft.plans.tables import table
from weft.session import scratch_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    scored = quality.classify(docs, quality.train(docs))
    return scored.where("keep").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id."""
    ship_package(spark)
    return neardup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 50-word passages go; ``n_chars`` follows a changed text."""
    ship_package(spark)
    cut = substrings.remove_repeats(docs, length=50)
    out = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 rows)."""
    ship_package(spark)
    mixed = mixing.mix(docs, weights=[3, 1, 2], share=1.5, cap=2.0)
    return mixed.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and their digests."""
    ship_package(spark)
    ids = bpe.encode(docs.select("doc_id", "text"), tokenizer_file()).drop("text")
    both = bpe.decode(ids, tokenizer_file())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: The classifier, the signatures and the seeded draw are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
