"""Registered queries of the subpackage and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole
table.  Contract columns are derived here; the operators keep their own
interfaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.ship import ship_package
from weft.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return deco


#: Words of a DuckDB text column.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op8_substring_dedup", sql=rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
        FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p
         FROM (SELECT doc_id, i FROM win JOIN least USING (s) WHERE m < doc_id), range(0, 50) r(k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.substrings import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, length=50, normalise=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_katz_backoff")
def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.katz import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import token_files
    from weft.session import scratch_dir

    path = scratch_dir(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_file())
    return token_files.crc_of_ids(token_files.read(spark, path))


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, tokenizer_file()).drop("text")
    both = bpe.decode(ids, tokenizer_file())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_mix")
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(docs, weights=[3, 1, 2], share=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op7_prob_min_hash")
def op7_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.neardup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnRenamed("id", "doc_id")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language.train(docs, learn=fold != 2)
    blind = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return language.predict(blind, model)


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.train(docs)).drop("text")


@query("op2_voronoi_top_k", sql="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""")
def op2_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import knn

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(knn.valid("embedding"))
    return knn.top_k(rows.select("vec_id", knn.whole("embedding", 1024.0).alias("vec")), F.col("vec_id") % 100 == 0, k=10)


@query("op5_vp_trees")
def op5_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import vptree

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vptree.build_index(rows)
    return vptree.search(index, rows.where(F.col("vec_id") % 100 == 0), k=10)


@query("op11_importance_resampling")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.resampling import resample

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = resample(docs, table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42, keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import sequence_packing, token_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = sequence_packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), length=2048, end_id=1)
    return token_files.crc_of_ids(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                                 "offset")


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import spelling

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = spelling.vocabulary(docs, damage=31, min_length=7, min_count=2)
    return spelling.group_variants(words, ratio=10)
