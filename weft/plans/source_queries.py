"""Round trips through files: tables are written with the package's sinks to
a fresh folder under the shared checkpoint directory and read back with its
sources.  The oracle is SQL on the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.records import DEFAULT_INSTRUCTION, to_record
from weft.plans.record_queries import _LINES_SQL, _MAPPED_SQL, _alias_tables, _mapped, jsonl_lines
from weft.plans.registry import query
from weft.plans.tables import table
from weft.session import scratch_dir
from weft.sources.files import dataset_catalog, read_csv, read_jsonl, read_table
from weft.sources.sinks import (
    QUARANTINE_DIR,
    RECORDS_DIR,
    prepare_records,
    write_records,
    write_run_meta,
    write_text_dataset,
)


@query("jsonl_round_trip", "SNK1 SRC1 P1", sql=_MAPPED_SQL + """
SELECT format, text FROM m WHERE format IS NOT NULL
""")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "records")
    write_records(_mapped(spark, sf_dir).where(F.col("format").isNotNull()), out)
    return read_jsonl(spark, out).select("format", "text")


@query("csv_round_trip", "SRC2 P7", sql=f"""
SELECT '{DEFAULT_INSTRUCTION}' AS instruction,
       'doc_id=' || CAST(doc_id AS VARCHAR) || ' | text=' || coalesce(text, '') AS input,
       trim(lang) AS output
FROM documents
""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "csv")
    (table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
     .write.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(out))
    return read_csv(spark, out, "lang", "doc_id, text")


@query("catalog_round_trip", "SRC8 SNK1", sql="""
SELECT lang, CAST(count(*) AS BIGINT) AS lines FROM documents GROUP BY lang
""")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "catalog")
    docs = table(spark, sf_dir, "documents")
    docs.write.partitionBy("lang").option("ignoreNullFields", False).json(out)
    cat = dataset_catalog(spark, out, "*.json", recursive=True)
    return (cat.withColumn("lang", F.regexp_extract("path", r"/lang=([^/]+)/", 1))
            .groupBy("lang").agg(F.sum("lines").cast("long").alias("lines")))


@query("table_split", "SRC3", sql="""
SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')
""")
def table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "table")
    docs = table(spark, sf_dir, "documents").withColumn(
        "split", F.when(F.col("lang").isin("en", "fr"), "train").otherwise("test"))
    docs.select("doc_id", "lang", "split").write.partitionBy("split").parquet(out)
    return read_table(spark, out, "train").select("doc_id", "lang")


def _prepare(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    base = scratch_dir(spark, "prepare")
    raw, out, txt, runs = (f"{base}/{x}" for x in ("raw", "prepared", "text", "runs"))
    jsonl_lines(spark, sf_dir).select("value").write.option("compression", "gzip").text(raw)  # the input, only read here
    normalized = read_jsonl(spark, raw)
    counters = prepare_records(normalized, out)
    write_text_dataset(read_jsonl(spark, f"{out}/{RECORDS_DIR}"), txt)
    write_run_meta(spark, runs, {"source": "tables", "policy": "per_row"}, counters)
    return txt, runs


@query("prepare_text", "A1 F2 SNK1 SNK2 SRC1", sql=_LINES_SQL + """
SELECT text FROM t WHERE format IS NOT NULL
""")
def prepare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    txt, _ = _prepare(spark, sf_dir)
    return spark.read.parquet(txt)


@query("prepare_counters", "A1 SNK3", sql=_LINES_SQL + """
SELECT CAST(count(*) AS BIGINT) AS n_read, CAST(count(format) AS BIGINT) AS n_written,
       CAST(count(*) - count(format) AS BIGINT) AS n_skipped FROM t
""")
def prepare_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, runs = _prepare(spark, sf_dir)
    c = F.from_json("counters", "n_read BIGINT, n_written BIGINT, n_skipped BIGINT")
    return spark.read.parquet(runs).select(c["n_read"].alias("n_read"), c["n_written"].alias("n_written"),
                                           c["n_skipped"].alias("n_skipped"))


@query("chat_extra_keys", "SRC1 P6 SNK1", sql="""
SELECT conv_id, turn, role, text AS content, CAST(length(text) AS BIGINT) AS n_chars, turn % 2 = 0 AS even FROM conversations
""")
def chat_extra_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with more keys than role and content keep them, nested ones too, from JSONL
    through preparation to the canonical JSONL."""
    base = scratch_dir(spark, "chat")
    turns = table(spark, sf_dir, "conversations")
    message = F.struct("turn", "role", F.col("text").alias("content"), F.struct(
        "conv_id", F.length("text").alias("n_chars"), (F.col("turn") % 2 == 0).alias("even")).alias("meta"))
    lines = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    lines.select(F.to_json(F.struct("messages"), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{base}/in")
    prepare_records(read_jsonl(spark, f"{base}/in"), f"{base}/out")
    back = spark.read.schema("""messages ARRAY<STRUCT<role STRING, content STRING, turn BIGINT,
        meta: STRUCT<conv_id BIGINT, n_chars BIGINT, even BOOLEAN>>>""").json(f"{base}/out/{RECORDS_DIR}")
    return back.select(F.explode("messages").alias("m")).select("m.meta.conv_id", "m.turn", "m.role", "m.content",
                                                                 "m.meta.n_chars", "m.meta.even")


@query("quarantine_rows", "F2 A1 P6", sql=_MAPPED_SQL + """
SELECT d.doc_id AS rec_id, d.lang AS messages,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 4 = 1 THEN '' ELSE d.text END AS text,
       d.text AS prompt, CAST(d.n_chars AS DOUBLE) / 2 AS half
FROM documents d JOIN m ON m.src = 'documents' AND m.rec_id = d.doc_id WHERE m.format IS NULL
""")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that map to no shape come back from the quarantine with the values they had."""
    docs, _, _ = _alias_tables(spark, sf_dir)
    more = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rec_id"), F.col("text").alias("prompt"), (F.col("n_chars") / 2).alias("half"))
    out = scratch_dir(spark, "quarantine")
    prepare_records(to_record(docs.join(more, "rec_id")), out)
    return spark.read.schema("rec_id BIGINT, messages STRING, text STRING, prompt STRING, half DOUBLE").json(
        f"{out}/{QUARANTINE_DIR}")
