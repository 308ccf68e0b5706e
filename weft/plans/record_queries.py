"""Queries for record preparation: JSONL shape detection and rendering,
alias mapping, CSV rows to instruction records, counters, written-row limit.

The JSONL lines are derived from the driver tables with ``to_json`` (one
shape per source table, plus lines that fit no shape and blank lines), so the
work grows with the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.chat import render_chat
from weft.operators.records import (
    alpaca_to_text,
    collect_messages,
    limit_written,
    normalize_lines,
    prep_counters,
    prompt_completion_to_text,
    row_to_alpaca,
    to_record,
)
from weft.plans.registry import query
from weft.plans.tables import table


def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, rec_id, value)``: JSONL lines of every record shape."""
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"),
        F.to_json(F.struct("text")).alias("value"))
    part = table(spark, sf_dir, "part")
    # input: '' / missing key (to_json drops nulls) / a value, by p_size.
    inp = (F.when(F.pmod("p_size", F.lit(3)) == 0, F.lit(""))
           .when(F.pmod("p_size", F.lit(3)) == 1, F.lit(None).cast("string"))
           .otherwise(F.col("p_type")))
    alp = part.select(F.lit("part").alias("src"), F.col("p_partkey").alias("rec_id"),
                      F.to_json(F.struct(F.col("p_name").alias("instruction"), inp.alias("input"),
                                         F.col("p_brand").alias("output"))).alias("value"))
    bench = table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("src"), F.col("item_id").alias("rec_id"),
        F.to_json(F.struct(F.col("text").alias("prompt"),
                           F.concat(F.lit(" #"), F.col("item_id").cast("string")).alias("completion"))
                  ).alias("value"))
    chats = collect_messages(table(spark, sf_dir, "conversations")).select(
        F.lit("conversations").alias("src"), F.col("conv_id").alias("rec_id"),
        F.to_json(F.struct("messages")).alias("value"))
    other = table(spark, sf_dir, "nation").select(
        F.lit("nation").alias("src"), F.col("n_nationkey").cast("long").alias("rec_id"),
        F.to_json(F.struct("n_name", "n_regionkey")).alias("value"))
    blank = table(spark, sf_dir, "region").select(
        F.lit("region").alias("src"), F.col("r_regionkey").cast("long").alias("rec_id"),
        F.concat(F.repeat(F.lit(" "), F.col("r_regionkey")), F.lit("\t")).alias("value"))
    return docs.unionByName(alp).unionByName(bench).unionByName(chats).unionByName(other) \
        .unionByName(blank)


_LINES_SQL = """
WITH lines AS (
  SELECT 'documents' AS src, doc_id AS rec_id, CAST(json_object('text', text) AS VARCHAR) AS value FROM documents
  UNION ALL
  SELECT 'part', p_partkey,
         CAST(CASE WHEN p_size % 3 = 1 THEN json_object('instruction', p_name, 'output', p_brand)
              ELSE json_object('instruction', p_name, 'input', CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END,
                               'output', p_brand) END AS VARCHAR) FROM part
  UNION ALL
  SELECT 'benchmark', item_id, CAST(json_object('prompt', text, 'completion', ' #' || CAST(item_id AS VARCHAR)) AS VARCHAR) FROM benchmark
  UNION ALL
  SELECT 'conversations', conv_id,
         CAST(json_object('messages', list(json_object('role', role, 'content', text) ORDER BY turn)) AS VARCHAR)
  FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT 'nation', CAST(n_nationkey AS BIGINT), CAST(json_object('n_name', n_name, 'n_regionkey', n_regionkey) AS VARCHAR) FROM nation
  UNION ALL
  SELECT 'region', CAST(r_regionkey AS BIGINT), repeat(' ', r_regionkey) || chr(9) FROM region
),
kept AS (SELECT * FROM lines WHERE trim(value, ' ' || chr(9)) <> ''),
k AS (SELECT *, json_keys(value) AS keys FROM kept),
f AS (SELECT *, CASE WHEN list_contains(keys, 'messages') THEN 'chat'
                     WHEN list_contains(keys, 'instruction') AND list_contains(keys, 'output') THEN 'alpaca'
                     WHEN list_contains(keys, 'prompt') AND list_contains(keys, 'completion') THEN 'prompt_completion'
                     WHEN list_contains(keys, 'text') THEN 'text' END AS format FROM k),
t AS (SELECT src, rec_id, format,
        CASE format
          WHEN 'chat' THEN array_to_string(list_transform(
               CAST(value -> '$.messages' AS STRUCT(role VARCHAR, content VARCHAR)[]),
               lambda m: '<|im_start|>' || coalesce(m.role, '') || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), '')
          WHEN 'alpaca' THEN
            CASE WHEN coalesce(value ->> '$.input', '') <> ''
                 THEN '### Instruction:' || chr(10) || (value ->> '$.instruction') || chr(10) || chr(10) || '### Input:' || chr(10)
                      || (value ->> '$.input') || chr(10) || chr(10) || '### Response:' || chr(10) || (value ->> '$.output')
                 ELSE '### Instruction:' || chr(10) || (value ->> '$.instruction') || chr(10) || chr(10) || '### Response:'
                      || chr(10) || (value ->> '$.output') END
          WHEN 'prompt_completion' THEN (value ->> '$.prompt') || (value ->> '$.completion')
          WHEN 'text' THEN value ->> '$.text' END AS text
      FROM f)
"""


@query("jsonl_normalize", "SRC1 F1 P1 P2 P3 P4 P5 F2", sql=_LINES_SQL + "SELECT * FROM t")
def jsonl_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize_lines(jsonl_lines(spark, sf_dir), policy="per_row")
    return out.select("src", "rec_id", "format", "text")


@query("jsonl_counters", "A1 F1 F2", sql=_LINES_SQL + """
SELECT CAST(count(*) AS BIGINT) AS n_read, CAST(count(format) AS BIGINT) AS n_written,
       CAST(count(*) - count(format) AS BIGINT) AS n_skipped FROM t
""")
def jsonl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize_lines(jsonl_lines(spark, sf_dir), policy="per_row")
    return prep_counters(out).select(F.col("n_read").cast("long").alias("n_read"),
                                     "n_written", "n_skipped")


SHAPED = ("documents", "part", "benchmark", "conversations")


@query("jsonl_first_record", "P1 P2 P3 P4 P5 SRC1", sql=_LINES_SQL + f"""
SELECT src, rec_id, format, text FROM t WHERE src IN {SHAPED}
""")
def jsonl_first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of one shape as a file of its own, read whole."""
    lines = jsonl_lines(spark, sf_dir)
    out = [normalize_lines(lines.where(F.col("src") == src), policy="first_record", order=[F.col("rec_id")])
           .select("src", "rec_id", "format", "text") for src in SHAPED]
    return reduce(DataFrame.unionByName, out)


# Documents as JSONL lines, some of them not one strict JSON object.
_STRICT_SQL = """CASE doc_id % 8
  WHEN 1 THEN {line} || ' garbage'
  WHEN 2 THEN '{{' || chr(39) || 'text' || chr(39) || ':' || chr(39) || 'b' || chr(39) || '}}'
  WHEN 3 THEN {line} || '{{' || chr(34) || 'text' || chr(34) || ':1}}'
  WHEN 4 THEN {line} || '],[' || {line}
  WHEN 5 THEN chr(9) || {line} || '  '
  WHEN 6 THEN '[' || {line} || ']'
  ELSE {line} END"""


@query("jsonl_strict", "SRC1 F1 F2 P1", sql=f"""
WITH l AS (SELECT doc_id, CAST(json_object('text', text, 'id', doc_id) AS VARCHAR) AS line FROM documents),
v AS (SELECT doc_id, {_STRICT_SQL.format(line='line')} AS value FROM l),
j AS (SELECT *, CASE WHEN doc_id % 8 IN (0, 5, 7) THEN value END AS good FROM v)
SELECT doc_id, CASE WHEN good IS NOT NULL THEN 'text' END AS format, good ->> '$.text' AS text,
       CASE WHEN good IS NULL THEN md5(value) END AS quarantined FROM j
""")
def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct("text", F.col("doc_id").alias("id"))).alias("line"))
    out = normalize_lines(docs.select("doc_id", F.expr(_STRICT_SQL.format(line="line")).alias("value")))
    return out.select("doc_id", "format", "text", F.when(F.col("format").isNull(), F.md5("value")).alias("quarantined"))


# ---------------------------------------------------------------- P6

def _alias_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").alias("d")
    lab = table(spark, sf_dir, "labels").alias("l")
    docs = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").alias("rec_id"),
        F.col("d.lang").alias("messages"),  # a string, not a list: never chat
        F.when(F.pmod(F.col("d.doc_id"), F.lit(4)) == 0, F.lit(None).cast("string"))
         .when(F.pmod(F.col("d.doc_id"), F.lit(4)) == 1, F.lit("")).otherwise(F.col("d.text")).alias("text"),
        F.when(F.col("l.quality") == 1, F.col("d.text")).alias("content"),
        F.when(F.pmod(F.col("d.doc_id"), F.lit(3)) == 0, F.lit("")).otherwise(F.col("d.source")).alias("body"),
        F.when(F.col("l.toxic") == 1, F.col("d.lang")).alias("answer"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rec_id"), F.col("p_name").alias("instruction"),
        F.when(F.pmod("p_size", F.lit(2)) == 0, F.lit("")).otherwise(F.col("p_brand")).alias("output"),
        F.col("p_type").alias("response"))
    bench = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("rec_id"), F.col("text").alias("prompt"),
        F.concat(F.lit(" r"), F.col("item_id").cast("string")).alias("response"))
    return docs, parts, bench


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, parts, bench = _alias_tables(spark, sf_dir)
    out = []
    for name, df in (("documents", docs), ("part", parts), ("benchmark", bench)):
        m = to_record(df)
        text = (F.when(F.col("format") == "alpaca",
                       alpaca_to_text("instruction", "input", "output"))
                .when(F.col("format") == "prompt_completion",
                      prompt_completion_to_text("prompt", "completion"))
                .otherwise(F.col("text")))
        out.append(m.select(F.lit(name).alias("src"), "rec_id", "format", text.alias("text"),
                            *CANONICAL))
    return out[0].unionByName(out[1]).unionByName(out[2])


CANONICAL = ["messages", "instruction", "input", "output", "prompt", "completion"]


_MAPPED_SQL = """
WITH docs AS (
  SELECT d.doc_id AS rec_id,
         CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 4 = 1 THEN '' ELSE d.text END AS text,
         CASE WHEN l.quality = 1 THEN d.text END AS content,
         CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.source END AS body,
         CASE WHEN l.toxic = 1 THEN d.lang END AS answer
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (
  SELECT 'documents' AS src, rec_id,
         CASE WHEN coalesce(text, '') <> '' OR coalesce(content, '') <> '' OR coalesce(body, '') <> ''
                   OR coalesce(answer, '') <> '' THEN 'text' END AS format,
         CASE WHEN coalesce(text, '') <> '' THEN text WHEN coalesce(content, '') <> '' THEN content
              WHEN coalesce(body, '') <> '' THEN body WHEN coalesce(answer, '') <> '' THEN answer END AS text
  FROM docs
  UNION ALL
  SELECT 'part', p_partkey, 'alpaca',
         '### Instruction:' || chr(10) || p_name || chr(10) || chr(10) || '### Response:' || chr(10)
         || CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END
  FROM part
  UNION ALL
  SELECT 'benchmark', item_id, 'prompt_completion', text || ' r' || CAST(item_id AS VARCHAR) FROM benchmark)
"""


@query("mapped_records", "P6 P2 P3 P4 F2", sql=_MAPPED_SQL + "SELECT * FROM m")
def mapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("src", "rec_id", "format", "text")


FIRST_N = 100


@query("mapped_first_n", "L1 F2 P6", sql=_MAPPED_SQL + f"""
SELECT * FROM m WHERE format IS NOT NULL ORDER BY src, rec_id LIMIT {FIRST_N}
""")
def mapped_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_written(_mapped(spark, sf_dir), FIRST_N, [F.col("src"), F.col("rec_id")]).select(
        "src", "rec_id", "format", "text")


@query("mapped_text_field", "P6 P2 P4", sql="""
WITH p AS (SELECT page_id, url, html, page_id % 3 = 0 AS flag FROM pages),
c AS (SELECT conv_id, count(*) AS n, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
SELECT 'pages' AS src, page_id AS rec_id, 'text' AS format,
       CASE WHEN coalesce(url, '') <> '' THEN url WHEN flag THEN 'True' ELSE html END AS text FROM p
UNION ALL
SELECT 'conversations', conv_id, CASE WHEN n % 2 = 0 THEN 'chat' WHEN n > 1 THEN 'text' END,
       CASE WHEN n % 2 = 0 THEN array_to_string(list_transform(m, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10)
              || coalesce(x.content, '') || '<|im_end|>' || chr(10)), '')
            WHEN n > 1 THEN 'True' END FROM c
""")
def mapped_text_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat and text-field branches: rows with a list of messages or none, a
    named text field, a boolean field."""
    pages = to_record(table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("rec_id"), "url", (F.pmod("page_id", F.lit(3)) == 0).alias("text"),
        F.col("html").alias("content")), text_field="url")
    chats = collect_messages(table(spark, sf_dir, "conversations"))
    n = F.size("messages")
    chats = to_record(chats.select(F.col("conv_id").alias("rec_id"),
                                   F.when(n % 2 == 0, F.col("messages")).alias("messages"), (n > 1).alias("answer")))
    both = [df.select(F.lit(src).alias("src"), "rec_id", "format",
                      F.when(F.col("format") == "chat", render_chat(F.col("messages"))).otherwise(F.col("text")).alias("text"))
            for src, df in (("pages", pages), ("conversations", chats))]
    return both[0].unionByName(both[1])


# ---------------------------------------------------------------- P7

@query("csv_alpaca", "P7", sql="""
SELECT c_custkey, 'Analyze this record and produce the appropriate label.' AS instruction,
       'c_nationkey=' || coalesce(CAST(c_nationkey AS VARCHAR), '') || ' | c_mktsegment=' || coalesce(c_mktsegment, '')
       || ' | c_phone=' AS input,
       trim(coalesce(c_name, '')) AS output
FROM customer
""")
def csv_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    return row_to_alpaca(cust, "c_name", ["c_nationkey", "c_mktsegment", "c_phone"],
                         keep=["c_custkey"])
