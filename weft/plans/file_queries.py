"""Queries over files with names: they are written from the tables by tasks, one file a
name, and read back with the package's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import split_list
from weft.functions.time import display_time
from weft.operators.agent_log import classify_commands, flag_allowed
from weft.operators.ops_tables import ladder_lookup, usage_band, usage_pct
from weft.operators.records import DEFAULT_INSTRUCTION
from weft.plans.registry import query
from weft.plans.tables import table
from weft.session import scratch_dir
from weft.sources.files import (
    artifact_inventory,
    dataset_catalog,
    directory_inventory,
    prepare_csv,
    read_device_samples,
)
from weft.sources.listing import open_fs
from weft.sources.sinks import RECORDS_DIR


def write_files(rows: DataFrame, folder: str) -> None:
    """One file a ``name`` (relative, may hold directories) of its ``line``s in order; a name with
    null lines only is an empty file.  A task that runs again writes the same files again."""
    def write(part) -> None:
        fs, base = open_fs(folder)
        name = out = None
        for r in part:
            if r["name"] != name:
                if out is not None:
                    out.close()
                name = r["name"]
                target = f"{base}/{name}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(target)
            if r["line"] is not None:
                out.write((r["line"] + "\n").encode())
        if out is not None:
            out.close()

    rows.repartition("name").sortWithinPartitions("name", "line").foreachPartition(write)


@query("catalog_files", "SRC8 L2 F6", sql="""
WITH l AS (SELECT coalesce(lang, 'none') || '.jsonl' AS name, '{"id":' || doc_id || '}' AS line FROM documents
           UNION ALL SELECT coalesce(lang, 'none') || '.jsonl', '' FROM documents WHERE doc_id % 10 = 0)
SELECT name, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line) + 1) AS BIGINT) AS size FROM l GROUP BY name
UNION ALL SELECT 'empty.jsonl', 0, 0
""")
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.coalesce("lang", F.lit("none")), F.lit(".jsonl")).alias("name")
    rows = docs.select(name, F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit("}")).alias("line"))
    rows = rows.unionByName(docs.where("doc_id % 10 = 0").select(name, F.lit("").alias("line")))
    rows = rows.unionByName(table(spark, sf_dir, "region").select(
        F.when(F.col("r_regionkey") == 0, "empty.jsonl").otherwise("notes.txt").alias("name"), F.lit(None).cast("string").alias("line")))
    folder = scratch_dir(spark, "catalog")
    write_files(rows, folder)
    return dataset_catalog(spark, folder).select("name", "lines", "size")


@query("artifact_files", "SRC9 U1 W4 L2", sql="""
SELECT 'm' || s_suppkey AS name, 'org' || s_nationkey || '/m' || s_suppkey || '.gguf' AS rel_path, 'primary' AS source,
       CAST(0 AS DOUBLE) AS size_gb FROM supplier WHERE s_suppkey % 4 <> 0
UNION ALL SELECT 'm' || s_suppkey, 'm' || s_suppkey || '.gguf', 'mirror', 0 FROM supplier WHERE s_suppkey % 3 = 0
""")
def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four roots: one of them absent, one listed twice under two labels."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    base = scratch_dir(spark, "artifacts")
    org = F.concat(F.lit("org"), F.col("s_nationkey").cast("string"), F.lit("/m"), key,
                   F.when(F.col("s_suppkey") % 4 != 0, ".gguf").otherwise(".bin"))
    write_files(s.select(org.alias("name"), F.col("s_name").alias("line")), f"{base}/primary")
    write_files(s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("m"), key, F.lit(".gguf")).alias("name"),
                                                    F.col("s_name").alias("line")), f"{base}/mirror")
    roots = [("primary", f"{base}/primary"), ("absent", f"{base}/none"), ("mirror", f"{base}/mirror"),
             ("again", f"{base}/primary")]
    return artifact_inventory(spark, roots).select("name", "rel_path", "source", "size_gb")


@query("directory_files", "SRC10 L2", sql="""
SELECT n_name AS name, n_nationkey % 2 = 0 AS has_config, n_nationkey % 3 = 0 OR n_nationkey % 7 = 0 AS has_adapter FROM nation
""")
def directory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    files = F.array(F.lit("notes.txt"), F.when(k % 2 == 0, "config.json"), F.when(k % 3 == 0, "adapter_model.safetensors"),
                    F.when(k % 5 == 0, "sub/adapter_x.bin"), F.when(k % 7 == 0, "adapter_part.bin"),
                    F.when(k % 2 == 1, "sub/config.json"))
    rows = n.select("n_name", F.explode(F.array_compact(files)).alias("f"))
    folder = scratch_dir(spark, "runs")
    write_files(rows.select(F.concat_ws("/", "n_name", "f").alias("name"), F.lit("x").alias("line")), folder)
    return directory_inventory(spark, folder).select("name", "has_config", "has_adapter")


# A device line of an event (one text, valid in Spark SQL and DuckDB); some lines are unusable.
DEVICE_SQL = """CASE k % 6 WHEN 0 THEN 'x, bad, 12' WHEN 1 THEN CAST(event_id AS STRING) || ', GPU'
  WHEN 2 THEN '  ' || CAST(event_id AS STRING) || ' , GPU ' || CAST(k AS STRING) || ' , ' || CAST(k * 100 + 24 AS STRING)
              || ' , 550.' || CAST(k AS STRING) || ',8.9 '
  WHEN 3 THEN CAST(event_id AS STRING) || ',GPU,many'
  ELSE CAST(event_id AS STRING) || ', GPU ' || CAST(k AS STRING) || ', ' || CAST(k * 100 AS STRING) || ', 5000' END"""
_DEVICE_ROWS = f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
p AS (SELECT 'host' || (user_id % 40) AS host, list_transform(string_split({DEVICE_SQL}, ','), lambda x: trim(x)) AS f FROM e)
"""


def _device_files(spark: SparkSession, sf_dir: str) -> str:
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    folder = scratch_dir(spark, "devices")
    name = F.concat(F.lit("host"), (F.col("user_id") % 40).cast("string"), F.lit(".csv"))
    write_files(ev.select(name.alias("name"), F.expr(DEVICE_SQL).alias("line")), folder)
    return folder


@query("device_inventory_files", "SRC6", sql=_DEVICE_ROWS + """
SELECT host, CAST(f[1] AS INTEGER) AS index, f[2] AS name, round_even(CAST(f[3] AS DOUBLE) / 1024.0, 2) AS vram_gb,
       f[4] AS driver, f[5] AS compute_cap FROM p
WHERE len(f) >= 3 AND TRY_CAST(f[1] AS INTEGER) IS NOT NULL AND TRY_CAST(f[3] AS DOUBLE) IS NOT NULL
""")
def device_inventory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_device_samples(spark, _device_files(spark, sf_dir)).drop("ts")


@query("device_usage_files", "SRC6 P12", sql=_DEVICE_ROWS + """,
u AS (SELECT host, TRY_CAST(f[1] AS INTEGER) AS index, f[2] AS name, TRY_CAST(f[3] AS DOUBLE) AS used_mb,
             TRY_CAST(f[4] AS DOUBLE) AS total_mb FROM p WHERE len(f) >= 4),
v AS (SELECT *, CASE WHEN total_mb = 0 THEN 0.0 ELSE round_even(100.0 * used_mb / total_mb, 1) END AS pct FROM u
      WHERE index IS NOT NULL AND used_mb IS NOT NULL AND total_mb IS NOT NULL)
SELECT *, CASE WHEN pct >= 90 THEN 'crit' WHEN pct >= 70 THEN 'warn' ELSE 'ok' END AS band FROM v
""")
def device_usage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_device_samples(spark, _device_files(spark, sf_dir), form="usage").drop("ts")
    return rows.withColumn("pct", usage_pct("used_mb", "total_mb")).withColumn("band", usage_band("pct"))


# ---------------------------------------------------------------- CSV

def _customer_csv(spark: SparkSession, sf_dir: str) -> str:
    """Part files in order of the key; a field with quotes, delimiters and newlines."""
    note = F.concat(F.lit('a "quoted", '), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "\nsecond line").otherwise(""))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", note.alias("note"), "c_acctbal")
    folder = scratch_dir(spark, "customers")
    (rows.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
     .write.option("header", True).option("escape", '"').csv(folder))
    return folder


_CSV_SQL = f"""
SELECT '{DEFAULT_INSTRUCTION}' AS instruction,
       'c_custkey=' || c_custkey || ' | note=a "quoted", ' || c_name
       || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'second line' ELSE '' END || ' | c_phone=' AS input,
       c_mktsegment AS output FROM customer
"""
_ALPACA = "instruction STRING, input STRING, output STRING"


@query("csv_prepare", "SRC2 P7 SNK1 A1", sql=_CSV_SQL)
def csv_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "csv-out")
    prepare_csv(spark, _customer_csv(spark, sf_dir), out, "c_mktsegment", "c_custkey, note, c_phone")
    return spark.read.schema(_ALPACA).json(f"{out}/{RECORDS_DIR}")


CSV_N = 100


@query("csv_first_n", "SRC2 P7 L1 SNK1", sql=_CSV_SQL + f"ORDER BY c_custkey LIMIT {CSV_N}")
def csv_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records in the order of the files."""
    out = scratch_dir(spark, "csv-out")
    prepare_csv(spark, _customer_csv(spark, sf_dir), out, "c_mktsegment", "c_custkey, note, c_phone", limit=CSV_N)
    return spark.read.schema(_ALPACA).json(f"{out}/{RECORDS_DIR}")


# ---------------------------------------------------------------- rules, ladders, helpers

@query("rule_index", "J1 J2", sql="""
SELECT o_orderkey, CASE WHEN o_custkey % 100 = 77 THEN 0 WHEN c.c_custkey IS NOT NULL THEN c.c_custkey + 1 END AS block_rule,
       o_custkey % 100 = 77 OR c.c_custkey IS NOT NULL AS allowed
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c.c_custkey
""")
def rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule a customer, and one that holds no fixed text; a command an order."""
    cmd = F.concat(F.lit("order "), F.col("o_custkey").cast("string"), F.lit(" at "), F.col("o_orderpriority"))
    cmds = table(spark, sf_dir, "orders").select("o_orderkey", cmd.alias("cmd"))
    rules = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(
        (F.col("c_custkey") + 1).alias("rule_id"),
        F.concat(F.lit(r"^order\s"), F.col("c_custkey").cast("string"), F.lit(r"\b")).alias("pattern"))
    rules = rules.unionByName(table(spark, sf_dir, "region").where("r_regionkey = 0").select(
        F.lit(0).cast("long").alias("rule_id"), F.lit(r"^[a-z]+\s(?P<key>\d*[7]{2})\s").alias("pattern")))
    out = flag_allowed(classify_commands(cmds, "cmd", rules), "cmd", rules)
    return out.select("o_orderkey", "block_rule", "allowed")


@query("price_ladder", "J4", sql="""
WITH r AS (SELECT p_retailprice AS lo, max('p' || p_partkey) AS name FROM part GROUP BY p_retailprice)
SELECT o_orderkey, CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 'none'
                        ELSE coalesce(r.name, (SELECT arg_min(name, lo) FROM r)) END AS rung
FROM orders ASOF LEFT JOIN r ON o_totalprice / 100 >= r.lo
""")
def price_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ladder of as many rungs as there are prices of parts."""
    rungs = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("lo"),
                                                F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("v"))
    return ladder_lookup(rows, "v", rungs, out_col="rung", floor_name="none").select("o_orderkey", "rung")


@query("text_helpers", "F6", sql="""
SELECT event_id, array_to_string(list_filter(list_transform(string_split(
         event_type || ' , ,x' || event_id || ',,' || chr(9) || user_id || ' ', ','), lambda x: trim(x, ' ' || chr(9))),
         lambda x: x <> ''), '|') AS parts,
       CASE WHEN event_id % 7 = 0 THEN 'never' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown FROM events
""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comma list and the display time."""
    ev = table(spark, sf_dir, "events")
    line = F.concat(F.col("event_type"), F.lit(" , ,x"), F.col("event_id").cast("string"), F.lit(",,\t"),
                    F.col("user_id").cast("string"), F.lit(" "))
    at = F.when(F.col("event_id") % 14 == 0, F.lit(0)).when(F.col("event_id") % 7 != 0,
                                                            F.unix_timestamp(F.col("ts").cast("timestamp")))
    return ev.select("event_id", F.array_join(split_list(line), "|").alias("parts"), display_time(at).alias("shown"))
