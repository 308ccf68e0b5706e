"""File sources: JSONL (SRC1), CSV (SRC2), published tables (SRC3), device
sample files (SRC6), rule files (SRC7), dataset catalog (SRC8), artifact
inventory (SRC9), directory inventory (SRC10).

Listings are made by tasks and read file metadata only (``listing.py``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import py_strip, split_list
from weft.functions.time import display_time
from weft.operators.ops_tables import first_wins
from weft.operators.records import drop_blank, normalize_lines, row_to_alpaca, to_record
from weft.operators.rules import check_pattern
from weft.sources.csv_records import read_csv_records
from weft.sources.listing import listing
from weft.sources.sinks import prepare_records


def _path_str(c) -> F.Column:
    """File URIs from different sources as plain paths (``file:`` dropped)."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^file:(//)?", "")


def read_lines(spark: SparkSession, path: str, glob: str | None = None,
               recursive: bool = False) -> DataFrame:
    """Text lines with a file-order key ``(_file, _block, _row)``.

    ``monotonically_increasing_id`` grows with the line inside each file
    split, and splits of one file are ordered by their start offset.
    """
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    df = r.text(path)
    return df.select(
        "value",
        _path_str(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))


ORDER_COLS = ("_file", "_block", "_row")


def file_order() -> list:
    """The file-order key of :func:`read_lines` rows."""
    return [F.col(c) for c in ORDER_COLS]


def read_jsonl(spark: SparkSession, path: str, policy: str = "per_row",
               glob: str | None = None) -> DataFrame:
    """SRC1: JSONL records with ``format`` and ``text``.

    ``per_row``: unparseable or unmapped lines keep ``format`` null (the
    quarantine); ``first_record``: the first line decides the shape, a line
    that does not fit it -- or does not parse -- fails the job.  Zero records
    raise: an empty input, or one of blank lines only.
    """
    lines = read_lines(spark, path, glob)
    if drop_blank(lines).isEmpty():
        raise ValueError(f"no records in {path}")
    out = normalize_lines(lines, "value", policy=policy, order=file_order())
    return out


def read_csv(spark: SparkSession, path: str, label_col: str, feature_cols: str | list | None = None,
             delimiter: str = ",", instruction: str | None = None, multiline: bool | str = True,
             keep_order: bool = False) -> DataFrame:
    """SRC2 + P7: header CSV to instruction records.

    Every value is a string (no schema inference); quoted fields may hold
    the delimiter, doubled quotes and newlines.  A label not in the header raises.
    ``multiline=True``: many tasks a file (:mod:`csv_records`); ``"whole"``: Spark's own reader,
    one task a file, which also takes quotes inside unquoted fields; ``False``: one record a
    line.  ``keep_order`` (with True) adds ``_file, _block, _row``, the order of the records.
    """
    if keep_order and multiline is not True:
        raise ValueError("keep_order needs multiline=True")
    if multiline is True:
        df = read_csv_records(spark, path, delimiter, keep_order)
    else:
        df = (spark.read.option("header", True).option("sep", delimiter)
              .option("multiLine", multiline == "whole").option("quote", '"').option("escape", '"')
              .option("inferSchema", False).csv(path))
    order = list(ORDER_COLS) if keep_order else []
    columns = [c for c in df.columns if c not in order]
    if label_col not in columns:
        raise ValueError(f"label column {label_col!r} not in {columns}")
    if isinstance(feature_cols, str):
        feature_cols = [c.strip() for c in feature_cols.split(",") if c.strip()]
    kw = {} if instruction is None else {"instruction": instruction}
    return row_to_alpaca(df, label_col, feature_cols or [c for c in columns if c != label_col], keep=order, **kw)


def prepare_csv(spark: SparkSession, path: str, out_path: str, label_col: str, feature_cols: str | list | None = None,
                delimiter: str = ",", instruction: str | None = None, limit: int | None = None) -> dict:
    """SRC2 + P7 + L1 + SNK1 + A1: CSV files to canonical JSONL under ``out_path``, the first ``limit``
    records in file order (0 / None: all); returns the counters."""
    rows = read_csv(spark, path, label_col, feature_cols, delimiter, instruction, keep_order=bool(limit))
    return prepare_records(to_record(rows), out_path, limit, order=file_order() if limit else None)


def read_table(spark: SparkSession, root: str, split: str = "train", fmt: str = "parquet") -> DataFrame:
    """SRC3: one split of a published table stored with ``split`` as a
    partition column; the filter prunes partitions at planning time."""
    return spark.read.format(fmt).load(root).where(F.col("split") == split)


# ---------------------------------------------------------------- SRC6

def read_device_samples(spark: SparkSession, path: str, form: str = "inventory") -> DataFrame:
    """SRC6: header-less comma lines from the device query tool.

    Fields are split on commas (no quoting) and trimmed; rows with too few
    fields, or a non-numeric index / memory field, are skipped.  ``host`` is
    the file's base name without extension, ``ts`` its modification time.

    inventory: index, name, memory.total [MiB], driver?, compute_cap? ->
               ``host, ts, index, name, vram_gb (2 places), driver, compute_cap``
    usage:     index, name, memory.used, memory.total ->
               ``host, ts, index, name, used_mb, total_mb``
    """
    df = spark.read.text(path).select(
        F.transform(F.split("value", ","), lambda x: py_strip(x)).alias("p"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("host"),
        F.col("_metadata.file_modification_time").alias("ts"))
    n = F.size("p")
    idx = F.get(F.col("p"), 0).try_cast("int")
    if form == "inventory":
        mem = F.get(F.col("p"), 2).try_cast("double")
        return df.where((n >= 3) & idx.isNotNull() & mem.isNotNull()).select(
            "host", "ts", idx.alias("index"), F.get(F.col("p"), 1).alias("name"),
            F.bround(mem / 1024.0, 2).alias("vram_gb"),
            F.get(F.col("p"), 3).alias("driver"), F.get(F.col("p"), 4).alias("compute_cap"))
    if form == "usage":
        used = F.get(F.col("p"), 2).try_cast("double")
        total = F.get(F.col("p"), 3).try_cast("double")
        return df.where((n >= 4) & idx.isNotNull() & used.isNotNull() & total.isNotNull()).select(
            "host", "ts", idx.alias("index"), F.get(F.col("p"), 1).alias("name"),
            used.alias("used_mb"), total.alias("total_mb"))
    raise ValueError(f"unknown form {form}")


# ---------------------------------------------------------------- SRC7

def read_rules(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """SRC7: one regex per line; stripped; blank and ``#`` lines skipped.
    ``rule_id`` is the 1-based position in the file.  Rules are configuration: the file is
    read whole on the driver, and every pattern is checked there, for Python and for Spark's
    matcher, so that a bad one fails here and not in a job."""
    lines = read_lines(spark, path)
    kept = lines.select(py_strip("value").alias("pattern"), *ORDER_COLS).where(
        (F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    rows = kept.orderBy(*ORDER_COLS).select("pattern").collect()
    if validate:
        for r in rows:
            check_pattern(spark, r["pattern"])
    return spark.createDataFrame([(i + 1, r["pattern"]) for i, r in enumerate(rows)],
                                 "rule_id INT, pattern STRING")


# ---------------------------------------------------------------- SRC8-SRC10

def list_files(spark: SparkSession, roots: str | list[tuple[str, str]], glob: str = "*",
               recursive: bool = False) -> DataFrame:
    """Files and directories under the roots, metadata only (:mod:`listing`): ``source, priority,
    root, path, rel_path, name, is_dir, length, modified``.  Absent roots list nothing."""
    return listing(spark, [("", roots)] if isinstance(roots, str) else roots, glob, recursive)


def dataset_catalog(spark: SparkSession, root: str, glob: str = "*.jsonl",
                    recursive: bool = False) -> DataFrame:
    """SRC8: per file ``name, path, lines, size`` sorted by name.  Blank lines
    count; a zero-length file has 0 lines and size 0.  Files that Spark's readers take for
    hidden (``_x``, ``.x``) are left out; an absent root gives no rows.

    The listing comes from tasks (metadata only), line counts from the text source, joined on
    the path.
    """
    files = list_files(spark, root, glob, recursive).where(~F.col("is_dir") & ~F.col("name").rlike("^[_.]"))
    out = files.select("name", "path", F.col("length").alias("size"))
    if out.where("size > 0").isEmpty():
        counts = spark.createDataFrame([], "path STRING, lines BIGINT")
    else:
        lines = read_lines(spark, root, glob, recursive)
        where = F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))
        counts = lines.groupBy(where.alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    return (out.join(counts, "path", "left")
            .select("name", "path", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"), "size")
            .orderBy("name", "path"))


def artifact_inventory(spark: SparkSession, roots: list[tuple[str, str]], glob: str = "*.gguf") -> DataFrame:
    """SRC9: recursive ``glob`` under ordered roots -> ``name`` (no suffix),
    ``rel_path``, ``abs_path``, ``source`` (root label), ``size_gb`` (2
    places); the first root wins when two roots list the same path (U1, W4).  Absent
    roots list nothing."""
    f = list_files(spark, roots, glob, recursive=True).where(~F.col("is_dir"))
    u = f.select(F.col("path").alias("abs_path"), "rel_path", "source", "priority",
                 F.regexp_replace("name", r"\.[^.]*$", "").alias("name"),
                 F.bround(F.col("length") / float(1024 ** 3), 2).alias("size_gb"))
    return first_wins(u, "abs_path", [F.col("priority"), F.col("rel_path")]).select(
        "name", "rel_path", "abs_path", "source", "size_gb", "priority").orderBy("priority", "rel_path") \
        .drop("priority")


# The file names that mark an adapter run and a model folder.
ADAPTER_FILE = "adapter_model.safetensors"
ADAPTER_BIN_RE = r"^adapter_.*\.bin$"
CONFIG_FILE = "config.json"


def directory_inventory(spark: SparkSession, root: str) -> DataFrame:
    """SRC10: one row per first-level directory: ``name, path,
    has_config, has_adapter, modified`` (the newest entry inside, or the directory itself if it
    is empty; epoch seconds) and ``modified_display``.  An absent root gives no rows."""
    base = re.sub(r"^file:(//)?", "", root).rstrip("/") + "/"
    f = list_files(spark, root, recursive=True)
    parts = F.split("rel_path", "/")
    top = F.size("parts") == 1
    file_in_top = ~F.col("is_dir") & (F.size("parts") == 2)
    inside = F.max(F.when(~F.col("is_dir"), F.unix_timestamp("modified")))
    return (f.withColumn("parts", parts).where(F.col("is_dir") | (F.size("parts") > 1))
            .groupBy(F.get("parts", 0).alias("name")).agg(
                F.coalesce(F.bool_or(file_in_top & (F.get("parts", 1) == CONFIG_FILE)), F.lit(False)).alias("has_config"),
                F.coalesce(F.bool_or(file_in_top & ((F.get("parts", 1) == ADAPTER_FILE)
                                                    | F.get("parts", 1).rlike(ADAPTER_BIN_RE))), F.lit(False)).alias("has_adapter"),
                F.coalesce(inside, F.max(F.when(top, F.unix_timestamp("modified")))).alias("modified"))
            .withColumn("path", F.concat(F.lit(base), F.col("name")))
            .withColumn("modified_display", display_time("modified"))
            .select("name", "path", "has_config", "has_adapter", "modified", "modified_display")
            .orderBy("name"))


__all__ = [
    "read_lines", "read_jsonl", "read_csv", "prepare_csv", "read_table", "read_device_samples", "read_rules",
    "list_files", "dataset_catalog", "artifact_inventory", "directory_inventory", "split_list",
]
