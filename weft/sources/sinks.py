"""Sinks: canonical JSONL (SNK1), the trainer's text column (SNK2), run
metadata (SNK3), and the prepare path that writes records and quarantine
with counters observed on the same pass (A1)."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.records import SOURCE, canonical_json, limit_written, observe_counters, prep_counters, record_json


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: one JSON object per line, nulls written, non-ASCII kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_records(df: DataFrame, path: str, fmt: str = "format", mode: str = "overwrite") -> None:
    """SNK1 for mapped records: each line carries only its shape's keys."""
    df.select(canonical_json(fmt).alias("value")).write.mode(mode).text(path)


def write_text_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """SNK2: the single ``text`` column the trainer consumes."""
    df.select("text").write.mode(mode).format(fmt).save(path)


def write_rank_shards(df: DataFrame, path: str, rank_col: str = "rank", mode: str = "overwrite") -> None:
    """W5 sink: one folder per training rank (``rank=<r>``), each read by one
    process."""
    df.write.mode(mode).partitionBy(rank_col).parquet(path)


def write_run_meta(spark: SparkSession, path: str, params: dict, counters: dict | None = None,
                   world_size: int = 1) -> DataFrame:
    """SNK3: one row -- resolved parameters (as JSON), world size, counters
    and a timestamp -- appended to a ``runs`` table beside the output."""
    row = [(json.dumps(params, sort_keys=True, default=str), int(world_size),
            json.dumps(counters or {}, sort_keys=True), float(time.time()))]
    df = spark.createDataFrame(row, "params STRING, world_size INT, counters STRING, written_at DOUBLE")
    df.write.mode("append").parquet(path)
    return df


RECORDS_DIR = "mapped=true"
QUARANTINE_DIR = "mapped=false"


def prepare_records(df: DataFrame, out_path: str, limit: int | None = None,
                    order: list | None = None, fmt: str = "format") -> dict:
    """A1 + F2 + L1 + SNK1 in one pass: canonical records go to
    ``<out>/mapped=true`` and the quarantine to ``<out>/mapped=false`` -- one write
    partitioned by the mapped flag, so the input is parsed once -- and ``n_read,
    n_written, n_skipped`` are observed on that same write.

    Both are lossless: a JSONL record keeps the whole values of its shape's keys, the
    quarantine holds the raw line, or the typed row as it was before the mapping.
    ``unmapped_keys`` holds the source's keys of three quarantined rows.

    With a limit (which needs an ``order``) the mapped rows are cut first (L1) and the
    quarantine is a second write; the whole input is still read (no early stop), so
    ``n_skipped`` counts every unmapped row.  Raises when nothing was written.
    """
    if limit and not order:
        raise ValueError("a limit needs an order")
    from_lines = "value" in df.columns
    line = record_json(fmt, SOURCE) if from_lines and SOURCE in df.columns else canonical_json(fmt)
    raw = F.col("value") if from_lines else F.to_json(SOURCE) if SOURCE in df.columns else F.to_json(
        F.struct(*df.columns), {"ignoreNullFields": "false"})
    mapped = F.col(fmt).isNotNull()
    if not limit:
        observed, obs = observe_counters(df, fmt=fmt)
        (observed.select(mapped.alias("mapped"), F.when(mapped, line).otherwise(raw).alias("value"))
         .write.mode("overwrite").partitionBy("mapped").text(out_path))
        counters = {k: int(v) for k, v in obs.get.items()}
    else:
        cut = limit_written(df, limit, order, fmt=fmt)
        cut.select(line.alias("value")).write.mode("overwrite").text(f"{out_path}/{RECORDS_DIR}")
        df.where(~mapped).select(raw.alias("value")).write.mode("overwrite").text(
            f"{out_path}/{QUARANTINE_DIR}")
        # counted apart: the jobs of the cut read the input more than once
        counters = prep_counters(df, fmt).first().asDict()
        counters["n_written"] = min(int(limit), counters["n_written"])
    if counters.get("n_skipped", 0):
        sample = (df.sparkSession.read.text(f"{out_path}/{QUARANTINE_DIR}").limit(3)
                  .select(F.json_object_keys("value").alias("k")).collect())
        counters["unmapped_keys"] = [r["k"] for r in sample]
    else:
        counters["unmapped_keys"] = []
    if counters.get("n_written", 0) == 0:
        raise RuntimeError("0 records written")
    return counters
