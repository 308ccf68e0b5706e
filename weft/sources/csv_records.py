"""SRC2 for large files: quoted CSV read by many tasks.

A quoted field may hold newlines, so a line is not a record, and Spark's
``multiLine`` reader gives a whole file to one task.  Here files are read as
lines, in splits, twice:

1. the quotes of every split are counted (an aggregate); their parity, summed over
   the splits before it in the file, says whether a split begins inside quotes;
2. every split joins its lines into records, a newline inside quotes staying part of
   the record.  What a split cannot finish -- the lines before its first record start, and a
   last record left open -- goes on as fragments, two a split at most, which are put together
   by file.

Whole records are then parsed by ``from_csv``.  Any store that Spark's text reader
reaches will do.  One row a split (of ``spark.sql.files.maxPartitionBytes``) goes
through the driver, as in any file scan.

The quote rule is that of RFC 4180: a field that holds quotes is quoted, quotes in it
doubled.  A quote that opens in the middle of an unquoted field would shift the parity of
all that follows; it raises an error that says so.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = "file STRING, block BIGINT, seq BIGINT, kind STRING, record STRING, first BOOLEAN"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def csv_lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``(file, block, seq, record, first)``: the whole records of CSV files as text; ``block`` and
    ``seq`` (split and place in it) order a file's records, ``first`` marks each file's
    first record (its header).  Blank lines between records are dropped."""
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("q"))
    before = F.sum("q").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = odd.withColumn("b", F.coalesce(before, F.lit(0)) % 2).where("b = 1").select("file", "block").collect()
    starts_inside = spark.sparkContext.broadcast({(r[0], r[1]) for r in inside})
    parts = lines.mapInArrow(_splicer(starts_inside, delimiter), _PARTS)
    path_ = _stored(spark, parts)
    whole = path_.where("kind = 'whole'").select("file", "block", "seq", "record", "first")
    # fragments: a tail opens a record, heads and middles go on with it
    frag = path_.where("kind != 'whole'")
    number = F.sum((F.col("kind") == "tail").cast("long")).over(
        Window.partitionBy("file").orderBy("block", F.col("kind") == "tail").rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("kind") != "tail"  # a split's head comes before its tail; a record's tail is its beginning
    joined = (frag.withColumn("n", number).groupBy("file", "n")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", rank.alias("r"), "record"))),
                                            lambda x: x["record"]), "\n").alias("record"),
                   F.min(F.when(F.col("kind") == "tail", F.struct("block", "seq"))).alias("at"),
                   F.max("first").alias("first")))
    return whole.unionByName(joined.select("file", "at.block", "at.seq", "record", "first"))


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    from weft.session import scratch_dir

    path = scratch_dir(spark, "csv-records")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _splicer(starts_inside, delimiter: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        open_: list[str] = []  # lines of a record that is not finished
        inside = head = False
        seq = 0
        out: list[tuple] = []

        def put(kind: str, record: str) -> None:
            nonlocal seq
            out.append((*key, seq, kind, record, key[1] == 0 and seq == 0))
            seq += 1

        def close_split() -> None:
            if open_:
                put("middle" if head else "tail" if inside else "whole", "\n".join(open_))
                open_.clear()

        def batch_out() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                           ["file", "block", "seq", "kind", "record", "first"])
            out.clear()
            return b

        for batch in batches:
            files = batch.column("file").to_pylist()
            blocks = batch.column("block").to_pylist()
            odd = pc.bit_wise_and(pc.count_substring(batch.column("value"), '"'), 1).to_numpy(zero_copy_only=False)
            for line, f, b, q in zip(batch.column("value").to_pylist(), files, blocks, odd.tolist(), strict=True):
                if key != (f, b):
                    if key is not None:
                        close_split()
                    key, seq = (f, b), 0
                    inside = head = key in starts_inside.value
                if not inside and not open_ and not line.strip("\r"):
                    continue  # a blank line between records
                open_.append(line)
                inside = inside != bool(q)
                if not inside:
                    record = "\n".join(open_)
                    if not head:
                        _check(record, delimiter)
                    put("head" if head else "whole", record)
                    open_.clear()
                    head = False
            if out:
                yield batch_out()
        if key is not None:
            close_split()
        if out:
            yield batch_out()
    return run


def _check(record: str, delimiter: str) -> None:
    """Every opening quote stands at the start of a field (or doubles a closing one)."""
    if '"' not in record:
        return
    raw = record.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    at = np.flatnonzero(data == 34)
    opening = at[0::2]
    prev = data[np.maximum(opening - 1, 0)]
    ok = (opening == 0) | (prev == ord(delimiter)) | (prev == 34)
    if not ok.all():
        raise ValueError(f"a quote inside an unquoted field: {record[:200]!r}; read this file with multiline='whole'")


#: The order of records, as :func:`read_csv_records` gives it on request.
ORDER = ("_file", "_block", "_row")


def read_csv_records(spark: SparkSession, path: str, delimiter: str = ",", keep_order: bool = False) -> DataFrame:
    """The columns of header CSV files, every value a string.  The header is that of the first
    file by name; all files share it.  ``keep_order`` adds the columns ORDER."""
    if len(delimiter.encode()) != 1:
        raise ValueError("a delimiter of one byte")
    records = csv_lines(spark, path, delimiter)
    head = records.where("first").orderBy("file").select("record").first()
    if head is None:
        raise ValueError(f"no header in {path}")
    names = next(csv.reader(io.StringIO(head[0].rstrip("\r").lstrip("﻿"), newline=""), delimiter=delimiter))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    body = F.regexp_replace(F.col("record"), r"\r$", "")
    parsed = F.from_csv(body, schema.simpleString()[len("struct<"):-1].replace(":", " "),
                        {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true",
                         "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(names) + 1))})
    rows = records.where(~F.col("first")).select("file", "block", "seq", parsed.alias("r"))
    order = [F.col(c).alias(n) for c, n in zip(("file", "block", "seq"), ORDER, strict=True)] if keep_order else []
    return rows.select(*order, *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


# tasks get this module's functions with the plan and need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
