"""Chunk exchange: move hashes, not rows.

Counting every window or n-gram of a corpus as DataFrame rows costs tens of
bytes a token in each shuffle.  Here a corpus is first written as *chunks* (a
few MB of rows each, compressed Arrow, in the shared folder).  A chunk sends
every bucket ONE packed array of its distinct keys (so a key that holds a third
of all rows leaves a chunk once), the bucket answers in the same order, and the
chunk -- recomputing its own keys deterministically from its stored rows --
lines the answers up by position.  Executors may be lost at any point: every
step reads written tables or recomputes from them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from weft.llm.words import slices
from weft.session import scratch_dir

#: Text bytes of one chunk (a chunk holds one row at least).  It bounds the
#: memory of a Python task: about ten times this.
CHUNK_BYTES = 4 << 20

_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    """A compressed array; the dtype is the reader's to know."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unpack(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(_ZSTD.decompress(b[8:], n, asbytes=True) if n else b"", dtype=dtype)


def release() -> None:
    """Give freed memory back to the system: a Python worker, reused by later
    stages, keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def n_buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def write_chunks(df: DataFrame, text: str, sort: str | None = None, name: str = "chunks",
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``df`` as rows (chunk_id, n_rows, blob) and read them back.

    Rows stay in the scan task that read them (no shuffle).  ``sort`` orders the
    rows inside a chunk, nulls last.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        held, size, seq = [], 0, 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            if sort is not None:
                t = t.take(pa.compute.sort_indices(t, sort_keys=[(sort, "ascending")]))
            return pa.RecordBatch.from_pydict({
                "chunk_id": pa.array([part + seq], pa.int64()),
                "n_rows": pa.array([t.num_rows], pa.int64()),
                "blob": pa.array([to_blob(t)], pa.binary())})

        for batch in batches:
            for s in slices(batch, text, chunk_bytes // 4):
                held.append(s)
                size += s.column(text).nbytes
                if size >= chunk_bytes:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    path = scratch_dir(df.sparkSession, name)
    (df.mapInArrow(emit, "chunk_id long, n_rows long, blob binary")
       .write.option("compression", "none").parquet(path))
    return df.sparkSession.read.parquet(path)


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): ``order[bounds[b]:bounds[b + 1]]`` are the positions of
    bucket ``b``, ascending."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 65536 else np.uint32), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])


def map_chunks(chunks: DataFrame, fn: Callable[[int, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """``fn(chunk_id, rows)`` yields dicts of equal-length column lists."""
    def run(batches):
        for batch in batches:
            for cid, blob in zip(batch.column("chunk_id").to_pylist(), batch.column("blob"), strict=True):
                for out in fn(cid, from_blob(blob.as_buffer())):
                    yield _batch(out, arrow)
                release()

    arrow = _arrow_schema(chunks.sparkSession, schema)
    return chunks.select("chunk_id", "blob").mapInArrow(run, schema)


def reduce_buckets(parts: DataFrame, fn: Callable[[int, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """``fn(bucket, all its rows)``: one bounded group per bucket."""
    def run(key, table):
        out = [_batch(x, arrow) for x in fn(key[0].as_py(), table)]
        release()
        return pa.Table.from_batches(out, arrow)

    arrow = _arrow_schema(parts.sparkSession, schema)
    return parts.groupBy("bucket").applyInArrow(run, schema)


def join_chunks(chunks: DataFrame, answers: list[DataFrame],
                fn: Callable[..., Iterator[pa.Table | dict]], schema) -> DataFrame:
    """``fn(chunk_id, rows, *answers of the chunk by bucket)``.

    All answers are brought to one shape first, so a chunk and its answers meet
    in a single shuffle by chunk id.
    """
    from functools import reduce

    from pyspark.sql import functions as F

    shaped = []
    for i, a in enumerate(answers):
        payload = [c for c in a.columns if c not in ("chunk_id", "bucket")]
        shaped.append(a.select("chunk_id", F.lit(i).alias("part"), "bucket",
                               F.struct(*payload).alias(f"p{i}")))
    tagged = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), shaped)

    def run(key, left, right):
        if not left.num_rows:
            return pa.Table.from_batches([], arrow)
        cid = key[0].as_py()
        got = []
        for i in range(n):
            mine = right.filter(pa.compute.equal(right.column("part"), i))
            got.append(dict(zip(mine.column("bucket").to_pylist(), mine.column(f"p{i}").to_pylist(), strict=True)))
        out = []
        for x in fn(cid, from_blob(left.column("blob")[0].as_buffer()), *got):
            out.append(_batch(x, arrow) if isinstance(x, dict) else x)
        release()
        return pa.concat_tables([o if isinstance(o, pa.Table) else pa.Table.from_batches([o]) for o in out]) \
            .cast(arrow) if out else pa.Table.from_batches([], arrow)

    n = len(answers)
    arrow = _arrow_schema(chunks.sparkSession, schema)
    return (chunks.select("chunk_id", "blob").groupBy("chunk_id")
            .cogroup(tagged.groupBy("chunk_id")).applyInArrow(run, schema))


def _arrow_schema(spark: SparkSession, schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return to_arrow_schema(schema)


def _batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type)
         for f in schema], schema=schema)
