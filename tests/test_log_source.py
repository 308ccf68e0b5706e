"""Following log files by byte offset: appends, partial lines, rotation, truncation, restarts."""

import os
import random

from weft.sources.log_source import follow_log


def _drain(spark, tmp, **options):
    q = (follow_log(spark, f"{tmp}/logs", **options).writeStream.format("parquet").option("path", f"{tmp}/out")
         .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return sorted(r.line for r in spark.read.schema("file STRING, pos BIGINT, line STRING").parquet(f"{tmp}/out").collect())


def _append(path, data, mode="ab"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def test_lines_arrive_once_through_appends_rotation_and_truncation(spark, tmp):
    log = f"{tmp}/logs/app.log"
    _append(log, b"start\na1\na2\npart")
    _append(f"{tmp}/logs/b.log", b"start\nb1\r\n")
    want = ["a1", "a2", "b1", "start", "start"]
    assert _drain(spark, tmp) == sorted(want)
    _append(log, b"ial\na3\n\n")  # the half line is completed; an empty line is a line
    want += ["partial", "a3", ""]
    assert _drain(spark, tmp) == sorted(want)
    assert _drain(spark, tmp) == sorted(want)  # nothing new, nothing twice
    os.rename(log, f"{tmp}/logs/app.log.1")  # rotated, with a line behind the last read
    _append(f"{tmp}/logs/app.log.1", b"a4\n")
    _append(log, b"start\nnew1\n")
    want += ["a4", "start", "new1"]
    assert _drain(spark, tmp) == sorted(want)
    _append(log, b"tiny\n", "wb")  # truncated and written again
    want += ["tiny"]
    assert _drain(spark, tmp) == sorted(want)
    os.rename(f"{tmp}/logs/app.log.1", f"{tmp}/logs/app.log.2")
    os.rename(log, f"{tmp}/logs/app.log.1")
    _append(log, b"z1\nz2\n")
    _append(f"{tmp}/logs/b.log", "b2 é�\n".encode() + b"\xff\n")
    want += ["z1", "z2", "b2 é�", "�"]
    assert _drain(spark, tmp) == sorted(want)


def test_ranges_and_positions(spark, tmp):
    rng = random.Random(3)
    lines = ["x" * rng.choice([0, 1, 5, 40, 300]) + str(i) for i in range(400)]
    data = "".join(x + "\n" for x in lines).encode()
    _append(f"{tmp}/logs/a.log", data)
    assert _drain(spark, tmp, range_bytes=97) == sorted(lines)
    rows = spark.read.parquet(f"{tmp}/out").collect()
    for r in rows:
        assert data[r.pos:].startswith(r.line.encode() + b"\n")
    assert len({r.pos for r in rows}) == len(lines)


def test_start_at_end(spark, tmp):
    _append(f"{tmp}/logs/a.log", b"old\n")
    q = (follow_log(spark, f"{tmp}/logs", glob="*.log", start_at="end").writeStream.format("memory").queryName("tailed")
         .option("checkpointLocation", f"{tmp}/ck2").start())
    try:
        q.processAllAvailable()
        _append(f"{tmp}/logs/a.log", b"new\n")
        _append(f"{tmp}/logs/a.txt", b"not accepted\n")
        q.processAllAvailable()
        assert [r.line for r in spark.table("tailed").collect()] == ["new"]
    finally:
        q.stop()


def test_no_files_yet(spark, tmp):
    q = (follow_log(spark, f"{tmp}/none").writeStream.format("noop").option("checkpointLocation", f"{tmp}/ck3")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
