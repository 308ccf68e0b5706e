"""SRC5: following growing log files by byte offset.

A streaming Python data source (``format("log_lines")``).  Its offset holds, for every
file, the end of the last whole line seen and two fingerprints: of the file's first bytes
and of the bytes before that end.  A file continues from the previous offset if its bytes there
still have those fingerprints.  So an append yields the new lines only; a renamed (rotated) file
continues under its new name; a truncated or replaced file starts at 0.  Ranges are read by tasks,
at most ``rangeBytes`` each, and only whole lines are given out, each once.

A batch that is replayed after a failure finds its files by the same fingerprints, under whatever
name they have by then.  What a writer truncates or deletes before it was read cannot be read.

Listing and reading go through ``pyarrow.fs`` (local and mounted folders, HDFS, S3, GCS), in the
session's Python processes: one listing and a few KB a changed file per trigger on the driver,
everything else in tasks.
"""

from __future__ import annotations

import fnmatch
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file STRING, pos BIGINT, line STRING"
#: Bytes of a fingerprint; of one task's range; of one read.
MARK_BYTES = 4096
RANGE_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20


class Range(InputPartition):
    """Lines of one file that start in ``[lo, hi)``; ``mark`` finds the file again."""

    def __init__(self, name: str, lo: int, hi: int, mark: dict):
        super().__init__(None)
        self.name, self.lo, self.hi, self.mark = name, lo, hi, mark


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class Folder:
    """The log files of one folder."""

    def __init__(self, path: str, glob: str):
        self.fs, self.root = open_fs(path)
        self.root, self.glob = self.root.rstrip("/"), glob

    def sizes(self) -> dict[str, int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return {f.base_name: int(f.size) for f in found
                if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob)}

    def read(self, name: str, lo: int, n: int) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            f.seek(lo)
            return bytes(f.read(n))

    def last_line_end(self, name: str, size: int) -> int:
        """The end of the last whole line within the first ``size`` bytes."""
        hi = size
        while hi > 0:
            lo = max(0, hi - CHUNK_BYTES)
            at = self.read(name, lo, hi - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            hi = lo
        return 0

    def mark(self, name: str, end: int) -> dict:
        """What tells that a file still holds the first ``end`` bytes it held."""
        n = min(end, MARK_BYTES)
        return {"end": end, "head": zlib.crc32(self.read(name, 0, n)), "tail": zlib.crc32(self.read(name, end - n, n))}

    def holds(self, name: str, size: int, mark: dict) -> bool:
        if size < mark["end"]:
            return False
        try:
            return self.mark(name, mark["end"]) == mark
        except OSError:  # gone since the listing
            return False


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = Folder(options["path"], options.get("glob", "*"))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.from_end = options.get("startat", "beginning") == "end"
        self.seen: dict[str, dict] = {}

    def _now(self) -> dict:
        out = {}
        for name, size in sorted(self.folder.sizes().items()):
            before = self.seen.get(name)
            try:
                if before and before["size"] == size and self.folder.holds(name, size, before["mark"]):
                    out[name] = before["mark"]
                    continue
                end = self.folder.last_line_end(name, size)
                if end:
                    out[name] = self.folder.mark(name, end)
                    self.seen[name] = {"size": size, "mark": out[name]}
            except OSError:  # renamed or removed since the listing: the next trigger sees it
                continue
        return out

    def initialOffset(self) -> dict:
        return self._now() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if start == end:
            return []
        sizes = self.folder.sizes()

        def current(name: str, mark: dict) -> str | None:
            """The name under which the file of an offset is found now."""
            for x in [name, *(x for x in sizes if x != name)]:
                if x in sizes and self.folder.holds(x, sizes[x], mark):
                    return x
            return None

        out, continued, fresh = [], set(), []
        for name, mark in end.items():
            now = current(name, mark)
            if now is None:
                raise RuntimeError(f"{name} was truncated or removed before its planned lines were read")
            if name in start and start[name]["end"] <= mark["end"] and self.folder.holds(now, sizes[now], start[name]):
                continued.add(name)
                out.append((now, start[name]["end"], mark))
            else:
                fresh.append((now, mark))
        moved = {n: m for n, m in start.items() if n not in continued}
        for now, mark in fresh:  # a renamed file goes on where it stood; any other starts at 0
            old = max((m for m in moved.values() if m["end"] <= mark["end"] and self.folder.holds(now, sizes[now], m)),
                      key=lambda m: m["end"], default=None)
            out.append((now, old["end"] if old else 0, mark))
        return [Range(now, lo, min(lo + self.range_bytes, mark["end"]), mark)
                for now, first, mark in out for lo in range(first, mark["end"], self.range_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        name, end = partition.name, partition.mark["end"]
        sizes = self.folder.sizes()
        if not self.folder.holds(name, sizes.get(name, 0), partition.mark):  # renamed since planning
            name = next((x for x in sizes if self.folder.holds(x, sizes[x], partition.mark)), None)
            if name is None:
                raise RuntimeError(f"{partition.name} was truncated or removed while it was read")
        with self.folder.fs.open_input_file(f"{self.folder.root}/{name}") as f:
            at = partition.lo
            held = b""
            if at:  # a line that starts before the range belongs to the range before
                f.seek(at - 1)
                first = True
            else:
                f.seek(0)
                first = False
            at -= first
            while at + len(held) < end and at < partition.hi:
                more = bytes(f.read(min(CHUNK_BYTES, end - at - len(held))))
                if not more:
                    break
                held += more
                cut = held.rfind(b"\n") + 1
                if not cut:
                    continue
                lines, pos = held[:cut].split(b"\n")[:-1], at
                if first:
                    pos += len(lines[0]) + 1
                    lines, first = lines[1:], False
                places = []
                for x in lines:
                    places.append(pos)
                    pos += len(x) + 1
                keep = sum(p < partition.hi for p in places)
                if keep:
                    text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[:keep]]
                    yield pa.RecordBatch.from_pydict({"file": pa.array([name] * keep), "pos": pa.array(places[:keep], pa.int64()),
                                                      "line": pa.array(text, pa.string())})
                at, held = at + cut, held[cut:]


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})


# executors get the classes with the plan and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def follow_log(spark: SparkSession, folder: str, glob: str = "*", start_at: str = "beginning",
               range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SRC5: a stream of ``(file, pos, line)``, the whole lines appended to the folder's files
    since the last trigger; ``pos`` is the line's first byte.  ``start_at="end"``: only
    what comes after the first start, as a follower of a log does."""
    spark.dataSource.register(LogLines)
    return (spark.readStream.format("log_lines").option("path", folder).option("glob", glob)
            .option("startAt", start_at).option("rangeBytes", range_bytes).load())
