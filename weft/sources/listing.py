"""Directory listings by tasks (SRC8 - SRC10, U1): a batch Python data source.

The driver lists each root once, not recursively; every directory directly under a root is a
partition, listed recursively by its task, and the root's own files are one more.  Only
metadata is read.  A root that does not exist lists nothing.  Stores are reached through
``pyarrow.fs`` (local and mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = ("source STRING, priority INT, root STRING, path STRING, rel_path STRING, name STRING, is_dir BOOLEAN, "
          "length BIGINT, modified TIMESTAMP")
#: Entries of one Arrow batch.
BATCH = 8192


class Part(InputPartition):
    def __init__(self, label: str, priority: int, root: str, sub: str | None):
        super().__init__(None)
        self.label, self.priority, self.root, self.sub = label, priority, root, sub


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.glob = options.get("glob", "*")
        self.recursive = options.get("recursive") == "true"

    def partitions(self) -> list[Part]:
        out = []
        for priority, (label, root) in enumerate(self.roots):
            fs, base = open_fs(root)
            entries = fs.get_file_info(pafs.FileSelector(base.rstrip("/"), allow_not_found=True))
            if entries:
                out.append(Part(label, priority, root, None))
            if self.recursive:
                out += [Part(label, priority, root, e.base_name) for e in entries if e.type == pafs.FileType.Directory]
        return out or [Part("", 0, "", None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.root:
            return
        fs, base = open_fs(partition.root)
        base = base.rstrip("/")
        shown = re.sub(r"^file:(//)?", "", partition.root).rstrip("/")
        where = base if partition.sub is None else f"{base}/{partition.sub}"
        found = fs.get_file_info(pafs.FileSelector(where, allow_not_found=True, recursive=partition.sub is not None))
        rows = []
        for e in found:
            is_dir = e.type == pafs.FileType.Directory
            if not is_dir and not fnmatch.fnmatchcase(e.base_name, self.glob):
                continue
            rel = e.path[len(base) + 1:]
            rows.append((partition.label, partition.priority, shown, f"{shown}/{rel}", rel, e.base_name, is_dir,
                         0 if is_dir else int(e.size), e.mtime))
        rows.sort(key=lambda r: r[4])
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(),
                 pa.timestamp("us", tz="UTC")]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for lo in range(0, len(rows), BATCH):
            cols = zip(*rows[lo:lo + BATCH], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader({k.lower(): v for k, v in self.options.items()})


# tasks get the classes with the plan and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def listing(spark: SparkSession, roots: list[tuple[str, str]], glob: str = "*", recursive: bool = False) -> DataFrame:
    """Files that match ``glob`` and all directories under ``(label, root)`` pairs; ``priority`` is a root's
    place in the list, ``rel_path`` is relative to it."""
    spark.dataSource.register(FileListing)
    return (spark.read.format("file_listing").option("roots", json.dumps([list(r) for r in roots])).option("glob", glob)
            .option("recursive", str(recursive).lower()).load())
