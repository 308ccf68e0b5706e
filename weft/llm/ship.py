"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """What ``--py-files`` does, for sessions started without it: zip the
    package once per application and let Spark hand it to every executor.

    Rows here are texts of kilobytes, so unless the session says otherwise an
    Arrow batch gets fewer of them than Spark's default."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "500")
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(sc._temp_dir, "weft.zip")  # the driver's own folder, served by Spark
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
