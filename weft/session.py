"""Session helpers.

Everything in this package is a DataFrame -> DataFrame function; the only
session-level knobs we rely on are AQE (runtime coalescing and skew-join
splitting) and a shared checkpoint directory for cutting lineage.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "weft") -> SparkSession:
    """A session configured the way the operators expect.

    On a cluster the master and the sizes come from spark-submit; a setting
    already present there (or in spark-defaults) is never overridden -- only
    unset ones are filled in.  ``spark.ui.enabled`` stays off: no web server.
    """
    from pyspark import SparkConf, SparkContext

    if os.environ.get("PYSPARK_GATEWAY_PORT"):
        # Launched by spark-submit: attach to its JVM so SparkConf sees --conf.
        SparkContext._ensure_initialized()
    present = SparkConf()  # spark-submit / spark-defaults values (empty in plain python)
    cpus = os.cpu_count() or 8
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Streaming state off the JVM heap, checkpointed as change logs.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.driver.memory": os.environ.get("WEFT_DRIVER_MEMORY", "16g"),
    }
    builder = SparkSession.builder.appName(app_name)
    if master and not present.contains("spark.master"):
        builder = builder.master(master)
    for k, v in defaults.items():
        if not present.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system, never a local temp
    folder).  Only when it is unset -- tests, local runs -- do we set our own,
    from ``fallback`` or a fresh folder under the system temp directory.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    if fallback is None:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store); "
                               "a machine-local folder does not survive a lost executor")
        fallback = tempfile.mkdtemp(prefix="weft-ckpt-")
    d = fallback
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint directory."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/weft-{name}-{uuid.uuid4().hex[:12]}"
