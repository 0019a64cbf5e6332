"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "stratalake", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the toolkit's defaults.

    ``spark.sql.shuffle.partitions`` is left to the caller: on a cluster start
    high (for example 3 x total cores) and let AQE coalesce.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory below the cluster's shared folder.

    The folder is the one named in ``spark.checkpoint.dir``. Only a local
    session, where driver and executors share a disk, may do without it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="stratalake-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder (``*`` matches any name) is there, by asking the store that holds it."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(store.globStatus(pattern))
