"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a join partition that one hot (date, product) or key made too large.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, app: str = "paceline", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.driver.memory": "8g",
        # Column call sites are kept for error messages only and slow plan building.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.shuffle.partitions": str(cores),
        **{key.replace("__", "."): value for key, value in extra.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder the cluster names in spark.checkpoint.dir.

    Only a session of one machine that names none (a test) gets a local folder,
    which goes when the process ends; the session's settings stay as they are.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_folder()
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.TemporaryDirectory(prefix="paceline-")
    atexit.register(folder.cleanup)
    return folder.name
