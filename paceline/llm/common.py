"""What the operators share: tables, the shared folder and files in any store."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession

from paceline.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's address below spark.checkpoint.dir, which all executors reach.

    Only a local master may go without that setting; it then gets a temporary folder
    that goes with the process.
    """
    address = scratch_path(spark, label)
    return address if "://" in address else f"file://{address}"


def store_of(address: str) -> tuple[stores.FileSystem, str]:
    """The file system of an address (file, hdfs, s3, gs ...) and the path in it."""
    return stores.FileSystem.from_uri(address if "://" in address else f"file://{address}")


def stored(frame: DataFrame, address: str) -> DataFrame:
    """The frame, written as Parquet and read again: cuts lineage, survives lost executors."""
    frame.write.mode("overwrite").parquet(address)
    return frame.sparkSession.read.schema(frame.schema).parquet(address)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives back Arrow memory that a worker process holds without using it."""
    pa.default_memory_pool().release_unused()
