"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: For sessions in one process only, as in tests
LOCAL_DIR = "/tmp/helioflux-checkpoints"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir`` or what setCheckpointDir named.

    Where neither is set, a local session gets one of its own; on a cluster that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or LOCAL_DIR).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once and read back, so that plans which use it several times don't make it several times."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
