"""Intermediate tables in the folder that all executors share.

Every operator that needs a table twice writes it as Parquet below ``spark.checkpoint.dir`` and reads it
back: lineage is cut, statistics become known, and a lost executor loses nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For sessions in one process only, as in tests
LOCAL_DIR = "/tmp/helioflux-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or what setCheckpointDir named.

    Where neither is set, a local session gets a folder of its own; on a cluster that raises, as executors share
    no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or LOCAL_DIR).rstrip('/')}/helioflux"


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helioflux_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``spill`` that no later plan reads."""
    path = getattr(df, "_helioflux_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[quoted(c) for c in df.columns])


class Scratch(list):
    """Tables spilled on the way to a result; ``clear`` deletes them once nothing reads them any more."""

    def spill(self, df: DataFrame, name: str) -> DataFrame:
        self.append(spill(df, name))
        return self[-1]

    def clear(self) -> None:
        for df in self:
            discard(df)
        super().clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
