"""Incremental ingest of archives: a file stream with a checkpoint, a ledger of name and size, an error table.

New archives come through Spark's file source, whose checkpoint remembers them, so a run that finds nothing new reads
nothing. An archive whose size has changed keeps its path, which that source takes for known; it is found by its
listing against the ledger. Both land alike: a batch's members and errors go to partitions named by the batch, which a
repeated batch overwrites, and its ledger rows are written last. Readers take members of batches in the ledger alone,
so a batch that failed half-way is never seen, and each archive counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .instruments import name_of, unpacked
from .ledger import pending

FILES = "path string, modificationTime timestamp, length long, content binary"
LEDGER = "name string, size long, seq long, batch string"
MEMBERS = "archive string, name string, size long, member string, content binary, batch string"
ERRORS = "archive string, name string, size long, error string, batch string"


@dataclass(frozen=True)
class Landing:
    """Where archives land: folders members, errors, ledger and state below ``folder``."""

    spark: SparkSession
    folder: str

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"{self.folder}/{name}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(at) if there else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """(name, size, seq, batch) of archives that have landed; seq grows with batches."""
        return self._table("ledger", LEDGER)

    def current(self) -> DataFrame:
        """The ledger's newest row of each name."""
        newest = Window.partitionBy("name").orderBy(F.col("seq").desc())
        return self.ledger().withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")

    def members(self) -> DataFrame:
        """(archive, name, size, member, content) of each name's newest version."""
        return self._table("members", MEMBERS).join(self.current().select("name", "batch"), ["name", "batch"], "left_semi").drop("batch")

    def errors(self) -> DataFrame:
        """(archive, name, size, error) of newest versions that can't be read."""
        return self._table("errors", ERRORS).join(self.current().select("name", "batch"), ["name", "batch"], "left_semi").drop("batch")

    def land(self, files: DataFrame, batch: str) -> None:
        """files (path, length, content) that the ledger doesn't have, under the batch's name."""
        own = files.withColumns({"name": name_of(F.col("path")), "size": F.col("length")})
        own = pending(own, self.ledger())
        seq = self.ledger().agg(F.coalesce(F.max("seq") + 1, F.lit(0).cast("long")).alias("x")).first()["x"]
        keys = own.select(F.col("path").alias("archive"), "name", "size")
        # Both writes read the archives; what they hold never waits in memory.
        rows = unpacked(own).join(keys, "archive").withColumn("batch", F.lit(batch))
        for what, part in (("members", rows.where("error is null").drop("error")), ("errors", rows.where("error is not null").drop("member", "content"))):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/{what}")
        keys.select("name", "size", F.lit(seq).cast("long").alias("seq"), F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.folder}/ledger")


def synced(spark: SparkSession, archives: str, folder: str, pattern: str = "*.zip") -> Landing:
    """Brings ``folder`` up to date with the archives below ``archives`` and returns it.

    Archives of equal names in different folders are one archive if their sizes are equal, as the ledger goes by name
    and size.
    """
    landing = Landing(spark, folder)
    options = {"recursiveFileLookup": True, "pathGlobFilter": pattern}
    stream = spark.readStream.format("binaryFile").schema(FILES).options(**options).load(archives)
    writer = stream.writeStream.foreachBatch(lambda rows, i: landing.land(rows, f"new-{i}")).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    # The listing alone: contents are read of archives that changed.
    listed = spark.read.format("binaryFile").options(**options).load(archives)
    sizes = listed.select(name_of(F.col("path")).alias("name"), F.col("length").alias("size"))
    changed = pending(sizes, landing.ledger())
    if not changed.isEmpty():
        names = changed.select("name").distinct()
        landing.land(listed.join(names, name_of(F.col("path")) == F.col("name"), "left_semi"), f"changed-{landing.ledger().select('batch').distinct().count()}")
    return landing
