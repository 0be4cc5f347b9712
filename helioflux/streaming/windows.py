"""Structured Streaming forms of the binned series, complete to the last window.

A window comes out when the watermark has passed it, so a stream that ends keeps its last windows open for ever. A
bounded stream is therefore closed by an end marker: a row that is null but for a time beyond all others, in a file of
a folder that the stream reads beside its data. ``to_table`` runs the query over all data first, then writes the
marker and lets the same query, from its checkpoint, read it; the watermark passes every open window, and the marker's
own window stays. The order matters only there, so data may come in any number of files and micro-batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import shared_folder

#: Time of an end marker; nanoseconds since 1970 must hold it
END = "2200-01-01 00:00:00"


@dataclass(frozen=True)
class Feed:
    """A stream of rows with a time column ``ts``, and the folder that its end marker goes to."""

    rows: DataFrame
    ends: str

    def map(self, change) -> Feed:
        return Feed(change(self.rows), self.ends)


def source(spark: SparkSession, folder: str, files: str = "*", per_batch: int | None = None) -> Feed:
    """The folder's Parquet files of that name as a stream with ts as a timestamp, and a folder for its end marker.

    ``per_batch``: files to a micro-batch. The marker's folder is new and empty.
    """
    ends = shared_folder(spark, "ends")
    schema = spark.read.parquet(f"{folder}/{files}").schema
    spark.createDataFrame([], "ts timestamp").write.parquet(ends)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    rows = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    marks = spark.readStream.schema(T.StructType([T.StructField("ts", T.TimestampType())])).parquet(ends)
    return Feed(rows.unionByName(marks, allowMissingColumns=True), ends)


def timed(stream: DataFrame, late: str) -> DataFrame:
    """Rows with a watermark; rows later than that are dropped, as in any watermarked stream."""
    return stream.withWatermark("ts", late)


def tumbled(feed: Feed, width: str = "10 minutes", late: str = "1 hour") -> Feed:
    """(bin, flux, cnt): mean value and count per event-time window."""

    def make(rows: DataFrame) -> DataFrame:
        by = timed(rows, late).groupBy(F.window("ts", width))
        return by.agg(F.avg("value").alias("flux"), F.count("value").alias("cnt")).select(F.col("window.start").alias("bin"), "flux", "cnt")

    return feed.map(make)


def slid(feed: Feed, width: str = "30 minutes", step: str = "5 minutes", late: str = "1 hour") -> Feed:
    """(start, end, flux_mean, flux_max, flux_std, cnt) of sliding windows, aligned to the epoch."""

    def make(rows: DataFrame) -> DataFrame:
        by = timed(rows, late).groupBy(F.window("ts", width, step))
        return by.agg(F.avg("value").alias("flux_mean"), F.max("value").alias("flux_max"), F.stddev_pop("value").alias("flux_std"), F.count("value").alias("cnt")).select("window.start", "window.end", "flux_mean", "flux_max", "flux_std", "cnt")

    return feed.map(make)


def sessions(feed: Feed, above: float, gap: str = "2 minutes", late: str = "1 hour", key: str = "event_type") -> Feed:
    """(key, start, end, top, cnt) of runs of values above a level with no gap of ``gap`` or more between them."""

    def make(rows: DataFrame) -> DataFrame:
        # The marker has no value and must reach the watermark, so it passes the filter and leaves no session that ends.
        by = timed(rows, late).where((F.col("value") > above) | F.col("value").isNull()).groupBy(key, F.session_window("ts", gap))
        return by.agg(F.max("value").alias("top"), F.count("value").alias("cnt")).where("cnt > 0").select(key, "session_window.start", "session_window.end", "top", "cnt")

    return feed.map(make)


def run(stream: DataFrame, folder: str) -> None:
    """All there is now, from the folder's checkpoint into its rows."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def ended(feed: Feed) -> None:
    """Writes the feed's end marker."""
    spark = feed.rows.sparkSession
    spark.sql(f"SELECT TIMESTAMP '{END}' AS ts").write.mode("append").parquet(feed.ends)


def to_table(feed: Feed, folder: str | None = None, close: bool = True) -> DataFrame:
    """Runs the stream over all there is now into Parquet files below a shared folder, and returns them as a table.

    close: the stream has ended, so windows still open come out too; otherwise they wait for the next run with this
    folder.
    """
    spark = feed.rows.sparkSession
    folder = folder or shared_folder(spark, "stream")
    run(feed.rows, folder)
    if close:
        ended(feed)
        run(feed.rows, folder)
    return spark.read.schema(feed.rows.schema).parquet(f"{folder}/rows")
