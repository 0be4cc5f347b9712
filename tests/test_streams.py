"""Streams against batch results: complete, in one and in many micro-batches, and after a restart."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helioflux.config import STAND_IN
from helioflux.streaming import scan, windows

SMALL = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in twelve files, in order of time."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(SMALL)
    for i in range(12):
        rows.withColumn("_n", F.ntile(12).over(Window.orderBy("ts"))).where(F.col("_n") == i + 1).drop("_n").coalesce(1).write.mode("append").parquet(path)
    return path


def at(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC)


def same(a, b):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def batch(spark):
    return spark.read.parquet(SMALL).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("per_batch", [None, 1])
def test_windows_are_complete(spark, folder, per_batch):
    feed = windows.source(spark, folder, per_batch=per_batch)
    out = windows.to_table(windows.tumbled(feed, "1 hour"))
    own = batch(spark).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.round(F.avg("value"), 6).alias("flux"), F.count("value").alias("cnt"))
    same(out.select("bin", F.round("flux", 6), "cnt"), own.select("w.start", "flux", "cnt"))


@pytest.mark.parametrize("per_batch", [None, 3])
def test_sessions_are_complete(spark, folder, per_batch):
    out = windows.to_table(windows.sessions(windows.source(spark, folder, per_batch=per_batch), 60.0, "30 minutes"))
    own = batch(spark).where("value > 60").groupBy("event_type", F.session_window("ts", "30 minutes").alias("w")).agg(F.max("value").alias("top"), F.count("value").alias("cnt"))
    same(out, own.select("event_type", "w.start", "w.end", "top", "cnt"))


def test_open_windows_wait_for_the_next_run(spark, folder, tmp_path):
    """Without an end the last windows stay open; a second run with the same folder goes on where the first stopped."""
    feed = windows.slid(windows.source(spark, folder), "3 hours", "1 hour")
    part = windows.to_table(feed, str(tmp_path / "s"), close=False).count()
    whole = windows.to_table(feed, str(tmp_path / "s"))
    own = batch(spark).groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("value").alias("cnt"))
    assert part < whole.count()
    same(whole.select("start", "end", "cnt"), own.select("w.start", "w.end", "cnt"))


@pytest.mark.parametrize("per_batch", [None, 1])
def test_keyed_scan_equals_the_batch_scan(spark, folder, per_batch):
    out = windows.to_table(scan.scanned(windows.source(spark, folder, per_batch=per_batch), STAND_IN))
    assert out.where("late > 0").isEmpty()
    same(out.drop("late"), scan.scanned_batch(batch(spark), STAND_IN))


def test_keyed_scan_goes_on_after_a_restart_and_counts_late_rows(spark, tmp_path):
    base = 1_700_000_400
    rows = lambda *x: spark.createDataFrame([(at(t), "a", float(v)) for t, v in x], "ts timestamp, event_type string, value double").coalesce(1)
    first = [(base + 60 * i, 10 + i % 3) for i in range(200)]
    second = [(base + 60 * i, 40) for i in range(200, 300)]
    late = [(base + 5, 7)]
    data, state = str(tmp_path / "d"), str(tmp_path / "s")
    rows(*first).write.parquet(data)
    feed = scan.scanned(windows.source(spark, data), STAND_IN, late="10 minutes")
    n = windows.to_table(feed, state, close=False).count()
    rows(*second).write.mode("append").parquet(data)
    windows.to_table(feed, state, close=False)
    rows(*late).write.mode("append").parquet(data)
    out = windows.to_table(feed, state)
    assert 0 < n < out.count()
    same(out.drop("late"), scan.scanned_batch(rows(*first, *second), STAND_IN))
    assert out.agg(F.max("stat")).first()[0] > STAND_IN.focus_threshold


def test_silent_keys_start_anew(spark, tmp_path):
    base = 1_700_000_400
    rows = spark.createDataFrame([(at(base + 600 * k), "a", 5.0 + k % 2) for k in [*range(20), *range(60, 80)]], "ts timestamp, event_type string, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "d"))
    out = windows.to_table(scan.scanned(windows.source(spark, str(tmp_path / "d")), STAND_IN, expire=30))
    assert out.count() == 40
    same(out.drop("late"), scan.scanned_batch(rows, STAND_IN, expire=30))
    filled = windows.to_table(scan.scanned(windows.source(spark, str(tmp_path / "d")), STAND_IN))
    assert filled.count() == 80
