"""The forecast stream against batch features of data cut at each moment."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helioflux.config import STAND_IN
from helioflux.operators import features, series, skill
from helioflux.streaming import live, windows

CHANNELS = {"click": "a", "view": "b", "purchase": "c", "signup": "h"}
SF = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def samples(spark):
    """Two days, with the ends of three events among the samples."""
    rows = spark.read.parquet(SF).select(F.col("ts").cast("timestamp").alias("ts"), "value", "event_type").where("ts < '2024-01-03'")
    ends = spark.sql("SELECT TIMESTAMP '2024-01-01 05:00:10' AS ts, 0D AS value, 'event_end' AS event_type UNION ALL SELECT TIMESTAMP '2024-01-01 11:13:00', 0D, 'event_end' UNION ALL SELECT TIMESTAMP '2024-01-02 07:00:00', 0D, 'event_end'")
    return rows.unionByName(ends).cache()


@pytest.fixture(scope="module")
def folder(spark, samples, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("live"))
    parts = samples.withColumn("_n", F.ntile(6).over(Window.orderBy("ts"))).cache()
    for i in range(6):
        parts.where(F.col("_n") == i + 1).drop("_n").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def out(spark, folder):
    return windows.to_table(live.live_windows(windows.source(spark, folder), STAND_IN, CHANNELS))


def cut(spark, samples, date, i):
    """Batch features of the window [i - lookback, i) of a day whose samples end before bin i."""
    curve = series.light_curve(samples.where("event_type <> 'event_end'").withColumn("user_id", F.lit(0))).where(F.col("date") == date)
    t0 = curve.agg(F.min("t")).first()[0]
    curve = curve.where(F.col("t") < t0 + i * STAND_IN.bin_s)
    rows = series.forecast_background(series.rebin(curve, STAND_IN.bin_s), STAND_IN.bg_window, STAND_IN.bg_least)
    placed = curve.withColumn("k", F.floor((F.col("t") - t0) / STAND_IN.bin_s))
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("counts")))
    by = placed.groupBy("date", "k").agg(*[mean(k).alias(c) for k, c in CHANNELS.items()]).join(rows.select("date", "k", "bg"), ["date", "k"])
    side = by.select("date", "k", *[(F.col(c) / F.col("bg")).alias(c) for c in "abch"])
    ends = spark.createDataFrame([(date, i)], "date string, i long")
    own = features.features(ends, rows.withColumn("norm", F.col("flux") / F.col("bg")), STAND_IN, side, side).first().asDict()
    t = t0 + i * STAND_IN.bin_s
    before = [r[0] for r in samples.where("event_type = 'event_end'").where(F.date_format("ts", "yyyyMMdd") == date).select(F.unix_micros("ts") / 1e6).collect() if r[0] < t]
    own["decayed_flare_history"] = sum(math.exp(-(t - e) / STAND_IN.history_tau_s) for e in before)
    own["time_since_last_flare_min"] = (t - max(before)) / 60 if before else STAND_IN.time_cap_min
    return t, own


def test_windows_equal_batch_features_of_cut_data(spark, samples, out):
    rows = {(r.date, r.i): r for r in out.collect()}
    lookback, _, step, _ = features.bins(STAND_IN)
    for date in ("20240101", "20240102"):
        own = sorted(i for d, i in rows if d == date)
        assert own == list(range(lookback, own[-1] + 1, step)) and len(own) > 30
        for i in (own[0], own[len(own) // 3], own[len(own) // 2], own[-1]):
            t, want = cut(spark, samples, date, i)
            got = rows[date, i].asDict()
            assert got["t"] == pytest.approx(t) and got["data_to"] < t
            for name in live.MEASURED:
                assert got[name] == pytest.approx(want[name], rel=1e-7, abs=1e-9), (date, i, name)


def test_batches_make_no_difference(spark, folder, out):
    many = windows.to_table(live.live_windows(windows.source(spark, folder, per_batch=1), STAND_IN, CHANNELS))
    key = lambda df: {(r.date, r.i): np.array(tuple(r)[2:], float) for r in df.collect()}
    a, b = key(out), key(many)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-9, atol=1e-12) for k in a)


def test_alarms_of_the_stream_are_those_of_its_windows(spark, folder, out):
    """Scoring and alarms in the same query as the windows."""
    prob = 1 / (1 + F.exp(-(F.col("flux_end") - 1.3)))
    feed = live.live_windows(windows.source(spark, folder), STAND_IN, CHANNELS).map(lambda df: df.withColumn("prob", prob))
    got = windows.to_table(live.alarms(feed, 0.5))
    want = skill.transitions(out.withColumn("prob", prob), 0.5)
    pick = lambda df: sorted((r.date, r.t, r.what) for r in df.collect())
    assert pick(got) == pick(want) and got.count() > 2


class Held(list):
    """A list state."""

    get, appendValue, appendList = list.copy, list.append, list.extend


def test_a_batch_of_rows_is_one_value_of_state():
    """A value for each row costs a call to the state's server each."""
    made = {}
    handle = type("Handle", (), {"getListState": lambda _, name, schema: made.setdefault(name, Held()), "getValueState": lambda *_: type("No", (), {"exists": lambda _: False})(), "listTimers": lambda _: [], "registerTimer": lambda *_: None})()
    processor = live.WindowProcessor(STAND_IN, CHANNELS)
    processor.init(handle)
    frame = pd.DataFrame({"micros": np.arange(5000) * 1_000_000, "value": np.arange(5000) / 7, "kind": ["click", "error", live.EVENT_END, None, "signup"] * 1000})
    assert list(processor.handleInputRows(("20240101",), iter([frame, frame.iloc[:0]]), None)) == []
    assert len(made["waiting"]) == 1
    held = np.frombuffer(made["waiting"][0][0], live.SAMPLE)
    assert len(held) == 4000 and held["code"][:4].tolist() == [1, live.NO_CHANNEL, live.ENDED, 4] and held["value"][1] == 1 / 7
