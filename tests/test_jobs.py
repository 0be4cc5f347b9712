"""From generated instrument tables to a saved forecast, and from it back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioflux import jobs, sinks
from helioflux.config import Config
from helioflux.operators import features, learning, replay

CONFIG = Config(bin_s=60.0, bg_window=60, bg_least=15, min_dur_bins=2, merge_gap_s=120.0, focus_threshold=100.0, step_min=10, dense_min=5, decay_min=20, rows_seen=0.6)
DAYS = [f"202401{d:02d}" for d in range(1, 7)]
START = 1_704_067_200


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Six days of a sample every 30 s; each flare is announced by a slow rise of the hard curve and of band B."""
    rng = np.random.default_rng(3)
    curve, soft, bands = [], [], []
    for d, date in enumerate(DAYS):
        t = START + 86400 * d + np.arange(0, 28800, 30.0)
        base, hard = np.full(len(t), 20.0), np.full(len(t), 5.0)
        for at in rng.choice(np.arange(2, 7), 3, replace=False) * 3600.0 + rng.uniform(0, 1800, 3):
            x = t - (START + 86400 * d + at)
            base += np.where(x >= 0, 400 * np.exp(-x / 400), 0)
            hard += np.where((x > -1800) & (x < 600), 20 * (x + 1800) / 1800, 0)
        counts = rng.poisson(base).astype(float)
        curve += [(date, float(a), float(b)) for a, b in zip(t, counts, strict=True)]
        for a, b, c in zip(t[::2], base[::2], hard[::2], strict=True):
            spectrum = np.zeros(340)
            spectrum[60:120], spectrum[120:240] = b / 60, c / 240
            soft.append((date, "soft", float(a), [float(v) for v in rng.poisson(spectrum * 10)], 1.0))
            bands += [(date, lo, hi, float(a), float(rng.poisson(c * w))) for lo, hi, w in ((20.0, 40.0, 5), (40.0, 60.0, 2), (1.8, 90.0, 9))]
    folder = str(tmp_path_factory.mktemp("inputs"))
    for name, rows, schema in (("curve", curve, "date string, t double, counts double"), ("soft", soft, "date string, detector string, t double, counts array<double>, exposure double"), ("bands", bands, "date string, e_lo double, e_hi double, t double, ctr double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")
    return jobs.Inputs(*[spark.read.parquet(f"{folder}/{n}") for n in ("curve", "soft", "bands")])


@pytest.fixture(scope="module")
def windows(inputs):
    return jobs.windows_of(jobs.assembled(inputs, CONFIG), CONFIG).cache()


def test_windows_of_readers_tables(windows):
    """All features come from data, labels and unlabelled windows are both there, and bands and hard features vary."""
    assert set(features.NAMES) < set(windows.columns)
    some = windows.agg(*[F.count_distinct(x).alias(x) for x in ("flux_bandA", "ratio_B_A", "helos_flux_mean", "gamma_window", "temp_trend_MK_per_min", "decayed_flare_history")], F.avg("label").alias("share")).first()
    assert all(some[x] > 20 for x in some.asDict() if x != "share") and 0.05 < some["share"] < 0.95
    own = windows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.date for r in own} == set(DAYS)


def test_trained_saved_loaded_forecast(spark, inputs, windows, tmp_path):
    folder = str(tmp_path / "model")
    out = jobs.train(windows, folder, ("logistic", "forest_shallow"), params={"forest_shallow": {"numTrees": 10}})
    assert out.candidates.count() == 2 and out.sweep.count() > 5 and out.tally.count() == 1
    assert out.leads.count() > 0 and out.folds.count() > 0
    # What is loaded scores as what was saved did.
    model = learning.loaded(spark, folder)
    point = json.loads(spark.read.text(f"{folder}/operating_point").first()[0])
    assert model.threshold == point["threshold"] and point["n_features"] == 43
    keys = ["date", "t"]
    again = model.scored(out.test.drop("prob", "alarm")).select(*keys, F.col("prob").alias("p"))
    assert out.test.join(again, keys).where(F.abs(F.col("prob") - F.col("p")) > 1e-12).isEmpty() and again.count() == out.test.count()
    # The test predictions keep the names of their columns.
    csv = spark.read.option("header", True).csv(f"{folder}/test_predictions")
    assert {"prob", "alarm_default_0.5", f"alarm_f0.5_{point['threshold']:.3f}"} <= set(csv.columns)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.predictions_csv(csv, f"{folder}/test_predictions")
    # The forecast at a moment is that of the window which ends there, of cut data.
    at = jobs.at_moment(spark, inputs, CONFIG, folder, DAYS[-1], "06:10").orderBy("minutes").collect()
    assert [r.minutes for r in at] == [5, 10, 15, 20, 25, 30] and at[-1].p == pytest.approx(at[-1].prob) and at[0].p < at[-1].p
    assert at[0].t <= START + 86400 * 5 + 6 * 3600 + 600 and at[0].level > 0
    later = jobs.Inputs(*[df.where(F.col("t") <= START + 86400 * 5 + 6 * 3600 + 1200) for df in (inputs.curve, inputs.soft, inputs.bands)])
    cut = jobs.at_moment(spark, later, CONFIG, folder, DAYS[-1], "06:10").orderBy("minutes").collect()
    assert [(r.t, r.prob, r.alarm, r.level, r.started) for r in cut] == [(r.t, r.prob, r.alarm, r.level, r.started) for r in at]
    assert jobs.at_moment(spark, inputs, CONFIG, folder, DAYS[-1], "18:334").isEmpty()
    # The whole days again, as if live.
    changes, cards = jobs.replayed(jobs.Inputs(*[df.where(F.col("date") >= DAYS[-2]) for df in (inputs.curve, inputs.soft, inputs.bands)]), CONFIG, folder)
    assert {r.what for r in changes.collect()} <= {"raised", "all-clear"} and {r.date for r in cards.collect()} == set(DAYS[-2:])


def test_balance_counts_high_events(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "date string, label int")
    events = spark.createDataFrame([("a", 9.0), ("a", 8.0), ("a", 2.0)], "date string, ratio double")
    assert [tuple(r) for r in features.balance(rows, events).orderBy("date").collect()] == [("a", 2, 1, 2), ("b", 1, 0, 0)]


def test_spread_and_ongoing(spark):
    rows = spark.createDataFrame([(0.5, 3.0, 10.0), (0.5, 1.0, 10.0), (0.5, 3.0, None)], "prob double, level double, started double")
    assert [r.o for r in rows.select(replay.ongoing(F.col("level"), F.col("started")).alias("o")).collect()] == [True, False, False]
    p = {r.minutes: r.p for r in replay.spread(rows.limit(1)).collect()}
    assert p[30] == pytest.approx(0.5) and p[15] == pytest.approx(1 - 0.5**0.5)
