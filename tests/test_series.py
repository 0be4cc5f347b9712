import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helioflux import queries as own
from helioflux.config import Config
from helioflux.functions import scalar
from helioflux.operators import checks, detect, intervals, series, skill

DATA = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*[x.alias(c) for c, x in columns.items()]).first()


def curve(spark, t, v):
    return spark.createDataFrame([("d", float(a), float(b)) for a, b in zip(t, v, strict=True)], "date string, t double, counts double")


def test_rebin(spark):
    flux = lambda t, v: [r.flux for r in series.rebin(curve(spark, t, v), 10).orderBy("k").collect()]
    assert flux([0, 1, 9, 10, 25], [2, 4, 6, 8, 10]) == [4, 8, 10]
    assert flux([0, 1, 25], [2, 4, 10]) == [3, 0, 10]


def test_scan_takes_the_last_segment():
    stat, onset = detect.scan(np.array([10.0, 10, 40]), np.array([10.0, 10, 10]), Config())
    assert stat == pytest.approx([0, 0, 25.4518], abs=1e-4) and onset.tolist() == [-1, -1, 2]


def test_scan_is_zero_on_constant_data():
    stat, _ = detect.scan(np.full(500, 7.0), np.full(500, 7.0), Config())
    assert stat.max() < 1e-9


def test_fred(spark):
    rows = spark.createDataFrame([("d", i, float(x)) for i, x in enumerate([10, 20, 10, 10])], "date string, k long, flux double")
    assert [r.fred for r in series.fred(rows).orderBy("k").collect()] == pytest.approx([0, -4, -1.6, -0.44])


def test_noisy_or(spark):
    assert one(spark, p=scalar.noisy_or(F.array(F.lit(0.8), F.lit(0.8), F.lit(None).cast("double")))).p == pytest.approx(0.96)
    assert one(spark, p=scalar.noisy_or(F.array().cast("array<double>"))).p == 0


@pytest.mark.parametrize(("above", "want"), [([0, 1, 1, 1, 1, 1, 1, 0], [(1, 7)]), ([0, 1, 1, 1, 1, 1, 1], [(1, 6)]), ([0, 1, 1, 1, 1, 1, 1, 1], [(1, 7)])])
def test_islands(spark, above, want):
    rows = spark.createDataFrame([("d", i, bool(x)) for i, x in enumerate(above)], "date string, k long, above boolean")
    assert [(r.s, r.e) for r in intervals.islands(rows, "above", 6).collect()] == want


def test_merge(spark):
    merge = lambda rows: sorted((r.s, r.e) for r in intervals.merged(spark.createDataFrame([("d", *x) for x in rows], "date string, s long, e long"), 12).collect())
    assert merge([(0, 10), (22, 30)]) == [(0, 30)]
    assert merge([(0, 10), (23, 30)]) == [(0, 10), (23, 30)]


def test_gradient(spark):
    rows = spark.createDataFrame([("d", i, float(x), float(y)) for i, (x, y) in enumerate(zip([0, 1, 3, 4], [1, 2, 4, 8], strict=True))], "date string, k long, x double, y double")
    assert [r.g for r in rows.select("k", series.gradient("y", "x").alias("g")).orderBy("k").collect()] == pytest.approx([1, 1, 3, 4])


def test_interpolation_clamps(spark):
    known = spark.createDataFrame([("d", 1.0, 10.0), ("d", 2.0, 20.0), ("d", 4.0, 40.0)], "date string, t double, y double")
    clock = spark.createDataFrame([("d", 0.0), ("d", 2.5), ("d", 9.0)], "date string, t double")
    assert [r.y for r in intervals.interpolated(clock, known).orderBy("t").collect()] == [10, 25, 40]


def test_scalars(spark):
    row = one(spark, a=scalar.channel_kev(F.lit(168)), b=scalar.channel_kev(F.lit(340)), u=scalar.mjd_to_unix(F.lit(60000)), m=scalar.goes_class(F.lit(3.5e-5)), s=scalar.goes_class(F.lit(5e-9)), z=scalar.goes_class(F.lit(0.0)), x=scalar.approx_class(F.lit(1.1), F.lit(7900)), h=scalar.horizon(F.lit(0.08), F.lit(5)))
    assert row.a == pytest.approx(7.9968) and row.b == pytest.approx(24.3712) and row.u == 1677283200
    assert (row.m, row.s, row.z, row.x) == ("M3.5", "<A1", None, "X-like") and row.h == pytest.approx(0.0138008, abs=1e-7)


def test_confidence(spark):
    schema = "n_pass int, n_flag int, focus_stat double, fred double, excess double, confirmed boolean, match double, yes int"
    rows = [(2, 1, 300.0, None, None, None, None, None), (0, 0, None, 2.0, -5.0, False, 0.9, 1), (0, 0, None, None, 1.0, True, 0.9, 3)]
    out = [(r.confidence_pct, r.confidence) for r in checks.confidence(spark.createDataFrame(rows, schema)).collect()]
    # An excess below 0 reads as a millionth; a match counts only where confirmed.
    assert out == [(81.7, 0.333), (60.0, 0.0), (97.5, 0.0)]


def test_noise_is_that_of_flux_above_background(spark):
    """A background that climbs with the flux makes no noise."""
    rows = [("d", k, 100.0 * k + (3.0 if k % 2 else 0.0), 100.0 * k) for k in range(12)]
    got = {r.k: r.noise for r in series.noise(spark.createDataFrame(rows, "date string, k long, flux double, bg double"), 4).collect()}
    assert [got[k] for k in range(3, 10)] == pytest.approx([3 * 1.4826 / 2**0.5] * 7)


def sorted_frames(rows, window, p, least):
    """By definition: sort each frame anew."""
    out = []
    for i in range(len(rows)):
        frame = sorted(x for x in rows[max(i - window // 2, 0) : i + (window + 1) // 2] if x == x)
        at = p * (len(frame) - 1)
        out.append(frame[int(at)] + (frame[min(int(at) + 1, len(frame) - 1)] - frame[int(at)]) * (at % 1) if len(frame) >= least else None)
    return out


@pytest.mark.parametrize(("window", "least"), [(120, 30), (24, 6), (7, 1), (2, 2)])
def test_sliding_order_statistics(spark, window, least):
    rng = np.random.default_rng(window)
    flux = {d: [float(x) for x in rng.integers(0, 30, n)] for d, n in (("a", 400), ("b", 150), ("c", 5))}
    rows = spark.createDataFrame([(d, k, x) for d, v in flux.items() for k, x in enumerate(v)], "date string, k long, flux double").orderBy(F.rand(1))
    for p in (0.1, 0.5):
        got = {(r.date, r.k): r.bg for r in series.background(rows, window, least, p).collect()}
        for d, v in flux.items():
            want = sorted_frames(v, window, p, least)
            known = [i for i, x in enumerate(want) if x is not None]
            for k in range(len(v)):
                at = next((i for i in reversed(known) if i <= k), known[0] if known else None)
                assert got[d, k] == (pytest.approx(want[at]) if at is not None else None)
    both = {(r.date, r.k): (r.med, r._m) for r in series.robust(rows, window, least).collect()}
    apart = {(r.date, r.k): (r.med, r.noise) for r in series.noise(series.background(series.background(rows, window, least), window, least, 0.5, "med"), window).collect()}
    assert all(both[k][0] == apart[k][0] and (both[k][1] is None or both[k][1] <= 0 or max(both[k][1], 1.0) == apart[k][1]) for k in both)


def test_short_days_have_no_events(spark):
    flagged = detect.prepared(series.rebin(curve(spark, range(0, 200, 10), [1.0] * 10 + [900.0] * 10), 10.0), Config()).withColumn("above", F.col("flux") > 10)
    assert detect.events(flagged, Config()).count() == 0
    small = Config(bg_window=10, bg_least=2)
    assert detect.events(flagged, small).count() == 1


def test_left_interval_join_keeps_lone_intervals_once(spark):
    spots = spark.createDataFrame([("d", 1, 0.0, 10.0), ("d", 2, 100.0, 110.0), ("d", 3, 5.0, 20.0)], "date string, no int, a double, b double").repartition(3)
    samples = spark.createDataFrame([("d", 1.0), ("d", 7.0), ("d", 15.0)], "date string, t double").repartition(3)
    out = intervals.interval_join(spots, samples, F.col("a"), F.col("b"), 4.0, ids=("date", "no"), how="left")
    assert sorted((r.no, r.t) for r in out.collect() if r.t is not None) == [(1, 1.0), (1, 7.0), (3, 7.0), (3, 15.0)]
    assert [r.no for r in out.where("t is null").collect()] == [2]


def test_repeated_times_have_no_slope(spark):
    rows = spark.createDataFrame([("d", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 1), (1, 2), (1, 4), (2, 5)])], "date string, k long, x double, y double")
    assert [r.g for r in rows.select("k", series.gradient("y", "x").alias("g")).orderBy("k").collect()] == [1.0, None, None, 1.0]


def test_folds_need_training_positives(spark):
    rows = spark.createDataFrame([("a", 0.0, 0), ("b", 1e6, 1), ("c", 2e6, 0), ("d", 3e6, 1)], "date string, t double, y int")
    assert [(r.fold, r.test_date) for r in skill.walk_forward(rows, 9, 60.0).orderBy("fold").collect()] == [(1, "d"), (2, "c")]


def test_significance(spark):
    from helioflux.operators import features

    rows = [("x", 1, 5.0, 1.0), ("x", 2, 5.0, 9.0), ("x", 3, 1.0, 5.0), ("y", 4, 5.0, 9.0), ("y", 5, 9.0, None)]
    out = features.significant(spark.createDataFrame(rows, "date string, no int, ratio double, energy_jm2 double"), Config())
    assert sorted(r.no for r in out.collect()) == [2, 5]


def test_moments(spark):
    from helioflux.operators import replay

    row = one(spark, a=replay.moment("20240115", "14:30"), b=replay.moment("20240115", "18:334"), c=replay.moment("20240115", "24:00"))
    assert (row.a, row.b, row.c) == (1705329000.0, None, None)


def test_catalog_has_its_columns(spark):
    from helioflux import catalog

    for mode in ("event_catalog_soft", "event_catalog_hard"):
        out = own.queries()[mode](spark, DATA)
        assert tuple(out.columns) == catalog.COLUMNS and len(catalog.COLUMNS) == 57


def test_contingency(spark):
    rows = spark.createDataFrame([(1, 0.9)] * 3 + [(1, 0.1)] + [(0, 0.9)] * 2 + [(0, 0.1)] * 4, "y int, prob double")
    out = skill.contingency(rows, 0.5).first()
    assert (out.pod, out.far, out.hss) == pytest.approx((0.75, 0.4, 0.4)) and out.tss == pytest.approx(0.416667, abs=1e-6)


def test_peaks():
    assert detect.peaks(np.array([0.0, 2, 2, 0, 3, 0])).tolist() == [1, 4]
    assert detect.peaks(np.array([0.0, 2, 0, 3, 0]), distance=3).tolist() == [3]
    assert detect.peaks(np.array([0.0, 2, 1.5, 3, 0]), prominence=1).tolist() == [3]


CASES = ["mad_noise_sigma", "band_powerlaw", "neupert_corr", "soft_flux_events", "band_peak_flux", "band_vote", "decay_exclusion", "hawkes_history", "window_gamma", "best_thresholds", "replay_scorecard", "next_significant", "rebin_mean", "ema_fred", "event_catalog_sigma", "llr_multiwindow", "interval_join_stats", "asof_interp", "confidence_noisy_or", "roc_auc_exact", "walk_forward_folds"]


@pytest.mark.parametrize("name", CASES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = own.queries()[name](spark, DATA)
    sql = con.execute(own.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr(tuple(plain(r[c]) for c in names)) for r in got.collect()) == sorted(repr(tuple(plain(v) for v in r)) for r in sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
