"""Array functions against numpy and the peak finder that walks an array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioflux.operators import arrays, timing
from helioflux.operators.detect import peaks

RNG = np.random.default_rng(11)
CURVES = [RNG.poisson(30, n).astype(float) for n in (1, 2, 3, 11, 12, 13, 40, 97, 256)] + [RNG.integers(0, 3, 60).astype(float) for _ in range(20)] + [np.full(20, 7.0), np.arange(15.0), np.zeros(0)]


def test_spectrum_and_peaks(spark):
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(CURVES)], "i int, y array<double>")
    at = arrays.peak_places(F.col("y"))
    got = rows.select("i", F.when(F.size("y") > 0, arrays.dft_power(F.col("y"))).alias("p"), at.alias("a"), arrays.spaced(at, F.col("y"), 3).alias("s"), arrays.deviation(F.col("y")).alias("d")).collect()
    for r in got:
        x = CURVES[r.i]
        assert r.a == peaks(x).tolist() and r.s == peaks(x, distance=3).tolist()
        if len(x):
            assert r.p == pytest.approx((np.abs(np.fft.rfft(x)) ** 2).tolist(), rel=1e-9, abs=1e-7) and r.d == pytest.approx(x.std())


def test_pulsations(spark):
    t = np.arange(60)
    wave = 100 + 20 * np.sin(2 * np.pi * t / 6)
    nan = wave.copy()
    nan[4] = np.nan
    curves = {1: wave.tolist(), 2: np.full(60, 5.0).tolist(), 3: wave[:11].tolist(), 4: nan.tolist(), 5: [None, *wave.tolist()], 6: None, 7: RNG.poisson(50, 60).astype(float).tolist(), 8: []}
    events = spark.createDataFrame([("d", i, x, 0.0) for i, x in curves.items()], "date string, event_no int, flux array<double>, power double")
    got = {r.event_no: r for r in timing.pulsations(events, 10.0).collect()}
    assert got[1].period == pytest.approx(60.0) and got[1].n_peaks == 10 and len(got[1].power) == len(got[1].frequency) == 31
    assert got[1].frequency[10] == pytest.approx(1 / 60) and got[1].strength == max(got[1].power)
    trend = np.convolve(wave, np.ones(5), "valid") / 5
    assert got[1].trend[2:-2] == pytest.approx(trend.tolist()) and got[1].trend[0] == pytest.approx(wave[:3].mean())
    # Constant, short, with a bin missing, empty: nothing is known.
    assert all(got[i][2:] == (None,) * 7 for i in (2, 3, 4, 5, 6, 8))
    assert got[7].n_peaks > 5 and got[7].strength > 0
    assert timing.pulsations(events.limit(0), 10.0).isEmpty()
