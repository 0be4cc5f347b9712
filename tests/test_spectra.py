import math

import numpy as np
from pyspark.sql import functions as F

from helioflux.operators import spectra


def test_isothermal_finds_the_temperature(spark):
    e = np.linspace(3, 12, 30)
    model = np.exp(-e / 1.2) / (e * math.sqrt(1.2)) * 2.0 * 0.3
    counts = np.round(model / model.sum() * 20000)
    rows = [(1, float(x), float(c), 2.0, 0.3) for x, c in zip(e, counts)] + [(2, 5.0, 100.0, 2.0, 0.3)]
    got = spectra.isothermal(spark.createDataFrame(rows, "ev int, e double, counts double, area double, width double"), ("ev",)).collect()
    grid = np.geomspace(0.08, 5.0, 160)

    def cash(kt):
        s = np.exp(-e / kt) / (e * math.sqrt(kt)) * 0.6
        m = np.maximum(counts.sum() / s.sum() * s, 1e-30)
        return 2 * float((m - counts + np.where(counts > 0, counts * np.log(np.maximum(counts, 1) / m), 0)).sum())

    all_ = [cash(k) for k in grid]
    best = int(np.argmin(all_))
    assert len(got) == 1 and got[0].n_chan == 30
    assert abs(got[0].t_mk - grid[best] * spectra.MK_PER_KEV) < 1e-6
    assert abs(got[0].cash_min - all_[best]) < 1e-4
    assert 0 < got[0].t_mk_err_lo < 1 and 0 < got[0].t_mk_err_hi < 1


def test_power_law(spark):
    rows = [(1, float(e), 100 * e**-3.0) for e in (20, 40, 80)] + [(2, 20.0, 1.0), (3, 20.0, 1.0), (3, 40.0, 2.0)]
    got = {r.ev: r for r in spectra.power_law(spark.createDataFrame(rows, "ev int, e double, rate double"), ("ev",)).collect()}
    assert abs(got[1].gamma - 3) < 1e-9 and abs(got[1].delta - 4) < 1e-9
    assert got[2].gamma is None and got[3].gamma is None


def test_lag_scan(spark):
    t = np.arange(0, 1200, 10.0)
    bump = np.exp(-(((t - 600) / 60) ** 2))
    late = np.exp(-(((t - 640) / 60) ** 2))
    make = lambda y: spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, y)], "ev int, t double, y double")
    got = spectra.lag_scan(make(late), make(bump), ("ev",), 100, 10).collect()
    assert len(got) == 1 and got[0].best_lag_s == 40 and got[0].corr_at_best > 0.999 > got[0].corr_zero


def test_tiers_agree(spark):
    rows = [(["C1.0", "M2.0"],), (["A1.0", "X1.0"],), (["C1.0"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "c array<string>").select(spectra.tiers_agree(F.col("c"))).collect()]
    assert got == [True, False, None]
