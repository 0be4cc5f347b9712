"""Forecast windows: significant events, the grid of window ends, exclusion, labels and the 43 features.

A window is named by its end bin ``i`` of a day and covers bins [i - lookback, i). Only chosen ends become windows; each
then meets its own bins by an equi-join on (date, k) and one aggregation makes the features, so work grows with
windows times look-back, not with bins times look-back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..config import Config
from ..functions.scalar import correlation, scrub, squash
from ..tables import written
from .detect import peaks
from .intervals import decayed, interval_join
from .measure import window_gamma

#: Names of the features in order; fixed values
NAMES = (
    "flux_mean", "flux_max", "flux_end", "flux_trend_slope", "flux_std", "dflux_mean", "dflux_max", "dflux_pos_frac", "excess_above_bg", "max_sigma",
    "flux_bandA", "flux_bandB", "flux_bandC", "ratio_B_A", "ratio_C_total", "ratio_B_A_trend", "ratio_B_A_end", "spectral_slope",
    "n_micro_peaks", "recent_vs_early", "flux_skewness", "flux_start", "micro_energy",
    "helos_flux_mean", "helos_flux_max", "helos_trend_slope", "helos_std", "helos_dflux_max", "helos_max_sigma", "helos_recent_vs_early", "helos_n_micro_peaks", "helos_precursor",
    "helos_to_solexs_ratio", "helos_lead_signal", "cross_corr", "hard_soft_trend_diff",
    "time_since_last_flare_min", "decayed_flare_history", "data_gap_frac", "temp_trend_MK_per_min", "gamma_window", "gamma_trend", "precursor_concentration",
)


def significant(events: DataFrame, config: Config) -> DataFrame:
    """events (date, ratio, energy_jm2, ..) that pass the ratio, or whose energy is in its day's top 30 % and ratio near it.

    The energy counts only on days with at least three energies.
    """
    own = Window.partitionBy("date")
    cut = F.percentile("energy_jm2", 0.7).over(own)
    by_energy = (F.count("energy_jm2").over(own) >= 3) & (F.col("energy_jm2") >= cut) & (F.col("ratio") >= config.energy_ratio)
    out = events.withColumn("_ok", (F.col("ratio") >= config.sig_ratio) | F.coalesce(by_energy, F.lit(False)))
    return out.where("_ok").drop("_ok")


def bins(config: Config) -> tuple[int, int, int, int]:
    """Bins of look-back, lead, step and the dense step."""
    of = lambda minutes: int(minutes * 60 / config.bin_s)
    return of(config.lookback_min), of(config.lead_min), max(of(config.step_min), 1), max(of(config.dense_min), 1)


def grid(series: DataFrame, sig: DataFrame, config: Config) -> DataFrame:
    """(date, i, t, dense): each step a window end, and before significant starts one each dense step; dense 1 only off the steps.

    series: (date, k, bt) without missing bins. Days of fewer than ten bins have none.
    """
    lookback, _, step, fine = bins(config)
    days = series.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.min("bt").alias("t0")).where("n >= 10")
    last = F.col("n") - 2  # the last bin is no end
    plain = days.where(last >= lookback).select("date", F.explode(F.sequence(F.lit(lookback).cast("long"), last, F.lit(step).cast("long"))).alias("i"), F.lit(0).alias("dense"))
    at = lambda t: F.ceil((t - F.col("t0")) / config.bin_s - 1e-9)
    met = sig.select("date", "start").join(days, "date")
    first, stop = F.greatest(at(F.col("start") - config.lead_min * 60), F.lit(lookback)), F.least(at(F.col("start")), F.col("n") - 1)
    more = met.withColumns({"_a": first, "_b": stop - 1}).where("_b >= _a")
    more = more.select("date", F.explode(F.sequence(F.col("_a"), F.col("_b"), F.lit(fine).cast("long"))).alias("i"), F.lit(1).alias("dense"))
    ends = plain.unionByName(more).groupBy("date", "i").agg(F.min("dense").alias("dense"))
    return ends.join(series.select("date", F.col("k").alias("i"), F.col("bt").alias("t")), ["date", "i"])


def in_decay(ends: DataFrame, series: DataFrame, sig: DataFrame, config: Config) -> DataFrame:
    """Ends (date, i, t, ..) that lie in the decay of a significant event: close after its end, or later while flux is high.

    series: (date, k, norm), flux over background at the end bin itself.
    """
    now = ends.join(series.select("date", F.col("k").alias("i"), F.col("norm").alias("_norm")), ["date", "i"])
    after = sig.select("date", F.col("end").alias("_end"))
    met = interval_join(after, now, F.col("_end"), F.col("_end") + config.decay_min * 60, 7200.0)
    inside = (F.col("t") - F.col("_end") <= config.decay_floor_min * 60) | (F.col("_norm") >= config.decay_flux)
    return ends.join(met.where(inside).select("date", "i").distinct(), ["date", "i"], "left_semi")


def labelled(ends: DataFrame, sig: DataFrame, config: Config) -> DataFrame:
    """ends with label and flare_start: the first significant start in (t, t + lead]."""
    lead = config.lead_min * 60
    hit = interval_join(sig.select("date", F.col("start").alias("_start")), ends.select("date", "i", "t"), F.col("_start") - lead, F.col("_start"), 7200.0)
    first = hit.where("t < _start").groupBy("date", "i").agg(F.min("_start").alias("flare_start"))
    return ends.join(first, ["date", "i"], "left").withColumn("label", F.col("flare_start").isNotNull().cast("int"))


def peaks_of(y: np.ndarray) -> tuple[int, float]:
    """Number of peaks by prominence of half the deviation, and their mean height; none in fewer than five values."""
    at = peaks(y, prominence=max(float(y.std()), 1e-6) * 0.5) if len(y) >= 5 else np.zeros(0, np.int64)
    return len(at), float(y[at].mean()) if len(at) else 0.0


@F.pandas_udf(StructType([StructField("n", IntegerType()), StructField("height", DoubleType())]))
def micro_peaks(values: pd.Series) -> pd.DataFrame:
    """``peaks_of`` arrays; nulls in them read as 0."""
    whole = lambda x: np.nan_to_num(np.array([np.nan if v is None else v for v in x], dtype=float)) if x is not None else np.zeros(0)
    return pd.DataFrame([peaks_of(whole(x)) for x in values], columns=["n", "height"])


def history(ends: DataFrame, sig: DataFrame, config: Config) -> DataFrame:
    """ends with time_since_last_flare_min (capped, also without one) and decayed_flare_history over significant events ended by t."""
    out = decayed(ends, sig.select("date", "end"), config.history_tau_s).withColumnRenamed("history", "decayed_flare_history")
    both = out.select("date", "i", "t", F.lit(None).cast("double").alias("_end")).unionByName(sig.select("date", F.lit(None).cast("long").alias("i"), F.col("end").alias("t"), F.col("end").alias("_end")))
    w = Window.partitionBy("date").orderBy("t", F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last("_end", True).over(w)).where("i is not null").select("date", "i", "_last")
    since = F.least(F.coalesce((F.col("t") - F.col("_last")) / 60, F.lit(config.time_cap_min)), F.lit(config.time_cap_min))
    return out.join(last, ["date", "i"]).withColumn("time_since_last_flare_min", since).drop("_last")


def features(ends: DataFrame, series: DataFrame, config: Config, bands: DataFrame | None = None, hard: DataFrame | None = None) -> DataFrame:
    """(date, i) with the features of the window's own bins.

    series: (date, k, norm, cnt); bands: (date, k, a, b, c) on the same grid, over the background; hard: (date, k, h),
    null where the instrument didn't look. Without bands or hard their features are 0, as are all that come out as NaN
    or infinite. A window of fewer than three bins has zeros only.
    """
    lookback = bins(config)[0]
    none = F.lit(None).cast("double")
    rows = series.select("date", "k", F.col("norm").alias("f"), "cnt")
    rows = rows.join(bands.select("date", "k", "a", "b", "c"), ["date", "k"], "left") if bands is not None else rows.withColumns({"a": none, "b": none, "c": none})
    rows = rows.join(hard.select("date", "k", "h"), ["date", "k"], "left") if hard is not None else rows.withColumn("h", none)
    step = Window.partitionBy("date").orderBy("k")
    rows = rows.withColumns({"df": F.col("f") - F.lag("f").over(step), "dh": F.col("h") - F.lag("h").over(step), "r": F.when(F.col("a").isNotNull(), F.col("b") / F.greatest(F.col("a"), F.lit(1e-6)))})
    asked = ends.select("date", "i", F.explode(F.sequence(F.greatest(F.col("i") - lookback, F.lit(0)), F.col("i") - 1)).alias("k"))
    met = asked.join(rows, ["date", "k"]).withColumn("j", F.col("k") - F.col("i") + lookback)
    tenth = max(lookback // 10, 1)
    early, late, inner = F.col("j") < tenth, F.col("j") >= lookback - tenth, F.col("j") >= 1
    x = F.col("j").cast("double")
    at = lambda c, name: F.when(c, F.col(name))
    slope = lambda name: F.coalesce(F.regr_slope(F.col(name), x), F.lit(0.0))
    own = met.groupBy("date", "i").agg(
        F.count("f").alias("_n"), F.count("h").alias("_nh"), F.count("a").alias("_na"),
        F.avg("f").alias("flux_mean"), F.max("f").alias("flux_max"), F.avg(at(late, "f")).alias("flux_end"), slope("f").alias("flux_trend_slope"), F.stddev_pop("f").alias("flux_std"),
        F.avg(at(inner, "df")).alias("dflux_mean"), F.max(at(inner, "df")).alias("dflux_max"), F.avg(F.when(inner, (F.col("df") > 0).cast("double"))).alias("dflux_pos_frac"),
        F.avg("a").alias("flux_bandA"), F.avg("b").alias("flux_bandB"), F.avg("c").alias("flux_bandC"), slope("r").alias("ratio_B_A_trend"), F.avg(at(late, "r")).alias("ratio_B_A_end"),
        F.avg(at(early, "f")).alias("flux_start"), F.skewness("f").alias("_skew"),
        F.avg("h").alias("helos_flux_mean"), F.max("h").alias("helos_flux_max"), slope("h").alias("helos_trend_slope"), F.stddev_pop("h").alias("helos_std"), F.max(at(inner, "dh")).alias("helos_dflux_max"),
        F.avg(at(late, "h")).alias("_h1"), F.avg(at(early, "h")).alias("_h0"), F.max(at(early, "h")).alias("helos_lead_signal"), correlation("f", "h").alias("_corr"), F.stddev_pop("f").alias("_sf"),
        F.avg((F.col("cnt") > 0).cast("double")).alias("_seen"), F.array_sort(F.collect_list(F.struct("j", "f", "h"))).alias("_rows"),
    )
    own = own.withColumns({"_pf": micro_peaks(F.transform("_rows", lambda r: r["f"])), "_ph": micro_peaks(F.transform("_rows", lambda r: r["h"]))})
    c, n = F.col, F.col("_n")
    some = lambda v: F.greatest(v, F.lit(1e-6))
    hard_seen, banded = c("_nh") > 0, c("_na") > 0
    made = {
        "excess_above_bg": c("flux_max") - 1,
        "max_sigma": c("flux_max"),
        "ratio_B_A": F.when(banded, c("flux_bandB") / some(c("flux_bandA"))),
        "ratio_C_total": F.when(banded, c("flux_bandC") / some(c("flux_bandA") + c("flux_bandB") + c("flux_bandC"))),
        "spectral_slope": F.when(banded, F.log10(some(c("flux_bandC"))) / some(F.log10(some(c("flux_bandA"))))),
        "n_micro_peaks": c("_pf.n").cast("double"),
        "recent_vs_early": c("flux_end") / some(c("flux_start")),
        "flux_skewness": c("_skew") * F.sqrt(n * (n - 1)) / (n - 2),
        "micro_energy": c("_pf.height"),
        "helos_max_sigma": c("helos_flux_max"),
        "helos_recent_vs_early": F.when(c("_h0").isNotNull(), c("_h1") / some(c("_h0"))),
        "helos_n_micro_peaks": F.when(hard_seen, c("_ph.n").cast("double")),
        "helos_precursor": F.when(hard_seen & (c("helos_trend_slope") > 0) & (c("flux_trend_slope") <= 0), 1.0).otherwise(0.0),
        "helos_to_solexs_ratio": c("helos_flux_mean") / some(c("flux_mean")),
        "cross_corr": F.when((c("_nh") == n) & (c("_sf") > 0) & (c("helos_std") > 0), c("_corr")),
        "hard_soft_trend_diff": F.when(hard_seen, c("helos_trend_slope") - c("flux_trend_slope")),
        "data_gap_frac": 1 - c("_seen"),
    }
    out = own.withColumns(made)
    measured = [x for x in NAMES if x in out.columns]
    return out.select("date", "i", *[F.when(n >= 3, scrub(F.col(x).cast("double"))).otherwise(0.0).alias(x) for x in measured])


def temperature_trend(ends: DataFrame, curve: DataFrame, config: Config) -> DataFrame:
    """(date, i, temp_trend_MK_per_min): the slope of t_mk over minutes in each window, of at least three spectra."""
    own = ends.select("date", "i", (F.col("t") - config.lookback_min * 60).alias("_from"), F.col("t").alias("_to"))
    hit = interval_join(own, curve.select("date", "t", "t_mk"), F.col("_from"), F.col("_to"), 3600.0)
    x = (F.col("t") - F.col("_from")) / 60
    return hit.groupBy("date", "i").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col("t_mk"), x).alias("s")).where("n >= 3").select("date", "i", F.col("s").alias("temp_trend_MK_per_min"))


def gammas(ends: DataFrame, bands: DataFrame, config: Config) -> DataFrame:
    """(date, i, gamma_window, gamma_trend): the index over the window, and that of its late half less its early half's; 0 if unknown."""
    span = config.lookback_min * 60.0
    whole, middle = F.col("t") - span, F.col("t") - span / 2
    part = lambda a, b, name: window_gamma(ends, bands, ("date", "i"), a, b).withColumnRenamed("gamma", name)
    out = part(whole, F.col("t"), "gamma_window").join(part(whole, middle, "_early"), ["date", "i"], "left").join(part(middle, F.col("t"), "_late"), ["date", "i"], "left")
    return out.select("date", "i", "gamma_window", F.coalesce(F.col("_late") - F.col("_early"), F.lit(0.0)).alias("gamma_trend"))


def precursor(rows: DataFrame) -> DataFrame:
    """rows with precursor_concentration: a product of five squashed signals, large only if all are."""
    c = F.col
    product = squash(c("excess_above_bg"), 8.0, 3.0) * squash(c("max_sigma"), 3.0, 1.5) * squash(c("n_micro_peaks"), 3.0, 2.0) * squash(-c("gamma_trend"), 0.3, 0.3) * squash(c("temp_trend_MK_per_min"), 0.05, 0.05)
    return rows.withColumn("precursor_concentration", product)


def windows(series: DataFrame, events: DataFrame, config: Config, bands: DataFrame | None = None, hard: DataFrame | None = None, band_curves: DataFrame | None = None, temperatures: DataFrame | None = None) -> DataFrame:
    """(date, window_end_unix, window_end_h, label, flare_start, dense, the 43 features) of all windows.

    series: (date, k, bt, norm, cnt); events: (date, start, end, ratio, energy_jm2). Windows in the decay of a significant
    event, or with samples in fewer than config.rows_seen of their bins, are left out.
    """
    sig = written(significant(events, config), "significant")
    ends = grid(series, sig, config)
    # Every part below reads the ends, which are few: they are written once.
    ends = written(ends.join(in_decay(ends, series, sig, config).select("date", "i"), ["date", "i"], "left_anti"), "ends")
    out = features(ends, series, config, bands, hard).where(F.col("data_gap_frac") <= 1 - config.rows_seen + 1e-9)
    out = history(labelled(ends, sig, config), sig, config).join(out, ["date", "i"])
    for found, names in ((temperature_trend(ends, temperatures, config) if temperatures is not None else None, ["temp_trend_MK_per_min"]), (gammas(ends, band_curves, config) if band_curves is not None else None, ["gamma_window", "gamma_trend"])):
        out = out.join(found, ["date", "i"], "left") if found is not None else out.withColumns({n: F.lit(0.0) for n in names})
        out = out.withColumns({n: scrub(F.col(n)) for n in names})
    start = series.groupBy("date").agg(F.min("bt").alias("_t0"))
    out = precursor(out).join(start, "date")
    return out.select("date", F.col("t").alias("window_end_unix"), ((F.col("t") - F.col("_t0")) / 3600).alias("window_end_h"), "label", "flare_start", "dense", *NAMES)


def balance(rows: DataFrame, events: DataFrame | None = None, high: float = 8.0) -> DataFrame:
    """(date, windows, positive) of windows, and with events (date, ratio, ..) also high_events, those of ratio ``high`` or more."""
    out = rows.groupBy("date").agg(F.count(F.lit(1)).alias("windows"), F.sum("label").cast("long").alias("positive"))
    if events is None:
        return out
    by = events.groupBy("date").agg(F.count_if(F.col("ratio") >= high).alias("high_events"))
    return out.join(by, "date", "left").withColumn("high_events", F.coalesce("high_events", F.lit(0).cast("long")))
