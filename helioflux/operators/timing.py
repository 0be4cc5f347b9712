"""Timing of events: pulsations of one curve, and the soft curve's slope against the hard curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import correlation
from . import arrays
from .intervals import interpolated, interval_join
from .measure import IDS
from .series import gradient
from .spectra import lag_scan

def pulsations(events: DataFrame, bin_s: float, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, period, n_peaks, strength, trend, wiggle, frequency, power) of events with their bins' flux as an array.

    period is null unless there are three sub-peaks, the strongest frequency stands three deviations above the mean
    power and two cycles fit. Events of fewer than 12 bins, with a bin that is null or NaN, or without wiggles, have
    nulls only. All of it stays in the event's row.
    """
    c = F.col
    whole = (F.size("flux") >= 12) & ~F.exists("flux", lambda x: x.isNull() | F.isnan(x))
    out = events.select(*ids, F.when(whole, F.transform("flux", lambda x: x.cast("double"))).alias("_x")).withColumn("trend", arrays.centred(c("_x"), 2))
    out = out.withColumn("wiggle", F.zip_with("_x", "trend", lambda x, m: x - m))
    out = out.withColumn("wiggle", F.when(arrays.deviation(c("wiggle")) >= 1e-6, c("wiggle"))).withColumn("_even", arrays.bound(arrays.mean(c("wiggle")), lambda m: F.transform("wiggle", lambda w: w - m)))
    out = out.withColumn("power", F.transform(F.when(c("_even").isNotNull(), arrays.dft_power(c("_even"))), lambda p, k: F.when(k > 0, p).otherwise(0.0)))
    out = out.withColumns({"strength": F.array_max("power"), "n_peaks": F.when(c("wiggle").isNotNull(), F.size(arrays.spaced(arrays.peak_places(c("wiggle")), c("wiggle"), 3)))})
    span = F.size("wiggle") * bin_s
    out = out.withColumn("_period", F.try_divide(span, F.array_position("power", c("strength")) - 1))
    strong = c("strength") > arrays.mean(c("power")) + 3 * arrays.deviation(c("power"))
    period = F.when((c("n_peaks") >= 3) & strong & (span > 2 * c("_period")), c("_period"))
    frequency = F.transform("power", lambda _, k: k / span)
    some = lambda x: F.when(c("wiggle").isNotNull(), x)
    return out.select(*ids, some(period).alias("period"), "n_peaks", some(c("strength")).alias("strength"), some(c("trend")).alias("trend"), "wiggle", some(frequency).alias("frequency"), some(c("power")).alias("power"))


def slopes(events: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, t, y): the derivative of each event's own bins (bt and flux arrays), one-sided at the event's ends."""
    rows = events.select(*ids, F.posexplode(F.arrays_zip("bt", "flux")).alias("k", "z")).select(*ids, "k", F.col("z.bt").alias("t"), F.col("z.flux").alias("f"))
    return rows.select(*ids, "t", gradient("f", "t", ids).alias("y"))


def _hard(events: DataFrame, total: DataFrame, pad: float, ids: tuple[str, ...]) -> DataFrame:
    """Samples (ids, t, y) of the total band within pad seconds of events that have at least four of them."""
    near = interval_join(events.select(*ids, "start", "end"), total, F.col("start") - pad, F.col("end") + pad, 3600.0).select(*ids, "t", "y")
    enough = near.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select(*ids)
    return near.join(enough, list(ids))


def neupert(events: DataFrame, total: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, corr): the soft curve's slope against the hard curve (date, t, y) on the soft bins; null if either is constant."""
    hard = _hard(events, total, 0.0, ids)
    clock = slopes(events, ids).join(hard.select(*ids).distinct(), list(ids)).withColumnRenamed("y", "soft")
    both = interpolated(clock, hard, True, ids)
    # One side may lack values (a bin next to an equal time), so both count only where both are known.
    return both.where("soft is not null and y is not null").groupBy(*ids).agg(correlation("soft", "y").alias("corr"))


def neupert_lag(events: DataFrame, total: DataFrame, reach: int = 300, step: int = 10, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, best_lag_s, corr_at_best, corr_zero) over lags from -reach to reach; a positive lag: the hard curve leads."""
    return lag_scan(slopes(events, ids), _hard(events, total, float(reach), ids), ids, reach, step)
