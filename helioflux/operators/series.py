"""Binned series: rebinning, rolling robust statistics, filters and derivatives.

Series are keyed by ``date``, so a day's rows meet in one task and days spread over the cluster; all
operators of one chain share that partitioning, and Spark inserts one exchange for them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def light_curve(events: DataFrame) -> DataFrame:
    """(date, kind, who, t, counts) from an event stream with ts and value."""
    ts = F.col("ts").cast("timestamp")
    return events.select(F.date_format(ts, "yyyyMMdd").alias("date"), F.col("event_type").alias("kind"), F.col("user_id").alias("who"), (F.unix_micros(ts) / 1e6).alias("t"), F.col("value").cast("double").alias("counts"))


def day() -> WindowSpec:
    return Window.partitionBy("date").orderBy("k")


def spans(curve: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, t0, t1): first and last sample; one row a day and instrument, so it is small beside any curve."""
    return curve.groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))


def rebin(curve: DataFrame, bin_s: float, keys: tuple[str, ...] = ("date",), gap: str = "zero") -> DataFrame:
    """Mean per bin on a grid from each key's first sample. (keys, k, bt, flux, cnt)

    Empty bins have cnt 0 and a flux of 0, or null with ``gap`` "null". Samples are combined before the shuffle.
    """
    ends = spans(curve, keys)
    placed = curve.join(F.broadcast(ends.select(*keys, "t0")), list(keys)).withColumn("k", F.floor((F.col("t") - F.col("t0")) / bin_s))
    means = placed.groupBy(*keys, "k").agg(F.avg("counts").alias("flux"), F.count(F.lit(1)).alias("cnt"))
    grid = ends.select(*keys, "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / bin_s))).alias("k"))
    flux = F.coalesce("flux", F.lit(0.0)) if gap == "zero" else F.col("flux")
    return grid.join(means, [*keys, "k"], "left").select(*keys, "k", (F.col("t0") + F.col("k") * bin_s).alias("bt"), flux.alias("flux"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def rebin_sum(curve: DataFrame, bin_s: float, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Sum per bin at the bin's centre; empty bins are left out. (keys, k, bt, total)"""
    placed = curve.join(F.broadcast(spans(curve, keys).select(*keys, "t0")), list(keys)).withColumn("k", F.floor((F.col("t") - F.col("t0")) / bin_s))
    return placed.groupBy(*keys, "k", "t0").agg(F.sum("counts").alias("total")).select(*keys, "k", (F.col("t0") + (F.col("k") + 0.5) * bin_s).alias("bt"), "total")


def rebin_vectors(spectra: DataFrame, grid: DataFrame, bin_s: float, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Spectra (keys, t, counts array) summed by channel onto a grid (keys, k, bt): (keys, k, counts, cnt).

    Channels are long rows only between the two halves of the aggregation.
    """
    starts = grid.groupBy(*keys).agg(F.min("bt").alias("t0"), F.max("k").alias("top"))
    placed = spectra.join(F.broadcast(starts), list(keys)).withColumn("k", F.floor((F.col("t") - F.col("t0")) / bin_s)).where("k between 0 and top")
    rows = placed.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("cnt"))
    cells = placed.select(*keys, "k", F.posexplode("counts").alias("ch", "n")).groupBy(*keys, "k", "ch").agg(F.sum("n").alias("n"))
    vectors = cells.groupBy(*keys, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "n"))), lambda x: x["n"]).alias("counts"))
    return vectors.join(rows, [*keys, "k"])


def rolling(x: np.ndarray, p: float, rows: int, least: int) -> np.ndarray:
    """Interpolated percentile over centred frames of a day's values, NaN where fewer than ``least`` are there.

    An even frame has one value more before than after. The frame is kept sorted as it slides, so a value costs its logarithm, not a sort of the frame.
    """
    return pd.Series(x).rolling(rows, center=True, min_periods=min(least, rows)).quantile(p).to_numpy() if rows > 1 else np.array(x, dtype=float)


def ordered(series: DataFrame, kernel: Callable[[pd.DataFrame], dict[str, np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """series with columns ``names`` (doubles, NaN as null) that the kernel makes of each day's rows in order of k.

    One pass over a day's rows, which are bounded; all columns go along, and days share the other windows' exchange.
    """
    kept = [c for c in series.columns if c not in names]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        return frame.assign(**kernel(frame))[[*kept, *names]]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in kept), *(f"`{n}` double" for n in names)])
    out = series.groupBy("date").applyInPandas(run, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def _filled(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).ffill().bfill().to_numpy()


def _unsteady(flux: np.ndarray, bg: np.ndarray, rows: int) -> np.ndarray:
    """Rolling median of the absolute steps of flux above background, as a standard deviation."""
    excess = flux - bg
    return rolling(np.abs(np.diff(excess, prepend=excess[:1])), 0.5, rows, 1) * (1.4826 / 2**0.5)


def filled(x: str) -> Column:
    """Forward fill, then back fill."""
    back = F.last(x, True).over(day().rowsBetween(Window.unboundedPreceding, 0))
    # In reversed order, as a frame to the last row is read again for each row.
    ahead = F.last(x, True).over(Window.partitionBy("date").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(back, ahead)


def background(series: DataFrame, rows: int, least: int, p: float = 0.1, name: str = "bg") -> DataFrame:
    """Rolling percentile, filled at the ends."""
    return ordered(series, lambda day: {name: _filled(rolling(day["flux"].to_numpy(float), p, rows, least))}, (name,))


def robust(series: DataFrame, rows: int, least: int) -> DataFrame:
    """series with bg, the rolling tenth percentile, med, the rolling median, and _m, the unsteadiness that ``noise`` needs, in one pass."""

    def kernel(day: pd.DataFrame) -> dict[str, np.ndarray]:
        flux = day["flux"].to_numpy(float)
        bg, med = (_filled(rolling(flux, p, rows, least)) for p in (0.1, 0.5))
        return {"bg": bg, "med": med, "_m": _unsteady(flux, bg, rows)}

    return ordered(series, kernel, ("bg", "med", "_m"))


def floored(series: DataFrame, share: float, least: float, name: str = "bg_safe") -> DataFrame:
    """bg raised to at least share of its day's median positive value, and to least."""
    middle = F.percentile(F.when(F.col("bg") > 0, F.col("bg")), 0.5).over(Window.partitionBy("date"))
    floor = F.greatest(F.coalesce(share * middle, F.lit(least)), F.lit(least))
    return series.withColumn("floor", floor).withColumn(name, F.greatest("bg", "floor"))


def noise(series: DataFrame, rows: int) -> DataFrame:
    """Median absolute first difference of flux above background, scaled to a standard deviation; at least 1.

    Where it isn't positive the day's median of positive ones stands in, or 1. ``robust`` has the rolling median already.
    """
    out = series if "_m" in series.columns else ordered(series, lambda day: {"_m": _unsteady(day["flux"].to_numpy(float), day["bg"].to_numpy(float), rows)}, ("_m",))
    middle = F.percentile(F.when(F.col("_m") > 0, F.col("_m")), 0.5).over(Window.partitionBy("date"))
    return out.withColumn("noise", F.greatest(F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.coalesce(middle, F.lit(1.0))), F.lit(1.0))).drop("_m")


def forecast_background(series: DataFrame, rows: int, least: int) -> DataFrame:
    """bg: rolling tenth percentile, at least a hundredth of the day's median positive flux and 1e-6."""
    out = background(series, rows, least)
    middle = F.percentile(F.when(F.col("flux") > 0, F.col("flux")), 0.5).over(Window.partitionBy("date"))
    return out.withColumn("bg", F.greatest("bg", F.coalesce(0.01 * middle, F.lit(1e-6)), F.lit(1e-6)))


def averaged(x: np.ndarray, weight: float) -> np.ndarray:
    """Exponential average with this weight on the past, seeded with the first value."""
    out, held = np.empty(len(x)), float(x[0]) if len(x) else 0.0
    for i, value in enumerate(x.tolist()):
        held = weight * held + (1 - weight) * value if i else value
        out[i] = held
    return out


def fred(series: DataFrame, fast: float = 0.5, slow: float = 0.9) -> DataFrame:
    """(date, k, fred): slow minus fast exponential average, both seeded with the first value.

    The recursion runs over each day's bins in order, one pass.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        x = frame["flux"].to_numpy()
        return pd.DataFrame({"date": frame["date"], "k": frame["k"], "fred": averaged(x, slow) - averaged(x, fast)})

    return series.select("date", "k", "flux").groupBy("date").applyInPandas(run, "date string, k long, fred double")


def gradient(y: str, x: str, keys: tuple[str, ...] = ("date",), order: str = "k") -> Column:
    """Second-order derivative on uneven steps, one-sided at the ends; null where two times are equal."""
    w = Window.partitionBy(*keys).orderBy(order)
    hs, hd = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    up, down = F.lead(y).over(w), F.lag(y).over(w)
    over = lambda a, b: F.when(b != 0, a / b)
    inner = over(hs * hs * up + (hd * hd - hs * hs) * F.col(y) - hd * hd * down, hs * hd * (hd + hs))
    return F.when(hs.isNull(), over(up - F.col(y), hd)).when(hd.isNull(), over(F.col(y) - down, hs)).otherwise(inner)


def moving_average(x: str, reach: int = 2) -> Column:
    return F.avg(x).over(day().rowsBetween(-reach, reach))
