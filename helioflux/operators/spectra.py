"""Spectral fits of events and the lag between two of their curves, as aggregates by event.

Every grid is small and fixed: temperatures and lags are repeated by ``explode``, so the work is rows times a
constant and each event's rows combine before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import correlation
from .intervals import interpolated

MK_PER_KEV = 1 / 0.08617
KT_LOW, KT_HIGH, KT_STEPS = 0.08, 5.0, 160


def _kt(i: Column) -> Column:
    return F.lit(KT_LOW) * F.exp(i * (math.log(KT_HIGH / KT_LOW) / (KT_STEPS - 1)))


def isothermal(channels: DataFrame, keys: tuple[str, ...], least_channels: int = 10, least_counts: float = 50) -> DataFrame:
    """Temperature of the least Cash statistic over a geometric grid, with the interval of one unit above it.

    channels: (keys, e, counts, area, width), one row a channel, summed over the event. Per key: t_mk, t_mk_err_lo,
    t_mk_err_hi, cash_min, n_chan, n_counts. Keys with too few channels or counts, or whose best temperature is
    at an end of the grid, are left out.
    """
    good = channels.where("area > 0 and width > 0 and e > 0").withColumn("counts", F.greatest("counts", F.lit(0.0)))
    tried = good.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(KT_STEPS - 1)))).withColumn("kt", _kt(F.col("i")))
    shape = F.exp(-F.col("e") / F.col("kt")) / (F.col("e") * F.sqrt("kt")) * F.col("area") * F.col("width")
    floor = F.greatest(shape, F.lit(1e-300))
    # With norm K = N / S, the statistic is 2 * sum n ln(n / (K s)); the sums of model and counts are equal.
    sums = tried.withColumn("shape", shape).groupBy(*keys, "i").agg(
        F.first("kt").alias("kt"),
        F.sum("shape").alias("s"),
        F.sum("counts").alias("n_counts"),
        F.count(F.lit(1)).alias("n_chan"),
        F.sum(F.when(F.col("counts") > 0, F.col("counts") * F.ln(F.col("counts") / floor)).otherwise(0.0)).alias("part"),
    )
    sums = sums.where((F.col("n_chan") >= least_channels) & (F.col("n_counts") >= least_counts) & (F.col("s") > 0))
    cash = sums.withColumn("cash", 2 * (F.col("part") - F.col("n_counts") * F.ln(F.col("n_counts") / F.col("s"))))
    along = Window.partitionBy(*keys)
    top = F.min(F.struct("cash", "i", "kt")).over(along)
    near = cash.withColumn("top", top).withColumn("goal", F.col("top.cash") + 1)
    step = along.orderBy("i")
    near = near.withColumns({"cash_up": F.lead("cash").over(step), "kt_up": F.lead("kt").over(step), "cash_down": F.lag("cash").over(step), "kt_down": F.lag("kt").over(step)})

    def crossing(cash_at: str, kt_at: str) -> Column:
        part = (F.col("goal") - F.col("cash")) / F.greatest(F.col(cash_at) - F.col("cash"), F.lit(1e-12))
        return F.col("kt") + part * (F.col(kt_at) - F.col("kt"))

    left = F.when((F.col("i") <= F.col("top.i")) & (F.col("cash_down") >= F.col("goal")), F.struct("i", crossing("cash_down", "kt_down").alias("kt")))
    right = F.when((F.col("i") >= F.col("top.i")) & (F.col("cash_up") >= F.col("goal")), F.struct("i", crossing("cash_up", "kt_up").alias("kt")))
    best = near.groupBy(*keys).agg(F.first("top").alias("top"), F.max(left).alias("lo"), F.min(right).alias("hi"), F.first("n_chan").alias("n_chan"), F.first("n_counts").alias("n_counts"))
    best = best.where((F.col("top.i") > 0) & (F.col("top.i") < KT_STEPS - 1))
    kt = F.col("top.kt")
    low, high = F.coalesce("lo.kt", F.lit(KT_LOW)), F.coalesce("hi.kt", F.lit(KT_HIGH))
    return best.select(*keys, (kt * MK_PER_KEV).alias("t_mk"), ((kt - low) * MK_PER_KEV).alias("t_mk_err_lo"), ((high - kt) * MK_PER_KEV).alias("t_mk_err_hi"), F.col("top.cash").alias("cash_min"), "n_chan", "n_counts")


def power_law(bands: DataFrame, keys: tuple[str, ...], low: float = 1.0, high: float = 10.0) -> DataFrame:
    """Photon index gamma of rate per keV over energy, log against log, by least squares; delta is gamma + 1.

    bands: (keys, e, rate), one row a band; rates that aren't positive don't count. An index outside (low, high),
    or from fewer than two bands, is null; its error needs three.
    """
    x, y = F.log10("e"), F.log10("rate")
    fits = bands.where("rate > 0 and e > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (-F.regr_slope(y, x)).alias("g"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx"))
    fine = (F.col("n") >= 2) & (F.col("g") > low) & (F.col("g") < high)
    error = F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.0)) * F.col("syy") / F.col("sxx") / (F.col("n") - 2))
    return fits.select(*keys, "n", F.when(fine, F.col("g")).alias("gamma"), F.when(fine, F.col("g") + 1).alias("delta"), F.when(fine & (F.col("n") > 2) & (error > 0), error).alias("gamma_err"))


def lag_scan(soft: DataFrame, hard: DataFrame, keys: tuple[str, ...], reach: int = 300, step: int = 10) -> DataFrame:
    """(keys, best_lag_s, corr_at_best, corr_zero): the shift of hard that correlates best with the slope of soft.

    soft: (keys, t, y) with y the derivative; hard: (keys, t, y). A positive lag shifts hard later. The least lag
    wins among equals; constant curves and fewer than four soft samples give no row.
    """
    lags = F.explode(F.sequence(F.lit(-reach), F.lit(reach), F.lit(step))).alias("lag")
    own = (*keys, "lag")
    clock = soft.select(*keys, "t", F.col("y").alias("d"), lags)
    shifted = hard.select(*keys, "t", "y", lags).withColumn("t", F.col("t") + F.col("lag"))
    met = interpolated(clock, shifted, True, own).where("d is not null and y is not null")
    scores = met.groupBy(*own).agg(correlation("d", "y").alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 4 and r is not null")
    best = F.max(F.struct("r", (-F.col("lag")).alias("minus"))).alias("top")
    return scores.groupBy(*keys).agg(best, F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("corr_zero")).select(*keys, (-F.col("top.minus")).alias("best_lag_s"), F.col("top.r").alias("corr_at_best"), "corr_zero")


def tiers_agree(classes: Column) -> Column:
    """Whether the letters of an array of classes lie at most one step apart on A, B, C, M, X; null below two."""
    steps = F.filter(F.transform(classes, lambda c: F.instr(F.lit("ABCMX"), F.substring(c, 1, 1))), lambda i: i > 0)
    return F.when(F.size(steps) >= 2, F.array_max(steps) - F.array_min(steps) <= 1)
