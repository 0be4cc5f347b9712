"""Replay of scored windows as if live, and the forecast at one moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import horizon
from .intervals import interval_join


def moment(date: str, hhmm: str) -> Column:
    """Seconds of a moment given as yyyyMMdd and HH:MM; null where either isn't one."""
    fine = F.lit(hhmm).rlike("^([01]?[0-9]|2[0-3]):[0-5]?[0-9]$")
    day = F.unix_seconds(F.try_to_timestamp(F.lit(date), F.lit("yyyyMMdd")))
    parts = F.split(F.lit(hhmm), ":")
    return F.when(fine, day + F.try_element_at(parts, F.lit(1)).try_cast("int") * 3600 + F.try_element_at(parts, F.lit(2)).try_cast("int") * 60).cast("double")


def truncated(rows: DataFrame, cutoff: Column | float, t: str = "t") -> DataFrame:
    """Rows up to the cutoff: nothing after it exists for the forecast. Truncate raw samples, then bin and detect.

    Statistics with centred frames must be made from truncated samples too; cutting finished ones would leak.
    """
    return rows.where(F.col(t) <= cutoff)


def scorecard(rows: DataFrame, threshold: float, lead_s: float = 1800.0, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(keys, flares, caught, mean_lead_min, false_steps, alerts) from rows (keys, t, prob, y, flare_start).

    A flare is caught by an alarm at most lead_s before it; an alarm with no flare in the next lead_s is a false step.
    Flares meet the alarms of the time before them, by buckets, once for both questions.
    """
    alarm = F.col("prob") >= threshold
    flares = rows.where("y = 1").select(*keys, "flare_start").distinct()
    alarms = rows.where(alarm).select(*keys, "t")
    met = interval_join(flares, alarms, F.col("flare_start") - lead_s, F.col("flare_start").cast("double"), lead_s, keys)
    caught = met.where("t < flare_start").groupBy(*keys, "flare_start").agg(((F.first("flare_start") - F.min("t")) / 60).alias("lead"))
    by_flare = flares.join(caught, [*keys, "flare_start"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("flares"), F.count("lead").alias("caught"), F.avg("lead").alias("mean_lead_min"))
    good = met.select(*keys, "t").distinct()
    false = alarms.join(good, [*keys, "t"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("false_steps"))
    w = Window.partitionBy(*keys).orderBy("t")
    raised = rows.withColumn("_up", alarm & ~F.coalesce(F.lag(alarm).over(w), F.lit(False))).groupBy(*keys).agg(F.count_if("_up").alias("alerts"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return raised.join(by_flare, list(keys), "left").join(false, list(keys), "left").select(*keys, zero("flares"), zero("caught"), "mean_lead_min", zero("false_steps"), "alerts")


def next_significant(moments: DataFrame, starts: DataFrame, key: str = "date") -> DataFrame:
    """moments' rows (key, t, ..) with next_start, the first start (key, start) after t that day; null without one.

    One window over both tables in time order; a start at t itself isn't after it.
    """
    carried = [c for c in moments.columns if c not in (key, "t")]
    row = F.struct(*[F.col(c) for c in carried]) if carried else F.struct(F.lit(0).alias("_0"))
    asked = moments.select(key, F.col("t").cast("double").alias("t"), F.lit(1).alias("_asks"), F.lit(None).cast("double").alias("_start"), row.alias("_row"))
    both = asked.unionByName(starts.select(key, F.col("start").cast("double").alias("t"), F.lit(0).alias("_asks"), F.col("start").cast("double").alias("_start"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")))
    # Latest first, so the frame grows by a row each; starts at the very time follow a moment, so those before it are later.
    ahead = Window.partitionBy(key).orderBy(F.desc("t"), F.desc("_asks")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("next_start", F.last("_start", True).over(ahead)).where("_asks = 1").select(key, "t", *[F.col("_row")[c].alias(c) for c in carried], "next_start")


def minor(events: DataFrame, starts: DataFrame, near_s: float = 60.0, key: str = "date") -> DataFrame:
    """Events (key, start, ..) that start no nearer than near_s to any significant start (key, start)."""
    other = starts.select(F.col(key).alias("_key"), F.col("start").alias("_start"))
    return events.join(other, (F.col(key) == F.col("_key")) & (F.abs(F.col("start") - F.col("_start")) < near_s), "left_anti")


def ongoing(norm_now: Column, last_start: Column, high: float = 2.0) -> Column:
    """Whether an event is in progress: one has started and flux still is at least ``high`` times the background."""
    return last_start.isNotNull() & (norm_now >= high)


def spread(rows: DataFrame, prob: str = "prob") -> DataFrame:
    """rows with minutes (5 to 30 by 5) and p, the chance within so many minutes if risk is even over the half hour."""
    out = rows.withColumn("minutes", F.explode(F.sequence(F.lit(5).cast("long"), F.lit(30).cast("long"), F.lit(5).cast("long"))))
    return out.withColumn("p", horizon(F.col(prob), F.col("minutes")))


def at_moment(windows: DataFrame, events: DataFrame, starts: DataFrame, cutoff: float, threshold: float, lead_s: float = 1800.0) -> DataFrame:
    """One row a date: the last scored window up to the cutoff, whether it alarms, and what came next.

    windows: (date, window_end_unix, prob) made of data up to the cutoff; events and starts may know the future: they
    only fill next_start, came_true and minor_flares.
    """
    last = windows.where(F.col("window_end_unix") <= cutoff).groupBy("date").agg(F.max_by("prob", "window_end_unix").alias("prob"), F.max("window_end_unix").alias("t"))
    out = last.withColumn("alarm", F.col("prob") >= threshold)
    ahead = starts.where(F.col("start") > cutoff).groupBy("date").agg(F.min("start").alias("next_start"))
    small = minor(events.where(F.col("start").between(cutoff + 1e-6, cutoff + lead_s)), starts).groupBy("date").agg(F.count(F.lit(1)).alias("minor_flares"))
    out = out.join(ahead, "date", "left").join(small, "date", "left")
    soon = F.coalesce(F.col("next_start") <= cutoff + lead_s, F.lit(False))
    return out.withColumns({"came_true": soon == F.col("alarm"), "minor_flares": F.coalesce("minor_flares", F.lit(0).cast("long"))})
