"""Gaps and islands, interval joins and as-of interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, above: str, least: int, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(keys, s, e) of runs where ``above``: s the first bin, e the first bin after, or the last bin of all if open.

    Runs of fewer than ``least`` bins go.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    on = F.col(above).cast("int")
    marked = rows.withColumn("_no", F.sum((on != F.coalesce(F.lag(on).over(w), F.lit(-1))).cast("int")).over(w)).withColumn("_top", F.max("k").over(Window.partitionBy(*keys)))
    runs = marked.where(above).groupBy(*keys, "_no").agg(F.min("k").alias("s"), F.least(F.max("k") + 1, F.max("_top")).alias("e"), (F.max("k") - F.min("k") + 1).alias("_bins"))
    return runs.where(F.col("_bins") >= least).drop("_no", "_bins")


def merged(runs: DataFrame, gap: int, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Runs whose start is at most ``gap`` bins after the end before become one."""
    w = Window.partitionBy(*keys).orderBy("s")
    new = (F.col("s") - F.lag("e").over(w) > gap) | F.lag("e").over(w).isNull()
    return runs.withColumn("_no", F.sum(new.cast("int")).over(w)).groupBy(*keys, "_no").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_no")


def interval_join(intervals: DataFrame, samples: DataFrame, start: Column, end: Column, bucket: float, key: str | tuple[str, ...] = "date", ids: tuple[str, ...] | None = None, how: str = "inner") -> DataFrame:
    """Interval rows with the samples whose t is in [start, end]: an equi-join on key and time bucket, then a check.

    Intervals are repeated over the buckets that they touch, so no task compares a day's samples with all its
    intervals. A left join keeps intervals without samples, once; ``ids`` names the columns that identify one.
    """
    own = intervals.withColumns({"_a": start, "_b": end})
    spread = own.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor(F.col("_b") / bucket))))
    placed = samples.withColumn("_bucket", F.floor(F.col("t") / bucket))
    keys = [key] if isinstance(key, str) else list(key)
    hit = spread.join(placed, [*keys, "_bucket"]).where(F.col("t").between(F.col("_a"), F.col("_b"))).drop("_bucket", "_a", "_b")
    if how == "left":
        if not ids:
            raise ValueError("a left join needs the columns that identify an interval")
        hit = hit.unionByName(intervals.join(hit.select(*ids).distinct(), list(ids), "left_anti"), allowMissingColumns=True)
    return hit


def interval_stats(intervals: DataFrame, samples: DataFrame, start: Column, end: Column, bucket: float, ids: tuple[str, ...], aggregates: list[Column], key: str = "date") -> DataFrame:
    """Every interval (ids) with aggregates over its samples, null without any; one join."""
    hit = interval_join(intervals, samples, start, end, bucket, key)
    return intervals.select(*ids).join(hit.groupBy(*ids).agg(*aggregates), list(ids), "left")


def nearest(points: DataFrame, samples: DataFrame, at: str, tolerance: float, ids: tuple[str, ...], bucket: float = 3600.0) -> DataFrame:
    """(ids, near): of each point the sample, a struct of samples' columns, nearest to ``at`` and less than tolerance away; the earliest of equals."""
    hit = interval_join(points.select(*ids, F.col(at).alias("_at")), samples, F.col("_at") - tolerance, F.col("_at") + tolerance, bucket)
    gap = F.abs(F.col("t") - F.col("_at"))
    best = F.min_by(F.struct(*[c for c in samples.columns if c != "date"]), F.struct(gap, F.col("t")))
    return hit.where(gap < tolerance).groupBy(*ids).agg(best.alias("near"))


def overlapping(events: DataFrame, others: DataFrame, pad: float, key: str = "date", bucket: float = 3600.0) -> DataFrame:
    """events joined with others (key, start, end, ..) that they overlap, others padded on both sides; others' times as o_start, o_end.

    Both sides are repeated over the buckets of time that they touch and meet by key and bucket; a pair that shares
    several comes out of the first of them alone. Touching counts as overlap. An interval that ends before it starts
    overlaps nothing, nor does one with a null end.
    """
    place = lambda t: F.floor(t / bucket)
    first, last = F.col("o_start") - pad, F.col("o_end") + pad
    own = events.where("start <= end").withColumns({"_first": place(F.col("start")), "_bucket": F.explode(F.sequence(place(F.col("start")), place(F.col("end"))))})
    other = others.withColumnsRenamed({"start": "o_start", "end": "o_end"}).where(first <= last)
    other = other.withColumns({"_o_first": place(first), "_bucket": F.explode(F.sequence(place(first), place(last)))})
    met = own.join(other, [key, "_bucket"]).where(F.col("_bucket") == F.greatest("_first", "_o_first"))
    return met.where((first <= F.col("end")) & (last >= F.col("start"))).drop("_bucket", "_first", "_o_first")


def interpolated(clock: DataFrame, series: DataFrame, clamp: bool = True, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """clock's rows (keys, t, ..) with y, series (keys, t, y) interpolated at t: as-of lookups back, and back in reversed order.

    Both frames start at the key's first row: one that ends at the last row would be read again for each of its rows.
    Beyond the series' ends y is its nearest value, or null without ``clamp``.
    """
    none = F.lit(None).cast("double")
    carried = [c for c in clock.columns if c not in (*keys, "t")]
    row = F.struct(*[F.col(c) for c in carried]) if carried else F.struct(F.lit(0).alias("_0"))
    asked = clock.select(*keys, F.col("t").cast("double").alias("t"), none.alias("y"), none.alias("_t"), F.lit(1).alias("_clock"), row.alias("_row"))
    known = series.select(*keys, F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"), F.col("t").cast("double").alias("_t"), F.lit(0).alias("_clock"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    order = [F.col(c) for c in ("t", "_clock", "y")]
    back, ahead = (Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (order, [c.desc() for c in order]))
    both = asked.unionByName(known).withColumns({"y0": F.last("y", True).over(back), "t0": F.last("_t", True).over(back), "y1": F.last("y", True).over(ahead), "t1": F.last("_t", True).over(ahead)})
    between = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    inner = F.when(F.col("t0") == F.col("t"), F.col("y0")).when(F.col("t1").isNotNull() & F.col("t0").isNotNull(), between)
    value = F.coalesce(inner, F.col("y0"), F.col("y1")) if clamp else inner
    return both.where("_clock = 1").select(*keys, "t", *[F.col("_row")[c].alias(c) for c in carried], value.alias("y"))


def decayed(points: DataFrame, events: DataFrame, tau: float, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """points' rows (keys, t, ..) with history: the sum of exp(-(t - end) / tau) over events that ended by t.

    A running sum of exp(end / tau) from the key's first time on, so work is linear in points and events.
    """
    carried = [c for c in points.columns if c not in (*keys, "t")]
    row = F.struct(*[F.col(c) for c in carried]) if carried else F.struct(F.lit(0).alias("_0"))
    asked = points.select(*keys, F.col("t").cast("double").alias("t"), F.lit(1).alias("_point"), row.alias("_row"))
    both = asked.unionByName(events.select(*keys, F.col("end").cast("double").alias("t"), F.lit(0).alias("_point"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")))
    since = (F.col("t") - F.min("t").over(Window.partitionBy(*keys))) / tau
    so_far = Window.partitionBy(*keys).orderBy("t", "_point").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_since", since).withColumn("history", F.exp(-F.col("_since")) * F.sum(F.when(F.col("_point") == 0, F.exp("_since")).otherwise(0.0)).over(so_far))
    return both.where("_point = 1").select(*keys, "t", *[F.col("_row")[c].alias(c) for c in carried], "history")
