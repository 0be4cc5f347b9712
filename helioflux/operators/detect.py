"""Event detection: the sequential Poisson scan, its multi-window form, and island-based detectors."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from .intervals import interval_join, overlapping
from .series import averaged, floored, noise, robust


class Scan:
    """Online change-point statistic: past points that can still start the best segment, on a lower hull in time."""

    def __init__(self, threshold: float, curves: int = 64, window: int = 360) -> None:
        self.threshold, self.curves, self.window = threshold, curves, window
        self.points: list[tuple[float, int, float]] = [(0.0, 0, 0.0)]
        self.now, self.was_above = (0.0, 0, 0.0), False

    def add(self, count: float, expected: float) -> tuple[float, int]:
        """The statistic after one more bin, and the bin at which its segment starts (-1: none)."""
        c, t, b = self.now
        new = (c + max(count, 0.0), t + 1, b + max(expected, 1e-9))
        best, onset = 0.0, -1
        held = self.points
        while len(held) >= 2:
            (c1, t1, _), (c2, t2, _) = held[-2], held[-1]
            if (c2 - c1) * (new[1] - t2) < (new[0] - c2) * (t2 - t1):
                break
            held.pop()
        held.append(new)
        if len(held) > self.curves:
            del held[: len(held) - self.curves]
        while len(held) >= 2 and held[0][1] < new[1] - self.window:
            held.pop(0)
        for c0, t0, b0 in held[:-1]:
            seen, expect, bins = new[0] - c0, new[2] - b0, new[1] - t0
            if bins > 0 and seen / bins > expect / bins:
                llr = seen * log(seen / expect) - (seen - expect)
                if llr > best:
                    best, onset = llr, t0
        self.now = new
        above = best > self.threshold
        if self.was_above and not above:
            self.points = [new]
        self.was_above = above
        return best, onset


def scan(counts: np.ndarray, expected: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    state = Scan(config.focus_threshold, config.focus_curves, config.focus_window)
    out = [state.add(c, b) for c, b in zip(counts.tolist(), expected.tolist(), strict=True)]
    return np.array([s for s, _ in out]), np.array([o for _, o in out], dtype=np.int64)


def focus_scan(series: DataFrame, config: Config, key: str = "date", expected: str = "med") -> DataFrame:
    """Series with stat, onset and fred: the scan and the shape filter over each key's bins in order.

    One pass of Python over a key's series, which is one day, so bounded; all other columns go along.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        flux = frame["flux"].to_numpy()
        stat, onset = scan(flux * config.bin_s, np.maximum(frame[expected].to_numpy(), 1e-6) * config.bin_s, config)
        return frame.assign(stat=stat, onset=onset, fred=averaged(flux, config.fred_slow) - averaged(flux, config.fred_fast))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema)
    return series.groupBy(key).applyInPandas(run, f"{schema}, stat double, onset long, fred double")


def multiwindow(series: DataFrame, window: int, expected: str = "med") -> DataFrame:
    """(date, k, llr): the best Poisson log likelihood ratio over all segments of at most ``window`` bins that end at k.

    Segments' sums are differences of running sums, kept as whole millionths so that they are exact. The running
    sums of the last ``window`` bins are an array in a bounded frame: no join, and no row for each segment.
    """
    upto = Window.partitionBy("date").orderBy("k")
    whole = lambda x: F.round(x * 1e6).cast("long")
    sums = series.select("date", "k", F.sum(whole(F.greatest("flux", F.lit(0.0)))).over(upto).alias("c"), F.sum(whole(F.greatest(expected, F.lit(1e-9)))).over(upto).alias("b"))
    before = F.struct(F.coalesce(F.lag("c").over(upto), F.lit(0)).alias("c"), F.coalesce(F.lag("b").over(upto), F.lit(0)).alias("b"))
    held = sums.withColumn("_before", before).withColumn("_starts", F.collect_list("_before").over(upto.rowsBetween(1 - window, 0)))

    def ratio(start: Column) -> Column:
        n, m = (F.col("c") - start["c"]) / 1e6, (F.col("b") - start["b"]) / 1e6
        return F.when(n > m, n * F.ln(n / m) - (n - m)).otherwise(0.0)

    return held.select("date", "k", F.array_max(F.transform("_starts", ratio)).alias("llr"))


def prepared(series: DataFrame, config: Config) -> DataFrame:
    """Series with background, floored background, rolling median (at least the floor) and noise."""
    out = floored(robust(series, config.bg_window, config.bg_least), 0.1, 1.0)
    return noise(out.withColumn("med", F.greatest("med", "floor")), config.bg_window)


def events(flagged: DataFrame, config: Config, flux: bool = False) -> DataFrame:
    """Events of prepared series with a boolean ``above`` and, if there, stat and fred: islands, merged, with peak and rise gate.

    (date, event_no, s, p, e, start, peak, end, peak_flux, bg, ratio, sigma, data_gap, energy, focus_stat, fred_shape_stat)
    and, with ``flux``, the bins' flux and bt from s up to e as arrays. A day of fewer bins than the background's window
    has no events. energy: flux above the background at the peak, times seconds, over the bins from s up to e.

    All is windows and one aggregation by day, so one exchange serves the whole chain.
    """
    day = Window.partitionBy("date")
    w = day.orderBy("k")
    gap = int(config.merge_gap_s // config.bin_s)
    rows = flagged.withColumns({"_top": F.max("k").over(day), "_n": F.count(F.lit(1)).over(day)}).where(F.col("_n") >= config.bg_window)
    change = F.col("above") != F.coalesce(F.lag("above").over(w), ~F.col("above"))
    rows = rows.withColumn("_no", F.sum(change.cast("int")).over(w))
    run = Window.partitionBy("date", "_no")
    rows = rows.withColumns({"_s": F.min("k").over(run), "_e": F.least(F.max("k").over(run) + 1, F.col("_top")), "_bins": F.count(F.lit(1)).over(run)})
    held = F.col("above") & (F.col("_bins") >= config.min_dur_bins)
    # A kept run opens an event unless it starts within the gap after the kept run before it.
    first = held & (F.col("k") == F.col("_s"))
    before = F.max(F.when(held, F.col("_e"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_held": held, "_opens": first & (before.isNull() | (F.col("_s") - before > gap))})
    rows = rows.withColumn("_event", F.sum(F.col("_opens").cast("int")).over(w)).where("_event > 0")
    event = Window.partitionBy("date", "_event")
    rows = rows.withColumns({"s": F.min("k").over(event), "e": F.max(F.when(F.col("_held"), F.col("_e"))).over(event)}).where("k <= e")
    inside = (F.col("k") < F.col("e")) | (F.col("k") == F.col("s"))
    top = F.min_by(F.struct("k", "bt", "flux", "bg", "bg_safe", "noise", "floor"), F.when(inside, F.struct(-F.col("flux"), F.col("k"))))
    extra = [F.max(F.when(inside, F.col(c))) if c in flagged.columns else F.lit(None).cast("double") for c in ("stat", "fred")]
    seen = F.array_sort(F.collect_list(F.when(F.col("k") < F.col("e"), F.struct("k", "bt", "flux"))))
    out = rows.groupBy("date", "_event", "s", "e").agg(
        top.alias("x"), F.min_by("bg_safe", "k").alias("b0"), F.min_by("bt", "k").alias("start"), F.max_by("bt", "k").alias("end"), extra[0].alias("focus_stat"), extra[1].alias("fred_shape_stat"), seen.alias("seen")
    )
    out = out.where(F.col("x.flux") >= config.rise_ratio * F.greatest("b0", F.lit(1e-6)))
    number = F.row_number().over(Window.partitionBy("date").orderBy("s"))
    energy = F.aggregate("seen", F.lit(0.0), lambda a, r: a + F.greatest(r["flux"] - F.col("x.bg_safe"), F.lit(0.0))) * config.bin_s
    arrays = [F.transform("seen", lambda r: r["flux"]).alias("flux"), F.transform("seen", lambda r: r["bt"]).alias("bt")] if flux else []
    return out.select(
        "date", number.alias("event_no"), "s", F.col("x.k").alias("p"), "e", "start", F.col("x.bt").alias("peak"), "end", F.col("x.flux").alias("peak_flux"), F.col("x.bg_safe").alias("bg"),
        (F.col("x.flux") / F.col("x.bg_safe")).alias("ratio"), ((F.col("x.flux") - F.col("x.bg_safe")) / F.col("x.noise")).alias("sigma"), (F.col("x.bg") < F.col("x.floor")).alias("data_gap"), energy.alias("energy"), "focus_stat", "fred_shape_stat", *arrays,
    )


def sigma_events(series: DataFrame, config: Config, sigma: float = 1.0, flux: bool = False) -> DataFrame:
    """Events where the robust sigma passes a threshold: the trigger that plain SQL can express."""
    ready = prepared(series, config)
    return events(ready.withColumn("above", (F.col("flux") - F.col("bg_safe")) / F.col("noise") > sigma), config, flux)


def focus_events(series: DataFrame, config: Config, flux: bool = False) -> DataFrame:
    """Events by the sequential scan against the rolling median; the scan's Python pass runs once."""
    hot = focus_scan(prepared(series, config), config)
    return events(hot.withColumn("above", F.col("stat") > config.focus_threshold), config, flux)


BAND_EVENTS = "date string, band string, start double, peak double, end double, focus_stat double, peak_rate double, bg_rate double"


def band_events(curves: DataFrame, config: Config, min_dur_s: float = 60.0, bg_window_s: float = 1200.0) -> DataFrame:
    """Events of each (date, band) on its own: curves (date, band, t, counts), raw counts a sample at any cadence.

    Bins are as wide as config.bin_s or the median step if that is wider, and empty ones are left out; the background is
    a rolling median. A band's day of fewer than ten samples or bins has none. The kernel runs once a (date, band).
    """
    schema = BAND_EVENTS

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        frame = frame.sort_values("t")
        t, c = frame["t"].to_numpy(), np.maximum(frame["counts"].to_numpy(), 0.0)
        step = float(np.median(np.diff(t))) if len(t) >= 10 else 0.0
        if not step > 0:
            return none
        width = max(config.bin_s, step)
        at = np.floor((t - t[0]) / width).astype(np.int64)
        sums, held = np.bincount(at, weights=c), np.bincount(at) > 0
        bt, sums = (t[0] + (np.arange(len(sums)) + 0.5) * width)[held], sums[held]
        if len(bt) < 10:
            return none
        window = max(int(bg_window_s / width), 6)
        middle = pd.Series(sums).rolling(window, center=True, min_periods=max(window // 4, 2)).median().ffill().bfill().to_numpy()
        bg = np.maximum(middle, 1e-6)
        stat, _ = scan(sums, bg, config)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], stat > config.focus_threshold, [False]]).astype(int)))
        runs = [(a, min(b, len(sums) - 1)) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= max(int(min_dur_s / width), 2)]
        joined: list[tuple[int, int]] = []
        for a, b in runs:
            if joined and a - joined[-1][1] <= max(int(config.merge_gap_s / width), 1):
                joined[-1] = (joined[-1][0], b)
            else:
                joined.append((a, b))
        rows = []
        for a, b in joined:
            top = a + int(np.argmax(sums[a : max(b, a + 1)]))
            if sums[top] >= config.rise_ratio * max(bg[a], 1e-6):
                rows.append((frame["date"].iloc[0], frame["band"].iloc[0], bt[a], bt[top], bt[b], stat[a : max(b, a + 1)].max(), sums[top] / width, bg[top] / width))
        return pd.DataFrame(rows, columns=none.columns)

    return curves.select("date", "band", "t", "counts").groupBy("date", "band").applyInPandas(run, schema)


def confirmed(events: DataFrame, curves: DataFrame, config: Config, ids: tuple[str, ...] = ("date", "event_no"), around: float = 600.0) -> DataFrame:
    """(ids, confirmed, match_score, focus_stat) of events: the best band of curves (date, band, t, counts) around each.

    A band's samples from ``around`` seconds before to after the event are scanned against their median; fewer than
    five say nothing. The score weighs nearness of the scan's top to the event's peak and its strength.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ids) + ", confirmed boolean, match_score double, focus_stat double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        columns = [*ids, "confirmed", "match_score", "focus_stat"]
        if len(frame) < 5:
            return pd.DataFrame(columns=columns)
        frame = frame.sort_values("t")
        counts = np.maximum(frame["counts"].to_numpy(), 0.0)
        stat, _ = scan(counts, np.full(len(counts), max(float(np.median(counts)), 1e-6)), config)
        top, one = int(np.argmax(stat)), frame.iloc[0]
        off = abs(float(frame["t"].iloc[top]) - one["peak"]) / max(one["end"] - one["start"], 6 * config.bin_s)
        sure = bool(stat[top] > config.focus_threshold)
        score = 0.6 * max(0.0, 1 - off) + 0.4 * min(stat[top] / config.focus_threshold, 3.0) / 3 if sure else 0.0
        return pd.DataFrame([(*(one[c] for c in ids), sure, float(score), float(stat[top]))], columns=columns)

    near = interval_join(events.select(*ids, "start", "peak", "end"), curves.select("date", "band", "t", "counts"), F.col("start") - around, F.col("end") + around, 3600.0)
    found = near.groupBy(*ids, "band").applyInPandas(run, schema)
    best = F.max_by(F.struct("confirmed", "match_score", "focus_stat"), F.struct("match_score", "focus_stat"))
    return found.groupBy(*ids).agg(best.alias("x")).select(*ids, "x.*")


def votes(events: DataFrame, found: DataFrame, covered: DataFrame, ids: tuple[str, ...] = ("date", "event_no"), pad: float = 120.0) -> DataFrame:
    """(ids, votes_yes, votes_covered, voting_bands): which bands' own events (date, band, start, end) overlap each event.

    covered: (date, band) with data, also without events. Days without any covered band have no row.
    """
    by_day = covered.groupBy("date").agg(F.countDistinct("band").cast("int").alias("votes_covered"))
    yes = overlapping(events.select(*ids, "start", "end"), found.select("date", "band", "start", "end"), pad)
    yes = yes.groupBy(*ids).agg(F.array_sort(F.collect_set("band")).alias("voting_bands"))
    out = events.select(*ids).join(by_day, "date").join(yes, list(ids), "left")
    return out.select(*ids, F.coalesce(F.size("voting_bands"), F.lit(0)).alias("votes_yes"), "votes_covered", "voting_bands").withColumn("votes_yes", F.when(F.col("voting_bands").isNull(), 0).otherwise(F.col("votes_yes")))


def peaks(y: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Local maxima; a flat top counts once at its middle. Lower peaks nearer than ``distance`` go first."""
    n, found, i = len(y), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < n - 1 and y[j + 1] < y[i]:
            found.append((i + j) // 2)
        i = j + 1
    keep = np.ones(len(found), dtype=bool)
    at = np.array(found, dtype=np.int64)
    # From the highest down, each kept peak takes out its neighbours in reach, which are adjacent in the sorted list.
    for i in np.lexsort((-at, -y[at])) if distance > 1 and len(at) else ():
        if not keep[i]:
            continue
        for side in (-1, 1):
            j = i + side
            while 0 <= j < len(at) and abs(at[j] - at[i]) < distance:
                keep[j] = False
                j += side
    out = []
    for p in at[keep].tolist():
        left, right = y[:p][::-1], y[p + 1 :]
        low = []
        for side in (left, right):
            higher = np.flatnonzero(side > y[p])
            part = side[: higher[0]] if len(higher) else side
            low.append(min(float(y[p]), float(part.min()) if len(part) else float(y[p])))
        if y[p] - max(low) >= prominence:
            out.append(p)
    return np.array(out, dtype=np.int64)
