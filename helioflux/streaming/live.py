"""A day's forecast as a stream: samples in, windows, chances and alarms out, each made of what was known at its moment.

Samples of a day wait until the watermark has passed them, then fall into the day's bins in order of time; the grid
starts at the first of them. They wait packed, a value of state for each batch of rows, as every value costs a call to
the state's server. After each bin that ends a window, the background of the look-back is taken from the bins
so far, so the features are those of a batch run on data cut at that moment. Ends of events come along in the same
stream and keep a decayed sum, which a new one raises and time lowers. State is one day's bins at most, and goes with
the day. The model's own transform scores the windows of the stream, and a second keyed operator reports where the
alarm is raised and where it ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..operators import features
from .scan import MICROS, PROVIDER
from .windows import Feed, timed

#: Channels of a bin: all samples, three bands, the hard instrument
CHANNELS = ("f", "a", "b", "c", "h")
#: A sample's kind that marks the end of a significant event
EVENT_END = "event_end"
DAY = 86_400 * MICROS
#: A waiting sample; code: the index of its channel, or one of the two below
SAMPLE = np.dtype([("micros", "<i8"), ("value", "<f8"), ("code", "i1")])
NO_CHANNEL, ENDED = -1, -2
#: Features that a window's own bins and the events before it give; the others are 0 without spectra
MEASURED = tuple(x for x in features.NAMES if x not in ("temp_trend_MK_per_min", "gamma_window", "gamma_trend", "precursor_concentration"))


def window_values(rows: np.ndarray, cnt: np.ndarray, steps: np.ndarray, lookback: int) -> dict[str, float]:
    """The features that ``operators.features.features`` makes of a window: rows are channels over bins, NaN where unseen.

    steps: differences to the bin before, of the first and of the last channel.
    """
    n, tenth = rows.shape[1], max(lookback // 10, 1)
    out = dict.fromkeys(features.NAMES, 0.0)
    if n < 3:
        return out
    f, a, b, c, h = rows
    j = np.arange(n)
    early, late = j < tenth, j >= lookback - tenth
    some = lambda x: max(x, 1e-6)

    def mean(x: np.ndarray) -> float:
        x = x[~np.isnan(x)]
        return float(x.mean()) if len(x) else np.nan

    def most(x: np.ndarray) -> float:
        x = x[~np.isnan(x)]
        return float(x.max()) if len(x) else np.nan

    def slope(y: np.ndarray) -> float:
        ok = ~np.isnan(y)
        x, y = j[ok].astype(float), y[ok]
        d = x - x.mean() if len(x) else x
        return float((d * (y - y.mean())).sum() / (d * d).sum()) if len(x) > 1 else 0.0

    def spread(x: np.ndarray) -> float:
        x = x[~np.isnan(x)]
        return float(np.sqrt(((x - x.mean()) ** 2).mean())) if len(x) else np.nan

    ratio = np.where(np.isnan(a), np.nan, b / np.maximum(a, 1e-6))
    hard, banded = bool((~np.isnan(h)).any()), bool((~np.isnan(a)).any())
    m = {"a": mean(a), "b": mean(b), "c": mean(c)}
    trend, hard_trend, sf, sh = slope(f), slope(h), spread(f), spread(h)
    start, end = mean(f[early]), mean(f[late])
    h0, h1 = mean(h[early]), mean(h[late])
    centred = f - f.mean()
    second = (centred**2).mean()
    skew = (centred**3).mean() / second**1.5 if second > 0 else np.nan
    peaks = features.peaks_of(f)
    hard_peaks = features.peaks_of(np.nan_to_num(h)) if hard else (0, 0.0)
    out |= {
        "flux_mean": mean(f), "flux_max": most(f), "flux_end": end, "flux_trend_slope": trend, "flux_std": sf,
        "dflux_mean": mean(steps[0, 1:]), "dflux_max": most(steps[0, 1:]), "dflux_pos_frac": float((steps[0, 1:] > 0).mean()), "excess_above_bg": most(f) - 1, "max_sigma": most(f),
        "flux_bandA": m["a"], "flux_bandB": m["b"], "flux_bandC": m["c"], "ratio_B_A": m["b"] / some(m["a"]), "ratio_C_total": m["c"] / some(m["a"] + m["b"] + m["c"]),
        "ratio_B_A_trend": slope(ratio), "ratio_B_A_end": mean(ratio[late]), "spectral_slope": np.log10(some(m["c"])) / some(np.log10(some(m["a"]))) if banded else 0.0,
        "n_micro_peaks": float(peaks[0]), "recent_vs_early": end / some(start), "flux_skewness": skew * np.sqrt(n * (n - 1)) / (n - 2), "flux_start": start, "micro_energy": peaks[1],
        "helos_flux_mean": mean(h), "helos_flux_max": most(h), "helos_trend_slope": hard_trend, "helos_std": sh, "helos_dflux_max": most(steps[1, 1:]), "helos_max_sigma": most(h),
        "helos_recent_vs_early": h1 / some(h0) if not np.isnan(h0) else 0.0, "helos_n_micro_peaks": float(hard_peaks[0]), "helos_precursor": float(hard and hard_trend > 0 and trend <= 0),
        "helos_to_solexs_ratio": mean(h) / some(mean(f)), "helos_lead_signal": most(h[early]), "hard_soft_trend_diff": hard_trend - trend if hard else 0.0, "data_gap_frac": 1 - float((cnt > 0).mean()),
    }
    if not np.isnan(h).any() and sf >= 1e-9 and sh >= 1e-9:
        out["cross_corr"] = float((centred * (h - h.mean())).mean() / (sf * sh))
    if not banded:
        out |= {"ratio_B_A": 0.0, "ratio_C_total": 0.0}
    return {k: float(v) if np.isfinite(v) else 0.0 for k, v in out.items()}


class DayBins:
    """A day's bins so far: sums and counts by channel."""

    def __init__(self, bins: list[tuple] | None = None) -> None:
        rows = np.array(bins or [], dtype=float).reshape(-1, 2 * len(CHANNELS))
        self.sums, self.counts = rows[:, : len(CHANNELS)].copy(), rows[:, len(CHANNELS) :].astype(np.int64)

    def add(self, k: np.ndarray, code: np.ndarray, value: np.ndarray) -> None:
        """Samples in order of time; all of them count in the first channel."""
        more = int(k.max(initial=-1)) + 1 - len(self.sums)
        if more > 0:
            self.sums, self.counts = (np.pad(x, ((0, more), (0, 0))) for x in (self.sums, self.counts))
        for c in range(len(CHANNELS)):
            own = code == c if c else np.ones(len(k), bool)
            np.add.at(self.sums[:, c], k[own], value[own])
            np.add.at(self.counts[:, c], k[own], 1)

    def rows(self, first: int = 0) -> list[tuple]:
        return [(*s, *c) for s, c in zip(self.sums[first:].tolist(), self.counts[first:].tolist(), strict=True)]

    def window(self, i: int, config: Config) -> dict[str, float]:
        """The features of bins [i - lookback, i), of the first i bins alone."""
        lookback = features.bins(config)[0]
        sums, counts = self.sums[:i], self.counts[:i]
        mean = np.divide(sums, counts, out=np.full(sums.shape, np.nan), where=counts > 0)
        flux = np.nan_to_num(mean[:, 0])
        floor = max(0.01 * float(np.median(flux[flux > 0])) if (flux > 0).any() else 1e-6, 1e-6)
        # One bin more, for the first difference.
        first = max(i - lookback - 1, 0)
        before = config.bg_window // 2
        after = before - 1 if config.bg_window % 2 == 0 else before
        low = np.full(len(flux) - first, np.nan)
        for x, k in enumerate(range(first, len(flux))):
            frame = flux[max(k - before, 0) : k + after + 1]
            if len(frame) >= config.bg_least:
                low[x] = np.quantile(frame, 0.1)
        low = pd.Series(low).ffill().bfill().fillna(0.0).to_numpy()
        over = (mean[first:] / np.maximum(low, floor)[:, None]).T
        over[0] = flux[first:] / np.maximum(low, floor)
        steps = np.diff(over[[0, -1]], axis=1, prepend=np.nan)
        skip = max(i - lookback, 0) - first
        return window_values(over[:, skip:], counts[first + skip :, 0], steps[:, skip:], lookback)


WINDOWS = "date string, i long, t double, data_to double, " + ", ".join(f"{x} double" for x in features.NAMES if x != "precursor_concentration")


class WindowProcessor(StatefulProcessor):
    """Windows of one day. State: samples that the watermark hasn't passed, bins, the grid, the decayed sum of events."""

    def __init__(self, config: Config, channels: dict[str, str]) -> None:
        self.config = config
        self.codes = {k: CHANNELS.index(v) for k, v in channels.items()} | {EVENT_END: ENDED}
        self.micros = round(config.bin_s * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "samples binary")
        self.bins = handle.getListState("bins", ", ".join([*(f"s_{c} double" for c in CHANNELS), *(f"n_{c} long" for c in CHANNELS)]))
        self.grid = handle.getValueState("grid", "origin long, moment long, decayed double, last double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.grid.get()[0] if self.grid.exists() else None
        first = None
        for frame in rows:
            # Whoever comes before the grid's start is late by definition.
            frame = frame[frame["micros"].notna() & frame["kind"].notna()]
            fresh = frame if known is None else frame[frame["micros"] >= known]
            if len(fresh):
                packed = np.empty(len(fresh), SAMPLE)
                packed["micros"], packed["value"] = fresh["micros"], fresh["value"]
                packed["code"] = fresh["kind"].map(self.codes).fillna(NO_CHANNEL)
                self.waiting.appendValue((packed.tobytes(),))
                least = int(packed["micros"].min())
                first = least if first is None else min(first, least)
        if first is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(self._ms((known if known is not None else first) + self.micros))
        return iter(())

    @staticmethod
    def _ms(micros: int) -> int:
        return -(-micros // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        water = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = np.concatenate([np.empty(0, SAMPLE), *(np.frombuffer(x, SAMPLE) for (x,) in self.waiting.get())])
        waiting = waiting[np.lexsort((waiting["code"], waiting["value"], waiting["micros"]))]
        times = waiting["micros"]
        latest = int(times[-1]) if len(times) else None
        if self.grid.exists():
            origin, moment, decayed, last = self.grid.get()
        else:
            origin, moment, decayed, last = int(times[0]), features.bins(self.config)[0], 0.0, None
        day = DayBins(list(self.bins.get()))
        known, step = len(day.sums), features.bins(self.config)[2]
        # Bins that are whole by now, but none that starts after the last sample.
        final = min((water - origin) // self.micros, (latest - origin) // self.micros if latest is not None else 0)
        out, at = [], 0

        def take(until: int) -> None:
            nonlocal at, decayed, last
            stop = int(np.searchsorted(times, until))
            part, at = waiting[at:stop], stop
            for micros in part["micros"][part["code"] == ENDED].tolist():
                t = micros / MICROS
                decayed = 1.0 + (decayed * exp(-(t - last) / self.config.history_tau_s) if last is not None else 0.0)
                last = t
            part = part[(part["code"] != ENDED) & ~np.isnan(part["value"])]
            day.add((part["micros"] - origin) // self.micros, part["code"], part["value"])

        while moment <= final:
            edge = origin + moment * self.micros
            take(edge)
            if len(day.sums) > 0:
                t = edge / MICROS
                own = day.window(moment, self.config)
                own["time_since_last_flare_min"] = min((t - last) / 60, self.config.time_cap_min) if last is not None else self.config.time_cap_min
                own["decayed_flare_history"] = decayed * exp(-(t - last) / self.config.history_tau_s) if last is not None else 0.0
                out.append((key[0], moment, t, max(int(times[at - 1]) / MICROS if at else 0.0, 0.0), *(own[x] for x in features.NAMES if x != "precursor_concentration")))
            moment += step
        take(origin + final * self.micros)
        rest = waiting[at:]
        if water >= self._day_end(origin) and (not len(rest) or final >= (latest - origin) // self.micros):
            for state in (self.waiting, self.bins, self.grid):
                state.clear()
        else:
            self.waiting.put([(rest.tobytes(),)]) if len(rest) else self.waiting.clear()
            # Bins never change once they are whole, so only new ones are written.
            self.bins.appendList(day.rows(known)) if len(day.sums) > known else None
            self.grid.update((origin, moment, decayed, last))
            nearest = origin + (final + 1) * self.micros
            self.handle.registerTimer(self._ms(max(nearest, water + self.micros) if len(rest) else self._day_end(origin) + self.micros))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    @staticmethod
    def _day_end(origin: int) -> int:
        return (origin // DAY + 1) * DAY

    def close(self) -> None:
        pass


def live_windows(feed: Feed, config: Config, channels: dict[str, str], kind: str = "event_type", late: str = "1 hour") -> Feed:
    """(date, i, t, data_to, the 43 features) of a feed (ts, value, kind): a window at each step of a day, of what was known at t.

    channels: a kind's channel, a, b, c (bands) or h (hard); the flux is of all kinds. Rows of kind ``EVENT_END`` are
    ends of significant events. data_to: time of the newest sample used. A window comes out when the watermark has
    passed it and a later sample is there. Spectral features are 0. The state store is RocksDB, which this sets.
    """
    feed.rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def make(rows: DataFrame) -> DataFrame:
        own = timed(rows, late).select(F.coalesce(F.date_format("ts", "yyyyMMdd"), F.lit("")).alias("date"), "ts", F.unix_micros("ts").alias("micros"), F.col("value").cast("double").alias("value"), F.col(kind).cast("string").alias("kind"))
        out = own.groupBy("date").transformWithStateInPandas(statefulProcessor=WindowProcessor(config, channels), outputStructType=WINDOWS, outputMode="Append", timeMode="EventTime")
        return features.precursor(out).select("date", "i", "t", "data_to", *features.NAMES)

    return feed.map(make)


ALARMS = "date string, t double, prob double, what string"


class AlarmProcessor(StatefulProcessor):
    """Where a day's alarm is raised and where it ends; state: whether it is on."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.on = handle.getValueState("alarm", "alarm boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        was = bool(self.on.get()[0]) if self.on.exists() else False
        whole, out = pd.concat(list(rows)).sort_values("t"), []
        for t, prob in zip(whole["t"], whole["prob"], strict=True):
            now = prob >= self.threshold
            if now != was:
                out.append((key[0], float(t), float(prob), "raised" if now else "all-clear"))
            was = now
        self.on.update((bool(was),))
        yield pd.DataFrame(out, columns=["date", "t", "prob", "what"])

    def close(self) -> None:
        pass


def alarms(scored: Feed, threshold: float) -> Feed:
    """(date, t, prob, what) of a feed of scored windows (date, t, prob): changes of the alarm; a day starts quiet."""

    def make(rows: DataFrame) -> DataFrame:
        return rows.select("date", "t", "prob").groupBy("date").transformWithStateInPandas(statefulProcessor=AlarmProcessor(threshold), outputStructType=ALARMS, outputMode="Append", timeMode="None")

    return scored.map(make)
