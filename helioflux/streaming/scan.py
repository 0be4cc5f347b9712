"""The sequential scan as a keyed stateful operator with event-time timers.

Rows of a key (a detector, a kind) are summed into bins as they come. A timer stands at the end of a key's earliest
open bin; when the watermark passes it, that bin and all that end before the watermark are final, empty ones between
them included, and go through the scan in order. What comes out for a bin depends on the bins before it alone, not on
micro-batches or restarts. Rows of a bin that is final already are counted and left out. A key that is silent for
``expire`` bins starts anew with its next row, and its state is freed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..operators.detect import Scan
from .windows import Feed, timed

SCANNED = "key string, bin timestamp, flux double, stat double, onset long, late long"
#: Session settings that the operator needs: its state is kept by RocksDB
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


class BinState:
    """Sums of a key's open bins, and the last bin that is final. Sums are whole millionths, exact in any order."""

    OPEN = "total long, cnt long"
    DONE = "last long, late long"

    def __init__(self, handle: StatefulProcessorHandle, micros: int) -> None:
        self.handle, self.micros = handle, micros
        self.open = handle.getMapState("open", "bin long", self.OPEN)
        self.done = handle.getValueState("done", self.DONE)

    def add(self, rows: Iterator[pd.DataFrame]) -> None:
        """Takes rows (micros, value); the timer moves to the earliest open bin's end."""
        last, late = self.done.get() if self.done.exists() else (None, 0)
        for frame in rows:
            frame = frame[frame["value"].notna()]
            if not len(frame):
                continue
            at = (frame["micros"] // self.micros).astype("int64")
            whole = (frame["value"] * 1e6).round().astype("int64")
            for k, part in whole.groupby(at):
                k = int(k)
                if last is not None and k <= last:
                    late += len(part)
                    continue
                total, cnt = self.open.getValue((k,)) if self.open.containsKey((k,)) else (0, 0)
                self.open.updateValue((k,), (int(total) + int(part.sum()), int(cnt) + len(part)))
        self.done.update((last, late))
        self.wait()

    def wait(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if bins := [k for (k,) in self.open.keys()]:
            self.handle.registerTimer(self.end(min(bins)))

    def end(self, k: int) -> int:
        """Milliseconds of the end of a bin."""
        return -(-(k + 1) * self.micros // 1000)

    def close(self, watermark: int) -> Iterator[tuple[int, float, int]]:
        """(bin, mean, count) of bins that end by the watermark, with the empty ones since the last."""
        last, late = self.done.get() if self.done.exists() else (None, 0)
        final = sorted(k for (k,) in self.open.keys() if self.end(k) <= watermark)
        for k in final:
            for empty in range(k if last is None else last + 1, k):
                yield empty, 0.0, 0
            total, cnt = self.open.getValue((k,))
            self.open.removeKey((k,))
            last = k
            yield k, total / 1e6 / cnt, int(cnt)
        self.done.update((last, late))
        self.wait()

    @property
    def late(self) -> int:
        return int(self.done.get()[1])


class Expected:
    """A causal expected rate: an exponential average of the bins before; the first bin expects itself."""

    def __init__(self, weight: float, mean: float | None = None) -> None:
        self.weight, self.mean = weight, mean

    def next(self, flux: float) -> float:
        expected = max(flux if self.mean is None else self.mean, 1e-6)
        self.mean = flux if self.mean is None else self.weight * self.mean + (1 - self.weight) * flux
        return expected


def scan_bins(bins: Iterable[tuple[int, float, int]], scan: Scan, expected: Expected, bin_s: float) -> Iterator[tuple[int, float, float, int]]:
    """(bin, flux, stat, onset) of bins (bin, mean, count) in order."""
    for k, flux, _ in bins:
        mean = expected.next(flux)
        yield (k, flux, *scan.add(flux * bin_s, mean * bin_s))


class ScanProcessor(StatefulProcessor):
    """Bins and scans one key; state: open bins, and the scan as it stood after the last final bin."""

    STATE = "points array<struct<c: double, t: long, b: double>>, c double, t long, b double, was boolean, mean double, last long"

    def __init__(self, config: Config, weight: float, expire: int) -> None:
        self.config, self.weight, self.expire = config, weight, expire
        self.micros = round(config.bin_s * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bins = BinState(handle, self.micros)
        self.held = handle.getValueState("scan", self.STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self.bins.add(rows)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        scan, expected, last = Scan(self.config.focus_threshold, self.config.focus_curves, self.config.focus_window), Expected(self.weight), None
        if self.held.exists():
            points, c, t, b, was, mean, last = self.held.get()
            scan.points, scan.now, scan.was_above = [tuple(p) for p in points], (c, t, b), was
            expected.mean = mean
        out = []
        for run in self._runs(list(self.bins.close(timerValues.getCurrentWatermarkInMs())), last):
            if run[0]:
                scan, expected = Scan(self.config.focus_threshold, self.config.focus_curves, self.config.focus_window), Expected(self.weight)
            for k, flux, stat, onset in scan_bins(run[1], scan, expected, self.config.bin_s):
                out.append((key[0], pd.Timestamp(k * self.micros, unit="us"), flux, stat, onset, self.bins.late))
                last = k
        if last is not None:
            self.held.update(([tuple(p) for p in scan.points], *scan.now, scan.was_above, float(expected.mean), last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCANNED.split(", ")])

    def _runs(self, bins: list[tuple[int, float, int]], last: int | None) -> Iterator[tuple[bool, list[tuple[int, float, int]]]]:
        """Bins cut where a key was silent for ``expire`` bins; the silent ones are left out. True: starts anew."""
        held: list[tuple[int, float, int]] = []
        fresh, silent = False, []
        for row in bins:
            if not row[2]:
                silent.append(row)
                continue
            if len(silent) >= self.expire:
                yield fresh, held
                fresh, held = True, []
            else:
                held += silent
            silent = []
            held.append(row)
        yield fresh, held

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, key: str, late: str) -> DataFrame:
    """A watermarked stream's (key, micros, value); an end marker comes along under an empty key, without a value."""
    return timed(rows, late).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "ts", F.unix_micros("ts").alias("micros"), F.col("value").cast("double").alias("value"))


def scanned(feed: Feed, config: Config, key: str = "event_type", late: str = "1 hour", weight: float = 0.98, expire: int = 10_000) -> Feed:
    """(key, bin, flux, stat, onset, late) of a feed (ts, value, key): bins of config.bin_s aligned to the epoch, scanned per key.

    The expected rate is causal, an exponential average of the key's earlier bins, as a centred median would need the
    future. late: rows of the key so far that came when their bin was final. The session's state store must be RocksDB
    (``PROVIDER``), which this sets.
    """
    feed.rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def make(rows: DataFrame) -> DataFrame:
        processor = ScanProcessor(config, weight, expire)
        return keyed(rows, key, late).groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=SCANNED, outputMode="Append", timeMode="EventTime")

    return feed.map(make)


def scanned_batch(rows: DataFrame, config: Config, key: str = "event_type", weight: float = 0.98, expire: int = 10_000) -> DataFrame:
    """What ``scanned`` gives for a finished table (ts, value, key) without late rows: (key, bin, flux, stat, onset).

    Rows become bins before they are grouped by key, so a key's group holds a row for each of its bins.
    """
    micros = round(config.bin_s * MICROS)
    known = rows.where("value is not null").select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / micros).alias("k"), F.round(F.col("value").cast("double") * 1e6).cast("long").alias("v"))
    bins = known.groupBy("key", "k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("cnt"))

    def scan_key(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        out, last = [], None
        scan, expected = None, None
        for k, total, cnt in zip(frame["k"], frame["total"], frame["cnt"], strict=True):
            k = int(k)
            if last is None or k - last - 1 >= expire:
                scan, expected, last = Scan(config.focus_threshold, config.focus_curves, config.focus_window), Expected(weight), k - 1
            own = [*((x, 0.0, 0) for x in range(last + 1, k)), (k, total / 1e6 / cnt, int(cnt))]
            out += [(frame["key"].iloc[0], pd.Timestamp(x * micros, unit="us"), *rest) for x, *rest in scan_bins(own, scan, expected, config.bin_s)]
            last = k
        return pd.DataFrame(out, columns=["key", "bin", "flux", "stat", "onset"])

    return bins.groupBy("key").applyInPandas(scan_key, "key string, bin timestamp, flux double, stat double, onset long")
