"""From instrument tables to a trained forecast and back: the day's tables, training, saving, a forecast at a moment.

Inputs are tables of the readers in ``sources.instruments`` for any number of days; everything is keyed by date, so
days spread over the cluster and there is no loop over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, sinks
from .config import Config
from .operators import detect, features, learning, measure, replay, series, skill
from .tables import written


@dataclass(frozen=True)
class Inputs:
    """curve: (date, t, counts); soft: spectra (date, detector, t, counts, exposure); bands: (date, e_lo, e_hi, t, ctr)."""

    curve: DataFrame
    soft: DataFrame | None = None
    bands: DataFrame | None = None
    response: DataFrame | None = None

    def until(self, cutoff: Column | float) -> Inputs:
        """What was there at the cutoff: all raw rows up to it."""
        cut = lambda df: None if df is None else replay.truncated(df, cutoff)
        return Inputs(cut(self.curve), cut(self.soft), cut(self.bands), self.response)


@dataclass(frozen=True)
class Days:
    """The tables that windows are made of; bands and hard are on the grid of series, over its background."""

    series: DataFrame
    events: DataFrame
    bands: DataFrame | None
    hard: DataFrame | None
    band_curves: DataFrame | None
    temperatures: DataFrame | None


def energies(events: DataFrame, soft: DataFrame | None, response: DataFrame | None) -> DataFrame:
    """events with energy_jm2, the calibrated energy; null without soft spectra or a response."""
    if soft is None or response is None:
        return events.withColumn("energy_jm2", F.lit(None).cast("double"))
    found = measure.soft_flux(events, soft, response).select(*measure.IDS, F.col("radiated_energy_jm2").alias("energy_jm2"))
    return events.join(found, list(measure.IDS), "left")


def assembled(inputs: Inputs, config: Config) -> Days:
    """Day tables: binned flux over its background, events, soft bands A to C, the hard curve, temperatures.

    A soft band is binned from its own first spectrum and meets the flux bin by bin; a shorter one leaves later bins
    null, a longer one is cut. The hard curve is the widest band's, binned on the flux's grid by time. What an
    instrument doesn't give is None. Series and events are written once, as windows read them several times.
    """
    binned = written(series.rebin(inputs.curve, config.bin_s), "binned")
    background = series.forecast_background(binned, config.bg_window, config.bg_least)
    flux = written(background.select("date", "k", "bt", "flux", "cnt", "bg", (F.col("flux") / F.col("bg")).alias("norm")), "series")
    events = written(energies(detect.focus_events(binned, config), inputs.soft, inputs.response), "events")
    base = flux.select("date", "k", "bg")
    bands = temperatures = hard = None
    if inputs.soft is not None:
        plain = inputs.soft.sparkSession.range(1).select(measure.plain_response().alias("r")).select("r.*")
        counts = written(measure.band_counts(inputs.soft, plain, measure.SOFT_BANDS), "bands")
        for name in ("a", "b", "c"):
            own = series.rebin(counts.select("date", "t", F.col(name).alias("counts")), config.bin_s).select("date", "k", F.col("flux").alias(name))
            base = base.join(own, ["date", "k"], "left")
        bands = base.select("date", "k", *[(F.col(x) / F.col("bg")).alias(x) for x in ("a", "b", "c")])
        temperatures = measure.temperature_curve(counts).select("date", "t", "t_mk")
    if inputs.bands is not None:
        wide = catalog.widest_band(inputs.bands)
        starts = flux.groupBy("date").agg(F.min("bt").alias("t0"))
        placed = wide.join(starts, "date").withColumn("k", F.floor((F.col("t") - F.col("t0")) / config.bin_s))
        means = placed.groupBy("date", "k").agg(F.avg("counts").alias("h"))
        hard = means.join(flux.select("date", "k", "bg"), ["date", "k"]).select("date", "k", (F.col("h") / F.col("bg")).alias("h"))
    return Days(flux, events, bands, hard, inputs.bands, temperatures)


def windows_of(days: Days, config: Config) -> DataFrame:
    """``features.windows`` of day tables."""
    return features.windows(days.series, days.events, config, days.bands, days.hard, days.band_curves, days.temperatures)


@dataclass(frozen=True)
class Trained:
    """Reports of a training run; all are small tables but test, the rows of the last dates with prob."""

    candidates: DataFrame
    sweep: DataFrame
    best: DataFrame
    reliability: DataFrame
    folds: DataFrame
    leads: DataFrame
    tally: DataFrame
    test: DataFrame


def train(windows: DataFrame, folder: str, kinds: tuple[str, ...] = tuple(learning.CANDIDATES), objective: str = "f0.5", params: dict[str, dict] | None = None) -> Trained:
    """Selects and fits a model on windows, and writes it with calibrator, operating point and test predictions below ``folder``.

    windows: what ``windows_of`` gives. The operating point is the best threshold on the test dates for the objective.
    Raises if the earlier or the last dates have no positive window: no score would mean anything.
    """
    params = params or {}
    rows = written(windows.withColumnsRenamed({"window_end_unix": "t", "label": "y"}), "windows")
    parts = skill.time_split(rows).groupBy("part").agg(F.sum("y").alias("n")).collect()
    if {r["part"] for r in parts if r["n"]} != {"train", "test"}:
        raise ValueError("training and test dates need positive windows each: take more dates")
    model, calibrator, table, test = learning.trained(rows, kinds, params=params)
    test = written(test.withColumn("prob", F.col("calibrated")).drop("calibrated"), "test")
    swept = written(skill.sweep(test, skill.ladder(test)), "sweep")
    best = skill.best_thresholds(swept)
    point = best.first()[objective]
    simple = skill.contingency(test.withColumn("prob", skill.persistence(F.col("flux_end"))), 0.5).first()["tss"]
    chosen = skill.selected(table, simple).first()["model"]
    learning.saved(model, calibrator, learning.operating_point(best, objective, chosen, len(features.NAMES)), folder)
    sinks.predictions_csv(sinks.predictions(test, {objective: point}), f"{folder}/test_predictions")
    folds = skill.fold_summary(learning.out_of_fold(rows, chosen, **params.get(chosen, {})))
    return Trained(table, swept, best, skill.reliability(test), folds, skill.lead_times(test, point), skill.referee(test, point), test)


def at_moment(spark: SparkSession, inputs: Inputs, config: Config, folder: str, date: str, hhmm: str) -> DataFrame:
    """The forecast for a date at HH:MM by the saved model, of nothing that came later: (date, minutes, p, and the same on each row).

    t: the window's end; prob: the chance that a significant event starts within the half hour; alarm; level: flux over
    background at the moment; ongoing: an event has started and level is 2 or more; started: when; next_start,
    came_true, minor_flares: what came, which only the reveal reads. No row if the moment is malformed or the day has
    too little data before it.
    """
    cutoff = spark.range(1).select(replay.moment(date, hhmm).alias("x")).first()["x"]
    empty = "date string, minutes long, p double, t double, prob double, alarm boolean, level double, ongoing boolean, started double, next_start double, came_true boolean, minor_flares long"
    if cutoff is None:
        return spark.createDataFrame([], empty)
    own = Inputs(*[None if df is None else df.where(F.col("date") == date) if "date" in df.columns else df for df in (inputs.curve, inputs.soft, inputs.bands, inputs.response)])
    known = assembled(own.until(cutoff), config)
    model = learning.loaded(spark, folder)
    # A single day: its window ends are few.
    scored = written(model.scored(windows_of(known, config).where("dense = 0")), "moment").select("date", "window_end_unix", "prob")
    truth = assembled(Inputs(own.curve, own.soft, None, own.response), config).events
    starts = features.significant(truth, config).select("date", "start")
    out = replay.at_moment(scored, truth, starts, cutoff, model.threshold)
    level = known.series.groupBy("date").agg(F.max_by("norm", "k").alias("level"))
    began = known.events.groupBy("date").agg(F.max("start").alias("started"))
    out = out.join(level, "date").join(began, "date", "left").withColumn("ongoing", replay.ongoing(F.col("level"), F.col("started")))
    return replay.spread(out).select(*[c.split()[0] for c in empty.split(", ")])


def replayed(inputs: Inputs, config: Config, folder: str) -> tuple[DataFrame, DataFrame]:
    """Alarm changes (date, t, what) and scorecards (``replay.scorecard``) of whole days by the saved model."""
    model = learning.loaded(inputs.curve.sparkSession, folder)
    rows = written(model.scored(windows_of(assembled(inputs, config), config).where("dense = 0")), "replay")
    rows = rows.withColumnsRenamed({"window_end_unix": "t", "label": "y"})
    return skill.transitions(rows, model.threshold), replay.scorecard(rows, model.threshold, config.lead_min * 60.0)
