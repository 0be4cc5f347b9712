"""The event catalog: detection, measurements, checks and confidence as one table of 57 columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import Config
from .functions.scalar import approx_class, fixed, goes_class, utc
from .operators import checks, detect, measure, series, spectra, timing
from .tables import written

IDS = measure.IDS
#: Lowest usable energy of each hard detector, keV; fixed values
LOW = {"cdte": 9.5, "czt": 35.0}
#: The catalog's columns in order; fixed values
COLUMNS = (
    "event_id", "date", "start_utc", "peak_utc", "end_utc", "duration_s", "peak_rate", "background", "ratio", "sigma", "data_gap", "class_approx", "class_is_real_flux",
    "temp_MK", "temp_MK_err", "temp_MK_fit", "temp_MK_fit_err", "hardness_ratio", "temp_offset_s", "qpp_period_s", "gamma", "gamma_err", "delta", "neupert_corr", "neupert_best_lag_s", "neupert_corr_at_lag",
    "check_neupert", "check_accel_timing", "check_heat_timing", "check_energy_budget", "check_qpp_witness", "check_class_accel", "n_pass", "n_flag", "checks_run", "confidence", "confidence_pct", "radiated_energy_proxy",
    "peak_flux_wm2", "peak_flux_wm2_err", "bg_flux_wm2", "radiated_energy_jm2", "hard_peak_flux_wm2", "hard_peak_flux_wm2_err", "hard_bg_flux_wm2", "hard_energy_jm2",
    "band1_wm2_2p8_20keV", "band2_wm2_20_60keV", "band3_wm2_60_150keV", "dominant_energy_band", "n_bands_covered", "band_independently_confirmed", "cross_band_class_agree", "independent_band_votes", "voting_bands", "check_temp_fit", "check_band_vote",
)
#: What measurements may add, with their types; a mode or missing input leaves them null
MEASURED = {
    "temp_mk": "double", "temp_mk_err": "double", "hardness": "double", "temp_offset_s": "double", "t_mk": "double", "t_mk_err_lo": "double", "t_mk_err_hi": "double", "period": "double",
    "gamma": "double", "gamma_err": "double", "delta": "double", "hard_peak_time": "double", "corr": "double", "best_lag_s": "int", "corr_at_best": "double",
    "peak_flux_wm2": "double", "peak_flux_wm2_err": "double", "bg_flux_wm2": "double", "radiated_energy_jm2": "double", "hard_peak_flux_wm2": "double", "hard_peak_flux_wm2_err": "double", "hard_bg_flux_wm2": "double", "hard_energy_jm2": "double",
    "band1_wm2": "double", "band2_wm2": "double", "band3_wm2": "double", "dominant_band": "string", "n_bands_covered": "int", "agree": "boolean", "confirmed": "boolean", "match_score": "double", "votes_yes": "int", "votes_covered": "int", "voting_bands": "array<string>",
}


def widest_band(bands: DataFrame) -> DataFrame:
    """The light curve (date, t, counts) of each day's widest band, the one of higher energies among equals."""
    best = bands.groupBy("date").agg(F.max(F.struct((F.col("e_hi") - F.col("e_lo")).alias("w"), "e_lo", "e_hi")).alias("x")).select("date", "x.e_lo", "x.e_hi")
    return bands.join(F.broadcast(best), ["date", "e_lo", "e_hi"]).select("date", "t", F.col("ctr").alias("counts"))


def preferred(hard: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Hard spectra of each day's first detector in ``order`` that has any."""
    rank = F.array_position(F.array(*[F.lit(d) for d in order]), F.col("detector"))
    best = hard.where(rank > 0).groupBy("date").agg(F.min_by("detector", rank).alias("detector"))
    return hard.join(F.broadcast(best), ["date", "detector"])


def vote_curves(spectra_: DataFrame | None, hard: DataFrame | None, response: DataFrame | None) -> DataFrame | None:
    """(date, band, t, counts): raw counts of each canonical band from the source that stands for it.

    Band 1: the soft spectra by their channel energies, or without any CdTe from its lowest energy on; band 2: CZT, or
    else CdTe; band 3: CZT. The hard detectors' channels need a response.
    """
    parts = []
    lo, hi = measure.CANONICAL["band1"]
    if spectra_ is not None:
        plain = spectra_.sparkSession.range(1).select(measure.plain_response().alias("r")).select("r.*")
        parts.append(measure.reduced(spectra_, plain, counts=F.when(measure.within(lo, hi), 1.0)).select("date", F.lit("band1").alias("band"), "t", "counts"))
    if hard is not None and response is not None:
        if spectra_ is None:
            parts.append(measure.reduced(hard.where("detector = 'cdte'"), response, counts=F.when(measure.within(LOW["cdte"], hi), 1.0)).select("date", F.lit("band1").alias("band"), "t", "counts"))
        for band, order in (("band2", ("czt", "cdte")), ("band3", ("czt",))):
            lo_, hi_ = measure.CANONICAL[band]
            parts.append(measure.reduced(preferred(hard, order), response, counts=F.when(measure.within(lo_, hi_), 1.0)).select("date", F.lit(band).alias("band"), "t", "counts"))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def confirm_curves(hard: DataFrame, response: DataFrame, mode: str) -> DataFrame:
    """(date, band, t, counts) that may confirm an event: CZT's bands 2 and 3, or else CdTe's band 2 where the mode is not hard."""
    czt = preferred(hard, ("czt",) if mode == "HARD" else ("czt", "cdte"))
    out = None
    for band in ("band2", "band3"):
        lo, hi = measure.CANONICAL[band]
        rows = czt if band == "band2" else czt.where("detector = 'czt'")
        own = measure.reduced(rows, response, counts=F.when(measure.within(lo, hi), 1.0)).select("date", F.lit(band).alias("band"), "t", "counts")
        out = own if out is None else out.unionByName(own)
    return out


def measurements(events: DataFrame, config: Config, mode: str, soft: DataFrame | None, bands: DataFrame | None, hard: DataFrame | None, response: DataFrame | None) -> list[DataFrame]:
    """Tables keyed by (date, event_no), one for each kind of measurement that the inputs allow."""
    own = events.drop("flux", "bt")
    out = [timing.pulsations(events, config.bin_s).select(*IDS, "period")]
    if soft is not None:
        plain = soft.sparkSession.range(1).select(measure.plain_response().alias("r")).select("r.*")
        counts = measure.band_counts(soft, response if response is not None else plain, {n: measure.SOFT_BANDS[n] for n in ("a", "b")}, response is not None)
        out.append(measure.temperature(own, counts).withColumnRenamed("temp_mk", "temp_mk"))
        if response is not None:
            out.append(measure.soft_flux(own, soft, response))
            summed = measure.summed_spectra(own, soft, response.where("detector = 'soft'"))
            out.append(spectra.isothermal(summed, IDS).select(*IDS, "t_mk", "t_mk_err_lo", "t_mk_err_hi"))
    if bands is not None:
        out.append(measure.acceleration(own, bands))
        if mode != "HARD":
            total = measure.total_band(bands)
            out.append(timing.neupert(events, total))
            out.append(timing.neupert_lag(events, total).select(*IDS, "best_lag_s", "corr_at_best"))
    if hard is not None and response is not None:
        out.append(measure.hard_flux(own, preferred(hard, ("cdte", "czt")), response, LOW))
        out.append(detect.confirmed(own, confirm_curves(hard, response, mode), config).select(*IDS, "confirmed", "match_score"))
    if response is not None and (soft is not None or hard is not None):
        parts = [measure.band_fluxes(soft, response, 1.0)] if soft is not None else []
        parts += [measure.band_fluxes(hard, response)] if hard is not None else []
        out.append(measure.band_peaks(own, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])))
    curves = vote_curves(soft, hard, response)
    if curves is not None:
        out.append(detect.votes(own, detect.band_events(curves, config), curves.select("date", "band").distinct()))
    return out


def nowcast(config: Config, curve: DataFrame | None = None, soft: DataFrame | None = None, bands: DataFrame | None = None, hard: DataFrame | None = None, response: DataFrame | None = None, mode: str = "COMBINED") -> DataFrame:
    """The catalog of all days. mode: COMBINED, SOFT (hard inputs are ignored) or HARD (detection on the widest hard band).

    curve: (date, t, counts); soft: spectra (date, detector 'soft', t, counts, exposure); bands: (date, e_lo, e_hi, t, ctr);
    hard: spectra of detectors cdte and czt; response: (detector, ch, emid, area), or None for raw counts. Whatever is
    None leaves its columns null. Events are written once, as every measurement reads them.
    """
    if mode not in ("COMBINED", "SOFT", "HARD"):
        raise ValueError("mode must be COMBINED, SOFT or HARD")
    if mode == "SOFT":
        bands = hard = None
    if mode == "HARD":
        soft, curve = None, widest_band(bands)
    events = written(detect.focus_events(series.rebin(curve, config.bin_s), config, flux=True), "events")
    rows = events.drop("flux", "bt")
    for table in measurements(events, config, mode, soft, bands, hard, response):
        rows = rows.join(table, list(IDS), "left")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in MEASURED.items() if c not in rows.columns})
    return projected(judged(rows, config, mode), mode)


def judged(rows: DataFrame, config: Config, mode: str = "COMBINED") -> DataFrame:
    """rows with checks and confidence from events and their measurements."""
    c = F.col
    none = F.lit(None).cast("double")
    ready = rows.withColumns({
        "hard_peak": c("hard_peak_time"), "soft_peak": c("peak"), "temp_offset": c("temp_offset_s"), "temp": c("temp_mk"), "temp_fit": c("t_mk"), "bands": c("n_bands_covered"), "yes": c("votes_yes"), "covered": c("votes_covered"),
        "qpp_soft": none if mode == "HARD" else c("period"), "qpp_hard": c("period") if mode == "HARD" else none, "fred": c("fred_shape_stat"), "excess": c("peak_flux") - c("bg"), "match": c("match_score"),
    })
    return checks.confidence(checks.cross_checks(ready, config), config)


def projected(rows: DataFrame, mode: str = "COMBINED") -> DataFrame:
    """The 57 columns, rounded half to even; a gamma, its error or a period of 0 counts as none."""
    c = F.col
    rounded = lambda name, digits: F.bround(c(name), digits)
    some = lambda name, digits: F.when(c(name) != 0, F.bround(c(name), digits))
    real = c("hard_peak_flux_wm2" if mode == "HARD" else "peak_flux_wm2")
    plain = F.lit("HXR-event") if mode == "HARD" else approx_class(c("ratio"), c("peak_flux"))
    text = lambda name: fixed(c(name), 2)
    made: dict[str, Column] = {
        "event_id": F.format_string(f"%s_{'HXR' if mode == 'HARD' else 'SDD2'}_%03d", "date", c("event_no")),
        "date": c("date"), "start_utc": utc(c("start")), "peak_utc": utc(c("peak")), "end_utc": utc(c("end")), "duration_s": F.bround(c("end") - c("start"), 1),
        "peak_rate": rounded("peak_flux", 2), "background": rounded("bg", 2), "ratio": rounded("ratio", 2), "sigma": rounded("sigma", 1), "data_gap": F.when(c("data_gap"), "YES").otherwise("no"),
        "class_approx": F.when(real.isNotNull(), goes_class(real, "HXR-" if mode == "HARD" else "")).otherwise(plain), "class_is_real_flux": real.isNotNull(),
        "temp_MK": rounded("temp_mk", 1), "temp_MK_err": rounded("temp_mk_err", 2), "temp_MK_fit": rounded("t_mk", 1),
        "temp_MK_fit_err": F.when(c("t_mk").isNotNull(), F.concat(F.lit("-"), text("t_mk_err_lo"), F.lit("/+"), text("t_mk_err_hi"))),
        "hardness_ratio": rounded("hardness", 3), "temp_offset_s": rounded("temp_offset_s", 1), "qpp_period_s": some("period", 1), "gamma": some("gamma", 2), "gamma_err": some("gamma_err", 2), "delta": some("delta", 2),
        "neupert_corr": rounded("corr", 3), "neupert_best_lag_s": c("best_lag_s").cast("double"), "neupert_corr_at_lag": rounded("corr_at_best", 3),
        "radiated_energy_proxy": rounded("energy", 1), "band1_wm2_2p8_20keV": c("band1_wm2"), "band2_wm2_20_60keV": c("band2_wm2"), "band3_wm2_60_150keV": c("band3_wm2"), "dominant_energy_band": c("dominant_band"),
        "n_bands_covered": F.coalesce("n_bands_covered", F.lit(0)), "band_independently_confirmed": c("confirmed"), "cross_band_class_agree": c("agree"),
        "independent_band_votes": F.when(c("votes_covered").isNotNull(), F.concat_ws("/", c("votes_yes").cast("string"), c("votes_covered").cast("string"))),
        "voting_bands": F.when(F.size("voting_bands") > 0, F.array_join("voting_bands", "+")), "check_temp_fit": c("check_temp_fit_agree"), "check_band_vote": c("check_band_vote"),
    }
    return rows.select(*[made.get(n, c(n)).alias(n) for n in COLUMNS])


def event_table(catalog: DataFrame, instrument: str = "SXR+HXR") -> DataFrame:
    """The report's table, brightest first: start, peak, duration, flux, class, band (starred below two bands), instrument.

    The flux is the soft one, where that is 0 or missing the hard one; 0 where one is 0 and the other no more.
    """
    c = F.col
    short = F.when(c("dominant_energy_band").startswith("band1"), "soft (2.8-20)").when(c("dominant_energy_band").startswith("band2"), "medium (20-60)").when(c("dominant_energy_band").startswith("band3"), "hard (60-150)")
    band = F.coalesce(F.concat(short, F.when(c("n_bands_covered") < 2, "*").otherwise("")), F.lit("-"))
    flux = F.coalesce(F.when(c("peak_flux_wm2") != 0, c("peak_flux_wm2")), F.when(c("hard_peak_flux_wm2") != 0, c("hard_peak_flux_wm2")), c("peak_flux_wm2"), c("hard_peak_flux_wm2"))
    return catalog.orderBy(F.desc("peak_rate"), "event_id").select(
        "event_id", F.substring("start_utc", 12, 8).alias("start"), F.substring("peak_utc", 12, 8).alias("peak"), F.concat(fixed(c("duration_s") / 60, 1), F.lit(" min")).alias("duration"),
        F.when(flux.isNotNull(), F.format_string("%.2e", flux)).otherwise("-").alias("flux"), c("class_approx").alias("class"), band.alias("band"), F.lit(instrument).alias("instrument"),
    )


def summary(catalog: DataFrame) -> DataFrame:
    """One row: events, gaps and those with several bands."""
    return catalog.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("data_gap") == "YES").alias("gaps"), F.count_if(F.col("n_bands_covered") >= 2).alias("multi_band"))


def zoom(binned: DataFrame, events: DataFrame, bin_s: float) -> DataFrame:
    """Bins around each day's biggest event, half its length (six bins at least) on both sides, with hours since the day's first bin."""
    big = events.groupBy("date").agg(F.max_by(F.struct("s", "e"), F.struct("peak_flux", -F.col("s"))).alias("x")).select("date", "x.s", "x.e")
    pad = F.greatest(F.floor((F.col("e") - F.col("s")) / 2), F.lit(6))
    start = binned.groupBy("date").agg(F.min("bt").alias("t0"))
    met = binned.join(F.broadcast(big), "date").where((F.col("k") >= F.col("s") - pad) & (F.col("k") <= F.col("e") + pad)).join(F.broadcast(start), "date")
    return met.select("date", "k", "bt", "flux", ((F.col("bt") - F.col("t0")) / 3600).alias("hours"))
