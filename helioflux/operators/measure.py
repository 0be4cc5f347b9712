"""Measurements of events from spectra and band curves, each a table keyed by the event.

Spectra are rows (date, detector, t, counts array, exposure). A response (detector, ch, emid, area) is a few hundred
rows a detector; its weights are one array a detector and broadcast. A spectrum is reduced to a few numbers a row
before it meets events, so no channel is ever a row of its own in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CM2_TO_M2, KEV_PER_MK, KEV_TO_JOULE
from ..functions.scalar import channel_kev
from .intervals import interval_join, nearest
from .spectra import power_law

IDS = ("date", "event_no")
#: Bands of the soft instrument and canonical bands, in keV
SOFT_BANDS = {"a": (2.8, 6.0), "b": (6.0, 12.0), "c": (12.0, 22.0)}
CANONICAL = {"band1": (2.8, 20.0), "band2": (20.0, 60.0), "band3": (60.0, 150.0)}
LABELS = {"band1": "band1 (2.8-20 keV, soft)", "band2": "band2 (20-60 keV, medium)", "band3": "band3 (60-150 keV, hard)"}
BUCKET = 3600.0


def dot(values: Column, weights: Column) -> Column:
    """Sum of products of two arrays; what is null, or beyond the shorter one, counts as 0."""
    return F.aggregate(F.zip_with(values, weights, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)


def weights(response: DataFrame, **of: Column) -> DataFrame:
    """(detector, an array by channel for each named expression over emid and area)."""
    row = F.struct("ch", *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(n) for n, x in of.items()])
    held = response.groupBy("detector").agg(F.array_sort(F.collect_list(row)).alias("_r"))
    return held.select("detector", *[_field(n) for n in of])


def _field(name: str) -> Column:
    return F.transform("_r", lambda r: r[name]).alias(name)


def within(lo: float, hi: float | None = None, closed: bool = False) -> Column:
    """Channels of energy lo <= emid < hi, or <= hi if closed; no hi: all above."""
    e = F.col("emid")
    return (e >= lo) if hi is None else ((e >= lo) & ((e <= hi) if closed else (e < hi)))


def flux_weight(lo: Column | float, hi: float | None = None) -> Column:
    """Joules per square centimetre of one count in a channel between lo and hi keV; 0 outside and where the area is 0."""
    inside = (F.col("emid") >= lo) & (F.col("area") > 0)
    if hi is not None:
        inside = inside & (F.col("emid") <= hi)
    return F.when(inside, F.col("emid") * KEV_TO_JOULE / F.col("area")).otherwise(0.0)


def plain_response(channels: int = 340, detector: str = "soft") -> Column:
    """Rows of a response without calibration, to explode: channel energies and an area of 1."""
    ch = F.sequence(F.lit(0), F.lit(channels - 1))
    return F.explode(F.transform(ch, lambda c: F.struct(F.lit(detector).alias("detector"), c.alias("ch"), channel_kev(c).alias("emid"), F.lit(1.0).alias("area"))))


def reduced(spectra: DataFrame, response: DataFrame, **of: Column) -> DataFrame:
    """(date, detector, t, exposure, one number a row for each named weight)."""
    met = spectra.join(F.broadcast(weights(response, **of).withColumnsRenamed({n: f"_{n}" for n in of})), "detector")
    return met.select("date", "detector", "t", "exposure", *[dot(F.col("counts"), F.col(f"_{n}")).alias(n) for n in of])


def fluxes(rows: DataFrame, raw: str, name: str, exposure: Column | None = None) -> DataFrame:
    """Adds W/m2 of raw = sum of counts times flux_weight; NaN reads as 0."""
    by = F.col("exposure") if exposure is None else exposure
    return rows.withColumn(name, F.coalesce(F.nanvl(F.col(raw) / by / CM2_TO_M2, F.lit(0.0)), F.lit(0.0)))


def band_counts(spectra: DataFrame, response: DataFrame, bands: dict[str, tuple[float, float]], calibrated: bool = False) -> DataFrame:
    """Counts in energy bands of each spectrum, and as n_* their variances; calibrated: counts over area."""
    over = F.when(F.col("area") > 0, 1 / F.col("area")) if calibrated else F.lit(1.0)
    of = {}
    for n, (lo, hi) in bands.items():
        of[n] = F.when(within(lo, hi), over)
        of[f"n_{n}"] = F.when(within(lo, hi), over * over)
    return reduced(spectra, response, **of)


def temperature_curve(counts: DataFrame) -> DataFrame:
    """band_counts rows with ratio, kt and t_mk of the two-band proxy: the slope between the bands' middles."""
    (a0, a1), (b0, b1) = SOFT_BANDS["a"], SOFT_BANDS["b"]
    da, db = F.greatest(F.col("a") / (a1 - a0), F.lit(1e-6)), F.greatest(F.col("b") / (b1 - b0), F.lit(1e-6))
    apart = (b0 + b1 - a0 - a1) / 2
    kt = F.least(F.lit(5.0), F.greatest(F.lit(0.05), apart / F.ln(F.greatest(da / db, F.lit(1.0000001)))))
    return counts.withColumns({"ratio": db / da, "kt": kt, "t_mk": kt / KEV_PER_MK})


def temperature(events: DataFrame, counts: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, temp_mk, temp_mk_err, hardness, temp_offset_s) of events with at least three spectra.

    The offset is from the flux peak to the first largest ratio; the error is that of the hottest spectrum.
    """
    apart = (sum(SOFT_BANDS["b"]) - sum(SOFT_BANDS["a"])) / 2
    hit = interval_join(events.select(*ids, "start", "peak", "end"), temperature_curve(counts), F.col("start"), F.col("end"), BUCKET)
    hot = F.min_by(F.struct("a", "b", "n_a", "n_b", "kt"), F.struct(-F.col("t_mk"), F.col("t"))).alias("hot")
    out = hit.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), F.max("t_mk").alias("temp_mk"), F.max("ratio").alias("hardness"), F.min_by("t", F.struct(-F.col("ratio"), F.col("t"))).alias("at"), F.first("peak").alias("peak"), hot)
    h = F.col("hot")
    spread = F.sqrt(F.greatest(h["n_a"], F.lit(0.0)) / (h["a"] * h["a"]) + F.greatest(h["n_b"], F.lit(0.0)) / (h["b"] * h["b"]))
    error = F.when((h["a"] > 0) & (h["b"] > 0), h["kt"] * h["kt"] / apart * spread / KEV_PER_MK)
    return out.where("n >= 3").select(*ids, "temp_mk", error.alias("temp_mk_err"), "hardness", (F.col("at") - F.col("peak")).alias("temp_offset_s"))


def event_flux(events: DataFrame, rows: DataFrame, lookback: float, least: int, step: float, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, peak_flux, bg_flux, energy, peak_t) from rows (date, t, raw, exposure) of one instrument.

    The background is the mean spectrum of the ``lookback`` seconds before the event over its median exposure, 0 with
    fewer than ``least`` spectra. Energy sums what is above it, times the median step between spectra (``step`` if
    there is none). Events without a spectrum have no row.
    """
    own = events.select(*ids, "start", "end")
    before = interval_join(own, rows, F.col("start") - lookback, F.col("start"), BUCKET).where("t < start")
    bg = before.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), (F.avg("raw") / F.percentile("exposure", 0.5) / CM2_TO_M2).alias("bg"))
    bg = bg.where(F.col("n") >= least).select(*ids, "bg")
    hit = fluxes(interval_join(own, rows, F.col("start"), F.col("end"), BUCKET), "raw", "flux")
    hit = hit.withColumn("_dt", F.col("t") - F.lag("t").over(Window.partitionBy(*ids).orderBy("t")))
    hit = hit.join(bg, list(ids), "left").withColumn("bg", F.coalesce("bg", F.lit(0.0)))
    out = hit.groupBy(*ids).agg(F.max("flux").alias("peak_flux"), F.first("bg").alias("bg_flux"), F.sum(F.greatest(F.col("flux") - F.col("bg"), F.lit(0.0))).alias("sum"), F.percentile("_dt", 0.5).alias("dt"), F.min_by("t", F.struct(-F.col("flux"), F.col("t"))).alias("peak_t"))
    dt = F.when(F.col("dt") > 0, F.col("dt")).otherwise(F.lit(step))
    return out.select(*ids, "peak_flux", "bg_flux", (F.col("sum") * dt).alias("energy"), "peak_t")


def flux_error(raw_variance: Column, exposure: Column) -> Column:
    """One standard deviation in W/m2 of a flux, from the sum of counts times squared weights."""
    return F.sqrt(F.greatest(raw_variance, F.lit(0.0))) / exposure / CM2_TO_M2


def soft_flux(events: DataFrame, spectra: DataFrame, response: DataFrame, low: float = 2.8, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, peak_flux_wm2, peak_flux_wm2_err, bg_flux_wm2, radiated_energy_jm2) of the soft instrument, exposures of 1 s.

    The error is that of the spectrum within 20 s of the flux peak, from 2.8 to 20 keV.
    """
    error = F.when(flux_weight(2.8, 20.0) > 0, flux_weight(2.8, 20.0) * flux_weight(2.8, 20.0))
    rows = reduced(spectra, response, raw=flux_weight(low), raw_err=error).withColumn("exposure", F.lit(1.0))
    out = event_flux(events, rows.select("date", "t", "raw", "exposure"), 120.0, 5, 1.0, ids)
    near = nearest(events, rows.select("date", "t", "raw_err"), "peak", 20.0, ids)
    out = out.join(near, list(ids), "left").withColumn("err", flux_error(F.col("near.raw_err"), F.lit(1.0)))
    return out.select(*ids, F.col("peak_flux").alias("peak_flux_wm2"), F.col("err").alias("peak_flux_wm2_err"), F.col("bg_flux").alias("bg_flux_wm2"), F.col("energy").alias("radiated_energy_jm2"))


def hard_flux(events: DataFrame, spectra: DataFrame, response: DataFrame, low: dict[str, float], ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, hard_peak_flux_wm2, .._err, hard_bg_flux_wm2, hard_energy_jm2) of one hard detector's spectra.

    low: each detector's lowest usable energy. The error is that of the spectrum the peak was read from.
    """
    floor = F.lit(9.5)
    for detector, e in low.items():
        floor = F.when(F.col("detector") == detector, e).otherwise(floor)
    w = flux_weight(floor)
    rows = reduced(spectra, response, raw=w, raw_err=w * w)
    out = event_flux(events, rows.select("date", "t", "raw", "exposure"), 600.0, 3, 20.0, ids)
    at = rows.select("date", F.col("t").alias("peak_t"), F.when(F.col("exposure") > 0, F.col("exposure")).otherwise(20.0).alias("exposure"), "raw_err")
    at = at.groupBy("date", "peak_t").agg(F.first("raw_err").alias("raw_err"), F.first("exposure").alias("exposure"))
    out = out.join(at, ["date", "peak_t"], "left").withColumn("err", flux_error(F.col("raw_err"), F.col("exposure")))
    return out.select(*ids, F.col("peak_flux").alias("hard_peak_flux_wm2"), F.col("err").alias("hard_peak_flux_wm2_err"), F.col("bg_flux").alias("hard_bg_flux_wm2"), F.col("energy").alias("hard_energy_jm2"))


def band_fluxes(spectra: DataFrame, response: DataFrame, default_exposure: float | None = None) -> DataFrame:
    """(date, detector, t, band1, band2, band3) in W/m2; spectra share the day's median exposure of their detector."""
    rows = reduced(spectra, response, **{n: flux_weight(lo, hi) for n, (lo, hi) in CANONICAL.items()})
    if default_exposure is None:
        middle = rows.groupBy("date", "detector").agg(F.percentile("exposure", 0.5).alias("_x"))
        rows = rows.join(middle, ["date", "detector"])
    else:
        rows = rows.withColumn("_x", F.lit(default_exposure))
    for n in CANONICAL:
        rows = fluxes(rows, n, n, F.col("_x"))
    return rows.select("date", "detector", "t", *CANONICAL)


def band_peaks(events: DataFrame, fluxes_: DataFrame, sources: dict[str, tuple[str, ...]] | None = None, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, band1_wm2, band2_wm2, band3_wm2, dominant_band, n_bands_covered, agree).

    A band's peak comes from the first of its sources with a spectrum in the event: soft for band 1, czt then cdte for
    band 2, czt for band 3. agree: whether the classes of bands with flux lie at most one letter apart; null below two.
    """
    sources = sources or {"band1": ("soft",), "band2": ("czt", "cdte"), "band3": ("czt",)}
    hit = interval_join(events.select(*ids, "start", "end"), fluxes_, F.col("start"), F.col("end"), BUCKET)
    tops = [F.max(F.when(F.col("detector") == d, F.col(n))).alias(f"{n}_{d}") for n, from_ in sources.items() for d in from_]
    got = events.select(*ids).join(hit.groupBy(*ids).agg(*tops), list(ids), "left")
    out = got.select(*ids, *[F.coalesce(*[F.col(f"{n}_{d}") for d in from_]).alias(f"{n}_wm2") for n, from_ in sources.items()])
    lit = [F.when(F.col(f"{n}_wm2") > 0, F.struct(F.col(f"{n}_wm2").alias("flux"), F.lit(-i).alias("first"), F.lit(LABELS[n]).alias("label"))) for i, n in enumerate(CANONICAL)]
    valid = F.filter(F.array(*lit), lambda x: x.isNotNull())
    letters = [F.when(F.col(f"{n}_wm2") >= 1e-8, F.floor(F.least(F.log10(F.col(f"{n}_wm2")) + 1e-12, F.lit(-4.0)))) for n in CANONICAL]
    steps = F.filter(F.array(*letters), lambda x: x.isNotNull())
    return out.select("*", F.array_max(valid)["label"].alias("dominant_band"), F.size(valid).alias("n_bands_covered"), F.when((F.size(valid) >= 2) & (F.size(steps) >= 2), F.array_max(steps) - F.array_min(steps) <= 1).alias("agree"))


def acceleration(events: DataFrame, bands: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, gamma, gamma_err, delta, hard_peak_time) from band curves (date, e_lo, e_hi, t, ctr).

    A power law through the mean rates per keV of bands from 20 keV on with at least two samples in the event; the peak
    is the first largest rate of the total band (from 2 keV or less to 80 or more; of several the widest).
    """
    hit = interval_join(events.select(*ids, "start", "end"), bands, F.col("start"), F.col("end"), BUCKET)
    by = hit.groupBy(*ids, "e_lo", "e_hi").agg(F.count(F.lit(1)).alias("n"), F.avg("ctr").alias("rate"), F.min_by("t", F.struct(-F.col("ctr"), F.col("t"))).alias("peak")).where("n >= 2")
    width = F.greatest(F.col("e_hi") - F.col("e_lo"), F.lit(1e-3))
    rates = by.where("e_lo >= 20 and rate > 0").select(*ids, ((F.col("e_lo") + F.col("e_hi")) / 2).alias("e"), (F.col("rate") / width).alias("rate"))
    total = by.where("e_lo <= 2 and e_hi >= 80").groupBy(*ids).agg(F.max_by("peak", F.struct(width, F.col("e_lo"))).alias("hard_peak_time"))
    return events.select(*ids).join(power_law(rates, ids).drop("n"), list(ids), "left").join(total, list(ids), "left")


def window_gamma(windows: DataFrame, bands: DataFrame, ids: tuple[str, ...], start: Column, end: Column) -> DataFrame:
    """(ids, gamma): the photon index of bands from 20 keV on with at least two samples in [start, end]; null outside (0.5, 12)."""
    hit = interval_join(windows.select(*ids, start.alias("_from"), end.alias("_to")), bands.where("e_lo >= 20"), F.col("_from"), F.col("_to"), BUCKET)
    by = hit.groupBy(*ids, "e_lo", "e_hi").agg(F.count(F.lit(1)).alias("n"), F.avg("ctr").alias("rate")).where("n >= 2 and rate > 0")
    rates = by.select(*ids, ((F.col("e_lo") + F.col("e_hi")) / 2).alias("e"), (F.col("rate") / F.greatest(F.col("e_hi") - F.col("e_lo"), F.lit(1e-3))).alias("rate"))
    return power_law(rates, ids, 0.5, 12.0).where("gamma is not null").select(*ids, "gamma")


def slices(events: DataFrame, spectra: DataFrame, response: DataFrame, low: dict[str, float], n_slices: int = 5, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, t, gamma, gamma_err, delta, intercept): a power law at up to five spectra spread evenly over each event.

    Channels from the detector's lowest energy on with counts, over their area; at least five, and an index in (0.5, 12).
    Only the chosen spectra become rows by channel.
    """
    hit = interval_join(events.select(*ids, "start", "end"), spectra, F.col("start"), F.col("end"), BUCKET)
    w = Window.partitionBy(*ids)
    hit = hit.withColumns({"_i": F.row_number().over(w.orderBy("t")) - 1, "_n": F.count(F.lit(1)).over(w)}).where("_n >= 2")
    m = F.least(F.col("_n"), F.lit(n_slices))
    wanted = F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.floor(j * (F.col("_n") - 1) / (m - 1) + 1e-9))
    chosen = hit.where(F.array_contains(wanted, F.col("_i")))
    rows = chosen.select(*ids, "t", "detector", F.posexplode("counts").alias("ch", "c")).join(F.broadcast(response), ["detector", "ch"])
    floor = F.lit(9.5)
    for detector, e in low.items():
        floor = F.when(F.col("detector") == detector, e).otherwise(floor)
    x, y = F.log10("emid"), F.log10(F.col("c") / F.col("area"))
    fits = rows.where((F.col("emid") >= floor) & (F.col("area") > 0) & (F.col("c") > 0)).groupBy(*ids, "t").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx"))
    error = F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.0)) * F.col("syy") / F.col("sxx") / (F.col("n") - 2))
    return fits.where("n >= 5 and -s > 0.5 and -s < 12").select(*ids, "t", (-F.col("s")).alias("gamma"), F.when(error > 0, error).alias("gamma_err"), (1 - F.col("s")).alias("delta"), "intercept")


def total_band(bands: DataFrame) -> DataFrame:
    """Samples (date, t, y) of each day's total band: from 2 keV or less to 80 or more if there is one, else the widest."""
    kinds = bands.select("date", "e_lo", "e_hi").distinct()
    whole = (F.col("e_lo") <= 2) & (F.col("e_hi") >= 80)
    best = kinds.groupBy("date").agg(F.max(F.struct(whole.alias("whole"), (F.col("e_hi") - F.col("e_lo")).alias("width"), "e_lo", "e_hi")).alias("x")).select("date", "x.e_lo", "x.e_hi")
    return bands.join(best, ["date", "e_lo", "e_hi"]).select("date", "t", F.col("ctr").alias("y"))


def summed_spectra(events: DataFrame, spectra: DataFrame, response: DataFrame, low: float = 2.8, high: float = 12.0, ids: tuple[str, ...] = IDS) -> DataFrame:
    """(ids, e, counts, area, width) of channels from low to high keV, counts summed over each event: what ``isothermal`` fits."""
    w = Window.partitionBy("detector").orderBy("ch")
    up, down = F.lead("emid").over(w), F.lag("emid").over(w)
    width = F.coalesce((up - down) / 2, up - F.col("emid"), F.col("emid") - down)
    some = response.withColumn("width", width).where((F.col("emid") >= low) & (F.col("emid") <= high))
    hit = interval_join(events.select(*ids, "start", "end"), spectra, F.col("start"), F.col("end"), BUCKET)
    sums = hit.select(*ids, "detector", F.posexplode("counts").alias("ch", "c")).groupBy(*ids, "detector", "ch").agg(F.sum("c").alias("counts"))
    return sums.join(F.broadcast(some), ["detector", "ch"]).select(*ids, F.col("emid").alias("e"), "counts", "area", "width")
