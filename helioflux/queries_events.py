"""Queries of event measurements, votes and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as catalogs
from .config import STAND_IN
from .functions import scalar
from .operators import detect, intervals, measure, series, spectra, timing
from .registry import CATALOG, LC, READY, binned, catalog, curve, query, r, table
from .sources import instruments

# Stand-ins of spectra: embeddings, a row a second, alternately of two hard detectors; twelve events over them.
SPEC = """sp AS (SELECT '2024' AS date, CAST(vec_id AS DOUBLE) AS t, (vec_id // 25) % 2 AS d, 20.0 + vec_id % 3 AS x, embedding FROM embeddings),
cs AS (SELECT date, t, d, x, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS ch FROM sp),
cc AS (SELECT date, t, d, x, ch, abs(CAST(v AS DOUBLE)) * 100 AS n, 0.4 * (ch + 1) AS es, 2.5 * (ch + 1) AS eh, 1 + ch / 64.0 AS area FROM cs),
se AS (SELECT '2024' AS date, CAST(i AS INTEGER) AS event_no, 40.0 * i - 20 AS start, 40.0 * i - 14 AS peak, 40.0 * i - 5 AS "end" FROM range(1, 13) q(i))"""
KEV = "1.602176634e-16"


def soft(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("2024").alias("date"), F.lit("soft").alias("detector"), F.col("vec_id").cast("double").alias("t"), F.transform("embedding", lambda v: F.abs(v.cast("double")) * 100).alias("counts"), F.lit(1.0).alias("exposure"))


def hard(spark, sf_dir):
    block = F.floor(F.col("t") / 25).cast("long") % 2
    return soft(spark, sf_dir).withColumns({"detector": F.when(block == 0, "cdte").otherwise("czt"), "exposure": 20.0 + F.col("t").cast("long") % 3})


def response(spark):
    rows = [(d, ch, step * (ch + 1), 1 + ch / 64.0) for d, step in (("soft", 0.4), ("cdte", 2.5), ("czt", 2.5)) for ch in range(64)]
    return spark.createDataFrame(rows, "detector string, ch int, emid double, area double")


def spec_events(spark):
    i = F.col("id")
    return spark.range(1, 13).select(F.lit("2024").alias("date"), i.cast("int").alias("event_no"), (40.0 * i - 20).alias("start"), (40.0 * i - 14).alias("peak"), (40.0 * i - 5).alias("end"))


#: Energy limits that stand in for the kinds of events, keV
LIMITS = {"click": (20.0, 30.0), "view": (1.8, 90.0), "purchase": (30.0, 40.0), "signup": (40.0, 60.0), "error": (60.0, 80.0)}
BANDS = f"lim(kind, e_lo, e_hi) AS (VALUES {', '.join(f"('{k}', {a}, {b})" for k, (a, b) in LIMITS.items())}), bc AS (SELECT lc.date, lc.kind, e_lo, e_hi, t, counts AS ctr FROM lc JOIN lim ON lim.kind = lc.kind)"


def band_curves(spark, sf_dir):
    limits = spark.createDataFrame([(k, a, b) for k, (a, b) in LIMITS.items()], "kind string, e_lo double, e_hi double")
    return curve(spark, sf_dir).join(F.broadcast(limits), "kind").select("date", "kind", "e_lo", "e_hi", "t", F.col("counts").alias("ctr"))


@query(f"""WITH {SPEC}, ab AS (SELECT date, t, sum(CASE WHEN es >= 2.8 AND es < 6 THEN n / area ELSE 0 END) AS a, sum(CASE WHEN es >= 6 AND es < 12 THEN n / area ELSE 0 END) AS b,
 sum(CASE WHEN es >= 2.8 AND es < 6 THEN n / (area * area) ELSE 0 END) AS va, sum(CASE WHEN es >= 6 AND es < 12 THEN n / (area * area) ELSE 0 END) AS vb FROM cc GROUP BY date, t),
kt AS (SELECT *, (b / 6) / (a / 3.2) AS ratio, least(5.0, greatest(0.05, 4.6 / ln(greatest((a / 3.2) / (b / 6), 1.0000001)))) AS k FROM ab),
j AS (SELECT se.event_no, se.peak, kt.*, row_number() OVER (PARTITION BY event_no ORDER BY k DESC, t) AS hot, row_number() OVER (PARTITION BY event_no ORDER BY ratio DESC, t) AS best, count(*) OVER (PARTITION BY event_no) AS n FROM se JOIN kt ON kt.t BETWEEN se.start AND se."end")
SELECT event_no, round(max(k) / 0.08617, 5) AS temp_mk, round(max(CASE WHEN hot = 1 THEN k * k / 4.6 * sqrt(va / (a * a) + vb / (b * b)) / 0.08617 END), 5) AS temp_mk_err, round(max(ratio), 6) AS hardness, max(CASE WHEN best = 1 THEN t - peak END) AS temp_offset_s FROM j WHERE n >= 3 GROUP BY event_no""")
def two_band_temperature(spark, sf_dir):
    counts = measure.band_counts(soft(spark, sf_dir), response(spark), {n: measure.SOFT_BANDS[n] for n in ("a", "b")}, True)
    out = measure.temperature(spec_events(spark), counts)
    return out.select("event_no", *r("temp_mk", "temp_mk_err", digits=5), *r("hardness"), "temp_offset_s")


@query(f"""WITH {SPEC}, f AS (SELECT t, sum(CASE WHEN es >= 2.8 THEN n * es * {KEV} / area ELSE 0 END) / 1e-4 AS flux, sum(CASE WHEN es >= 2.8 AND es <= 20 THEN n * power(es * {KEV} / area, 2) ELSE 0 END) AS v FROM cc GROUP BY t),
g AS (SELECT event_no, count(*) AS n, avg(flux) AS bg FROM se JOIN f ON f.t >= se.start - 120 AND f.t < se.start GROUP BY event_no),
j AS (SELECT se.event_no, f.t, flux, CASE WHEN g.n >= 5 THEN bg ELSE 0 END AS bg, t - lag(t) OVER (PARTITION BY se.event_no ORDER BY t) AS dt FROM se LEFT JOIN g ON g.event_no = se.event_no JOIN f ON f.t BETWEEN se.start AND se."end"),
e AS (SELECT event_no, sqrt(v) / 1e-4 AS err, row_number() OVER (PARTITION BY event_no ORDER BY abs(t - peak), t) AS rk FROM se JOIN f ON abs(f.t - se.peak) < 20)
SELECT j.event_no, round(max(flux) * 1e9, 5) AS peak_flux_nw, round(max(err) * 1e9, 5) AS err_nw, round(max(coalesce(bg, 0)) * 1e9, 5) AS bg_nw, round(sum(greatest(flux - coalesce(bg, 0), 0)) * quantile_cont(dt, 0.5) * 1e9, 4) AS energy_nj FROM j LEFT JOIN (SELECT * FROM e WHERE rk = 1) e ON e.event_no = j.event_no GROUP BY j.event_no""")
def soft_flux_events(spark, sf_dir):
    out = measure.soft_flux(spec_events(spark), soft(spark, sf_dir), response(spark))
    nano = lambda c, name, digits=5: F.round(F.col(c) * 1e9, digits).alias(name)
    return out.select("event_no", nano("peak_flux_wm2", "peak_flux_nw"), nano("peak_flux_wm2_err", "err_nw"), nano("bg_flux_wm2", "bg_nw"), nano("radiated_energy_jm2", "energy_nj", 4))


@query(f"""WITH {SPEC}, f AS (SELECT t, max(x) AS x, sum(CASE WHEN eh >= 9.5 THEN n * eh * {KEV} / area ELSE 0 END) AS raw, sum(CASE WHEN eh >= 9.5 THEN n * power(eh * {KEV} / area, 2) ELSE 0 END) AS v FROM cc WHERE d = 0 GROUP BY t),
g AS (SELECT event_no, count(*) AS n, avg(raw) / quantile_cont(x, 0.5) / 1e-4 AS bg FROM se JOIN f ON f.t >= se.start - 600 AND f.t < se.start GROUP BY event_no),
j AS (SELECT se.event_no, f.t, x, v, raw / x / 1e-4 AS flux, CASE WHEN g.n >= 3 THEN bg ELSE 0 END AS bg, t - lag(t) OVER (PARTITION BY se.event_no ORDER BY t) AS dt, row_number() OVER (PARTITION BY se.event_no ORDER BY raw / x DESC, t) AS rk FROM se LEFT JOIN g ON g.event_no = se.event_no JOIN f ON f.t BETWEEN se.start AND se."end")
SELECT event_no, round(max(flux) * 1e9, 5) AS peak_flux_nw, round(max(CASE WHEN rk = 1 THEN sqrt(v) / x / 1e-4 END) * 1e9, 5) AS err_nw, round(max(coalesce(bg, 0)) * 1e9, 5) AS bg_nw, round(sum(greatest(flux - coalesce(bg, 0), 0)) * coalesce(quantile_cont(dt, 0.5), 20) * 1e9, 4) AS energy_nj FROM j GROUP BY event_no""")
def hard_flux_events(spark, sf_dir):
    out = measure.hard_flux(spec_events(spark), catalogs.preferred(hard(spark, sf_dir), ("cdte", "czt")), response(spark), catalogs.LOW)
    nano = lambda c, name, digits=5: F.round(F.col(c) * 1e9, digits).alias(name)
    return out.select("event_no", nano("hard_peak_flux_wm2", "peak_flux_nw"), nano("hard_peak_flux_wm2_err", "err_nw"), nano("hard_bg_flux_wm2", "bg_nw"), nano("hard_energy_jm2", "energy_nj", 4))


@query(f"""WITH {SPEC}, x AS (SELECT d, quantile_cont(x, 0.5) AS x FROM sp GROUP BY d),
s1 AS (SELECT t, sum(CASE WHEN es >= 2.8 AND es <= 20 THEN n * es * {KEV} / area ELSE 0 END) / 1e-4 AS b1 FROM cc GROUP BY t),
h AS (SELECT cc.t, cc.d, sum(CASE WHEN eh >= 20 AND eh <= 60 THEN n * eh * {KEV} / area ELSE 0 END) / max(x.x) / 1e-4 AS b2, sum(CASE WHEN eh >= 60 AND eh <= 150 THEN n * eh * {KEV} / area ELSE 0 END) / max(x.x) / 1e-4 AS b3 FROM cc JOIN x ON x.d = cc.d GROUP BY cc.t, cc.d),
p1 AS (SELECT event_no, max(b1) AS b1 FROM se JOIN s1 ON s1.t BETWEEN se.start AND se."end" GROUP BY event_no),
p2 AS (SELECT event_no, coalesce(max(CASE WHEN d = 1 THEN b2 END), max(CASE WHEN d = 0 THEN b2 END)) AS b2, max(CASE WHEN d = 1 THEN b3 END) AS b3 FROM se JOIN h ON h.t BETWEEN se.start AND se."end" GROUP BY event_no),
q AS (SELECT se.event_no, b1, b2, b3 FROM se LEFT JOIN p1 ON p1.event_no = se.event_no LEFT JOIN p2 ON p2.event_no = se.event_no),
z AS (SELECT event_no, b1, b2, b3, list_filter([b1, b2, b3], lambda v: v > 0) AS ok, list_filter(list_transform([b1, b2, b3], lambda v: CASE WHEN v >= 1e-4 THEN 5 WHEN v >= 1e-5 THEN 4 WHEN v >= 1e-6 THEN 3 WHEN v >= 1e-7 THEN 2 WHEN v >= 1e-8 THEN 1 END), lambda v: v IS NOT NULL) AS tiers FROM q)
SELECT event_no, round(b1 * 1e9, 5) AS b1, round(b2 * 1e9, 5) AS b2, round(b3 * 1e9, 5) AS b3, CASE list_max(ok) WHEN b1 THEN 'band1 (2.8-20 keV, soft)' WHEN b2 THEN 'band2 (20-60 keV, medium)' WHEN b3 THEN 'band3 (60-150 keV, hard)' END AS dominant_band, CAST(len(ok) AS INTEGER) AS n_bands_covered, CASE WHEN len(ok) >= 2 AND len(tiers) >= 2 THEN list_max(tiers) - list_min(tiers) <= 1 END AS agree FROM z""")
def band_peak_flux(spark, sf_dir):
    fluxes = measure.band_fluxes(soft(spark, sf_dir), response(spark), 1.0).unionByName(measure.band_fluxes(hard(spark, sf_dir), response(spark)))
    out = measure.band_peaks(spec_events(spark), fluxes)
    return out.select("event_no", *[F.round(F.col(f"band{i}_wm2") * 1e9, 5).alias(f"b{i}") for i in (1, 2, 3)], "dominant_band", "n_bands_covered", "agree")


@query(f"""WITH {SPEC}, j AS (SELECT se.event_no, sp.t, row_number() OVER (PARTITION BY event_no ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY event_no) AS n FROM se JOIN sp ON sp.d = 0 AND sp.t BETWEEN se.start AND se."end"),
k AS (SELECT event_no, t FROM j WHERE n >= 2 AND list_contains(list_transform(range(0, least(n, 5)), lambda q: CAST(floor(q * (n - 1) / CAST(least(n, 5) - 1 AS DOUBLE) + 1e-9) AS BIGINT)), i)),
f AS (SELECT k.event_no, k.t, count(*) AS n, regr_slope(log10(cc.n / area), log10(eh)) AS s, regr_intercept(log10(cc.n / area), log10(eh)) AS b, regr_r2(log10(cc.n / area), log10(eh)) AS r2, regr_syy(log10(cc.n / area), log10(eh)) AS syy, regr_sxx(log10(cc.n / area), log10(eh)) AS sxx FROM k JOIN cc ON cc.t = k.t WHERE eh >= 9.5 AND cc.n > 0 GROUP BY k.event_no, k.t)
SELECT event_no, t, round(-s, 5) AS gamma, round(sqrt(greatest(1 - r2, 0) * syy / sxx / (n - 2)), 5) AS gamma_err, round(b, 5) AS intercept FROM f WHERE n >= 5 AND -s > 0.5 AND -s < 12""")
def slice_powerlaw(spark, sf_dir):
    out = measure.slices(spec_events(spark), catalogs.preferred(hard(spark, sf_dir), ("cdte",)), response(spark), catalogs.LOW)
    return out.select("event_no", "t", *r("gamma", "gamma_err", "intercept", digits=5))


@query(f"""WITH {SPEC}, b AS (SELECT date, CAST(floor(t / 30) AS BIGINT) AS k, ch, sum(n) AS n FROM cc GROUP BY ALL), c AS (SELECT date, CAST(floor(t / 30) AS BIGINT) AS k, count(*) AS cnt FROM sp GROUP BY ALL)
SELECT b.date, b.k, cnt, round(sum(n), 3) AS total, round(max(CASE WHEN ch = 7 THEN n END), 4) AS eighth FROM b JOIN c ON c.date = b.date AND c.k = b.k GROUP BY b.date, b.k, cnt""")
def spectrogram_rebin(spark, sf_dir):
    rows = soft(spark, sf_dir)
    grid = series.rebin(rows.select("date", "t", F.lit(1.0).alias("counts")), 30.0)
    out = series.rebin_vectors(rows, grid, 30.0)
    return out.select("date", "k", "cnt", F.round(F.aggregate("counts", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.round(F.element_at("counts", 8), 4).alias("eighth"))


@query(f"""WITH {CATALOG}, {BANDS}, mb AS (SELECT ev.date, event_no, e_lo, e_hi, count(*) AS n, avg(ctr) AS rate FROM ev JOIN bc ON bc.date = ev.date AND bc.t BETWEEN ev.start AND ev."end" GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT date, event_no, count(*) AS n, -regr_slope(log10(rate / (e_hi - e_lo)), log10((e_lo + e_hi) / 2)) AS g, regr_r2(log10(rate / (e_hi - e_lo)), log10((e_lo + e_hi) / 2)) AS r2, regr_syy(log10(rate / (e_hi - e_lo)), log10((e_lo + e_hi) / 2)) AS syy, regr_sxx(log10(rate / (e_hi - e_lo)), log10((e_lo + e_hi) / 2)) AS sxx FROM mb WHERE e_lo >= 20 AND rate > 0 GROUP BY date, event_no),
h AS (SELECT ev.date, ev.event_no, bc.t, row_number() OVER (PARTITION BY ev.date, ev.event_no ORDER BY ctr DESC, t) AS rk, count(*) OVER (PARTITION BY ev.date, ev.event_no) AS n FROM ev JOIN bc ON bc.date = ev.date AND bc.t BETWEEN ev.start AND ev."end" WHERE e_lo <= 2 AND e_hi >= 80)
SELECT ev.date, ev.event_no, round(CASE WHEN f.n >= 2 AND g > 1 AND g < 10 THEN g END, 5) AS gamma, round(CASE WHEN f.n > 2 AND g > 1 AND g < 10 THEN sqrt(greatest(1 - r2, 0) * syy / sxx / (f.n - 2)) END, 5) AS gamma_err, round(h.t, 3) AS hard_peak_time
FROM ev LEFT JOIN f ON f.date = ev.date AND f.event_no = ev.event_no LEFT JOIN h ON h.date = ev.date AND h.event_no = ev.event_no AND h.rk = 1 AND h.n >= 2""")
def band_powerlaw(spark, sf_dir):
    out = measure.acceleration(catalog(spark, sf_dir), band_curves(spark, sf_dir))
    return out.select("date", "event_no", *r("gamma", "gamma_err", digits=5), *r("hard_peak_time", digits=3))


SOFT_SLOPE = """sg AS (SELECT ev.date, ev.event_no, ev.start, ev."end", w.bt AS t, w.flux AS f, w.bt - lag(w.bt) OVER o AS hs, lead(w.bt) OVER o - w.bt AS hd, lag(w.flux) OVER o AS lo, lead(w.flux) OVER o AS up FROM ev JOIN w ON w.date = ev.date AND w.k >= ev.s AND w.k < ev.e WINDOW o AS (PARTITION BY ev.date, ev.event_no ORDER BY w.k)),
sl AS (SELECT date, event_no, start, "end", t, coalesce((hs * hs * up + (hd * hd - hs * hs) * f - hd * hd * lo) / (hs * hd * (hd + hs)), (up - f) / hd, (f - lo) / hs) AS y FROM sg)"""


def _interpolated(shift: str) -> str:
    """SQL of the clamped interpolation of hd (date, event_no, t, c) at sl's times, its clock moved by an expression."""
    return f"""SELECT a.date, a.event_no, a.t, {shift} AS lag, a.y, coalesce(CASE WHEN ta = tb THEN p.c ELSE p.c + (n.c - p.c) * (a.t - {shift} - ta) / (tb - ta) END, p.c, n.c) AS h FROM (
 SELECT sx.*, (SELECT max(hd.t) FROM hd WHERE hd.date = sx.date AND hd.event_no = sx.event_no AND hd.t <= sx.t - {shift}) AS ta, (SELECT min(hd.t) FROM hd WHERE hd.date = sx.date AND hd.event_no = sx.event_no AND hd.t >= sx.t - {shift}) AS tb FROM sx) a
 LEFT JOIN hd p ON p.date = a.date AND p.event_no = a.event_no AND p.t = ta LEFT JOIN hd n ON n.date = a.date AND n.event_no = a.event_no AND n.t = tb"""


@query(f"""WITH {CATALOG}, {SOFT_SLOPE}, h0 AS (SELECT ev.date, ev.event_no, lc.t, lc.counts AS c, count(*) OVER (PARTITION BY ev.date, ev.event_no) AS n FROM ev JOIN lc ON lc.kind = 'view' AND lc.date = ev.date AND lc.t BETWEEN ev.start AND ev."end"),
hd AS (SELECT * FROM h0 WHERE n >= 4), sx AS (SELECT sl.* FROM sl SEMI JOIN hd ON hd.date = sl.date AND hd.event_no = sl.event_no), zi AS ({_interpolated('0')})
SELECT date, event_no, round(CASE WHEN stddev_pop(y) >= 1e-9 AND stddev_pop(h) >= 1e-9 THEN corr(y, h) END, 5) AS corr FROM zi GROUP BY date, event_no""")
def neupert_corr(spark, sf_dir):
    events = detect.sigma_events(binned(spark, sf_dir), STAND_IN, flux=True)
    return timing.neupert(events, measure.total_band(band_curves(spark, sf_dir))).select("date", "event_no", *r("corr", digits=5))


@query(f"""WITH {CATALOG}, {SOFT_SLOPE}, h0 AS (SELECT ev.date, ev.event_no, lc.t, lc.counts AS c, count(*) OVER (PARTITION BY ev.date, ev.event_no) AS n FROM ev JOIN lc ON lc.kind = 'view' AND lc.date = ev.date AND lc.t BETWEEN ev.start - 1200 AND ev."end" + 1200),
hd AS (SELECT * FROM h0 WHERE n >= 4), sx AS (SELECT sl.*, l.lag FROM sl SEMI JOIN hd ON hd.date = sl.date AND hd.event_no = sl.event_no, (SELECT unnest(range(-1200, 1201, 600)) AS lag) l), zi AS ({_interpolated('lag')}),
c AS (SELECT date, event_no, lag, corr(y, h) AS r, count(*) AS n, stddev_pop(y) AS a, stddev_pop(h) AS b FROM zi GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY date, event_no ORDER BY r DESC, lag) AS rk, max(CASE WHEN lag = 0 THEN r END) OVER (PARTITION BY date, event_no) AS zero FROM c WHERE n >= 4 AND a >= 1e-9 AND b >= 1e-9)
SELECT date, event_no, CAST(lag AS INTEGER) AS best_lag_s, round(r, 5) AS corr_at_best, round(zero, 5) AS corr_zero FROM k WHERE rk = 1""")
def lag_scan_corr(spark, sf_dir):
    events = detect.sigma_events(binned(spark, sf_dir), STAND_IN, flux=True)
    out = timing.neupert_lag(events, measure.total_band(band_curves(spark, sf_dir)), 1200, 600)
    return out.select("date", "event_no", "best_lag_s", *r("corr_at_best", "corr_zero", digits=5))


@query(f"""WITH {CATALOG}, be AS (SELECT date, kind AS band, t AS start, t + 60 AS "end" FROM lc WHERE counts > 60), cov AS (SELECT date, count(DISTINCT kind) AS n FROM lc GROUP BY date),
v AS (SELECT ev.date, ev.event_no, list_sort(list(DISTINCT be.band)) AS bands FROM ev JOIN be ON be.date = ev.date AND be.start - 120 <= ev."end" AND be."end" + 120 >= ev.start GROUP BY ev.date, ev.event_no)
SELECT ev.date, ev.event_no, CAST(coalesce(len(bands), 0) AS INTEGER) AS votes_yes, CAST(n AS INTEGER) AS votes_covered, array_to_string(bands, '+') AS voting_bands FROM ev JOIN cov ON cov.date = ev.date LEFT JOIN v ON v.date = ev.date AND v.event_no = ev.event_no""")
def band_vote(spark, sf_dir):
    rows = curve(spark, sf_dir)
    found = rows.where("counts > 60").select("date", F.col("kind").alias("band"), F.col("t").alias("start"), (F.col("t") + 60).alias("end"))
    out = detect.votes(catalog(spark, sf_dir), found, rows.select("date", F.col("kind").alias("band")).distinct())
    return out.select("date", "event_no", "votes_yes", "votes_covered", F.array_join("voting_bands", "+").alias("voting_bands"))


@query("""WITH v AS (SELECT event_id, [CAST(value AS DOUBLE) * 1.0003e-8, CAST(value AS DOUBLE) * 3.0007e-7, (event_id % 5) * 1.0001e-6] AS f FROM events), t AS (SELECT event_id, list_filter(list_transform(f, lambda x: CASE WHEN x >= 1e-4 THEN 5 WHEN x >= 1e-5 THEN 4 WHEN x >= 1e-6 THEN 3 WHEN x >= 1e-7 THEN 2 WHEN x >= 1e-8 THEN 1 END), lambda x: x IS NOT NULL) AS k FROM v)
SELECT event_id, CASE WHEN len(k) >= 2 THEN list_max(k) - list_min(k) <= 1 END AS agree FROM t""")
def tier_agreement(spark, sf_dir):
    v = F.col("value").cast("double")
    classes = F.array(*[scalar.goes_class(x) for x in (v * 1.0003e-8, v * 3.0007e-7, (F.col("event_id") % 5) * 1.0001e-6)])
    return table(spark, sf_dir, "events").select("event_id", spectra.tiers_agree(classes).alias("agree"))


@query(f"""WITH {CATALOG} SELECT date, printf('%s_SDD2_%03d', date, event_no) AS event_id, round(peak_flux, 6) AS peak_flux FROM ev UNION ALL SELECT date, printf('%s_HXR_%03d', date, event_no), round(peak_flux, 6) FROM ev WHERE event_no % 2 = 0""")
def catalog_union(spark, sf_dir):
    ev = catalog(spark, sf_dir)
    own = lambda rows, kind: rows.select("date", F.format_string(f"%s_{kind}_%03d", "date", "event_no").alias("event_id"), *r("peak_flux"))
    return own(ev, "SDD2").unionByName(own(ev.where("event_no % 2 = 0"), "HXR"))


@query("""WITH p AS (SELECT '/data/' || page_id % 3 || '/AL1_' || CAST(20240101 + page_id % 7 AS VARCHAR) || '_SDD' || (1 + page_id % 2) || CASE page_id % 5 WHEN 4 THEN '.pi' ELSE '.lc' END AS path FROM pages),
c AS (SELECT path, regexp_extract(regexp_extract(path, '([^/]+)$', 1), '(\\d{8})', 1) AS date, row_number() OVER (PARTITION BY regexp_extract(regexp_extract(path, '([^/]+)$', 1), '(\\d{8})', 1) ORDER BY contains(path, 'SDD2') DESC, path) AS rk FROM p WHERE path LIKE '%.lc')
SELECT c.date, c.path, (SELECT min(path) FROM p WHERE path = replace(c.path, '.lc', '.pi')) AS spectrum FROM c WHERE rk = 1""")
def file_pick_priority(spark, sf_dir):
    i = F.col("page_id")
    text = lambda c: c.cast("string")
    path = F.concat(F.lit("/data/"), text(i % 3), F.lit("/AL1_"), text(20240101 + i % 7), F.lit("_SDD"), text(1 + i % 2), F.when(i % 5 == 4, ".pi").otherwise(".lc"))
    return instruments.picked(table(spark, sf_dir, "pages").select(path.alias("path")))


@query(f"""WITH {LC}, y AS (SELECT date, t, counts FROM lc WHERE kind = 'purchase'), q AS (SELECT s.date, s.k, s.bt, (SELECT max(t) FROM y WHERE y.date = s.date AND y.t <= s.bt) AS ta, (SELECT min(t) FROM y WHERE y.date = s.date AND y.t >= s.bt) AS tb FROM s)
SELECT q.date, q.k, round(CASE WHEN ta = tb THEN a.counts ELSE a.counts + (b.counts - a.counts) * (q.bt - ta) / (tb - ta) END, 6) AS y FROM q LEFT JOIN y a ON a.date = q.date AND a.t = q.ta LEFT JOIN y b ON b.date = q.date AND b.t = q.tb""")
def asof_interp_null(spark, sf_dir):
    clock = binned(spark, sf_dir).select("date", "k", F.col("bt").alias("t"))
    y = curve(spark, sf_dir).where("kind = 'purchase'").select("date", "t", F.col("counts").alias("y"))
    return intervals.interpolated(clock, y, clamp=False).select("date", "k", *r("y"))


@query(f"""WITH {CATALOG}, big AS (SELECT date, s, e, row_number() OVER (PARTITION BY date ORDER BY peak_flux DESC, s) AS rk FROM ev), t0 AS (SELECT date, min(bt) AS t0 FROM w GROUP BY date)
SELECT w.date, w.k, round(w.flux, 6) AS flux, round((w.bt - t0) / 3600, 6) AS hours FROM big JOIN w ON w.date = big.date AND w.k >= s - greatest((e - s) // 2, 6) AND w.k <= e + greatest((e - s) // 2, 6) JOIN t0 ON t0.date = w.date WHERE rk = 1""")
def event_zoom(spark, sf_dir):
    return catalogs.zoom(binned(spark, sf_dir), catalog(spark, sf_dir), STAND_IN.bin_s).select("date", "k", *r("flux", "hours"))


@query("""SELECT 'e' || event_id AS event_id, strftime(ts, '%H:%M:%S') AS start, strftime(ts, '%H:%M:%S') AS peak, printf('%.1f min', CAST(value AS DOUBLE) * 3 / 60) AS duration, CASE WHEN event_id % 4 = 0 THEN '-' ELSE printf('%.2e', CAST(value AS DOUBLE) * 1.0001e-7) END AS flux, event_type AS class,
 CASE event_id % 3 WHEN 0 THEN '-' WHEN 1 THEN 'soft (2.8-20)' ELSE 'hard (60-150)' END || CASE WHEN event_id % 3 <> 0 AND event_id % 5 < 2 THEN '*' ELSE '' END AS band, 'SXR' AS instrument FROM events""")
def event_table_report(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value").cast("double")
    at = scalar.utc(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    band = F.when(i % 3 == 1, measure.LABELS["band1"]).when(i % 3 == 2, measure.LABELS["band3"])
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), i.cast("string")).alias("event_id"), at.alias("start_utc"), at.alias("peak_utc"), (v * 3).alias("duration_s"), v.alias("peak_rate"), F.when(i % 4 != 0, v * 1.0001e-7).alias("peak_flux_wm2"), F.lit(None).cast("double").alias("hard_peak_flux_wm2"), F.col("event_type").alias("class_approx"), band.alias("dominant_energy_band"), (i % 5).cast("int").alias("n_bands_covered"))
    return catalogs.event_table(rows, "SXR")


@query(f"WITH {READY} SELECT date, k, round(greatest(coalesce(bg, 0), greatest(coalesce(0.01 * quantile_cont(CASE WHEN flux > 0 THEN flux END, 0.5) OVER (PARTITION BY date), 1e-6), 1e-6)), 6) AS bg FROM w")
def forecast_background(spark, sf_dir):
    return series.forecast_background(binned(spark, sf_dir), 24, 6).select("date", "k", *r("bg"))


#: The catalog's SQL at another threshold of sigma
WIDE = CATALOG.replace("/ noise > 1 AS above", "/ noise > 0.2 AS above")
QPP = f"""WITH {WIDE}, qe AS (SELECT ev.date, ev.event_no, w.k - ev.s AS j, w.flux AS x FROM ev JOIN w ON w.date = ev.date AND w.k >= ev.s AND w.k < ev.e),
qn AS (SELECT *, count(*) OVER (PARTITION BY date, event_no) AS n FROM qe),
qw AS (SELECT *, x - (((((coalesce(lag(x, 2) OVER o, 0) + coalesce(lag(x) OVER o, 0)) + x) + coalesce(lead(x) OVER o, 0)) + coalesce(lead(x, 2) OVER o, 0)) / (least(j + 2, n - 1) - greatest(j - 2, 0) + 1)) AS v FROM qn WHERE n >= 12 WINDOW o AS (PARTITION BY date, event_no ORDER BY j)),
qs AS (SELECT *, v - avg(v) OVER (PARTITION BY date, event_no) AS u FROM qw QUALIFY stddev_pop(v) OVER (PARTITION BY date, event_no) >= 1e-6),
qf AS (SELECT date, event_no, n, f, CASE WHEN f = 0 THEN 0 ELSE power(sum(u * cos(2 * pi() * ((f * j) % n) / n)), 2) + power(sum(u * sin(2 * pi() * ((f * j) % n) / n)), 2) END AS p FROM qs, LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS f) GROUP BY 1, 2, 3, 4),
qp AS (SELECT date, event_no, max(n) AS n, arg_max(f, p) AS top, max(p) AS strength, max(p) > avg(p) + 3 * stddev_pop(p) AS strong FROM qf GROUP BY 1, 2),
qr AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY date, event_no ORDER BY j) AS run FROM (SELECT *, v IS DISTINCT FROM lag(v) OVER (PARTITION BY date, event_no ORDER BY j) AS new FROM qs)),
qt AS (SELECT date, event_no, run, min(j) AS a, max(j) AS b, max(v) AS v FROM qr GROUP BY 1, 2, 3),
qk AS (SELECT date, event_no, (a + b) // 2 AS place, v, v > lag(v) OVER o AND v > lead(v) OVER o AS is_top FROM qt WINDOW o AS (PARTITION BY date, event_no ORDER BY run)),
ql AS (SELECT date, event_no, len(list_reduce(list_prepend([]::BIGINT[], list([place] ORDER BY v DESC, place DESC)), lambda kept, q: CASE WHEN len(list_filter(kept, lambda z: abs(z - q[1]) < 3)) > 0 THEN kept ELSE list_concat(kept, q) END)) AS n_peaks FROM qk WHERE is_top GROUP BY 1, 2)
SELECT ev.date, ev.event_no, round(CASE WHEN n_peaks >= 3 AND strong AND n * 600 > 2 * (n * 600 / top) THEN n * 600 / top END, 5) AS period, CAST(CASE WHEN strength IS NOT NULL THEN coalesce(n_peaks, 0) END AS INTEGER) AS n_peaks, round(strength, 3) AS strength
FROM ev LEFT JOIN qp ON qp.date = ev.date AND qp.event_no = ev.event_no LEFT JOIN ql ON ql.date = ev.date AND ql.event_no = ev.event_no"""


@query(QPP)
def qpp_fft(spark, sf_dir):
    # At these few bins a day an event has its twelve bins only if runs are merged widely.
    events = detect.sigma_events(binned(spark, sf_dir), STAND_IN, 0.2, flux=True)
    return timing.pulsations(events, STAND_IN.bin_s).select("date", "event_no", *r("period", digits=5), "n_peaks", *r("strength", digits=3))


def vote_counts(spark, sf_dir):
    return curve(spark, sf_dir).select("date", F.col("kind").alias("band"), "t", "counts")


@query()
def band_events(spark, sf_dir):
    return detect.band_events(vote_counts(spark, sf_dir), STAND_IN, min_dur_s=1200.0, bg_window_s=14400.0)


@query()
def band_confirm(spark, sf_dir):
    return detect.confirmed(catalog(spark, sf_dir), vote_counts(spark, sf_dir), STAND_IN, around=3600.0)


def _catalog(spark, sf_dir, mode):
    shift = lambda rows: rows.withColumns({"date": F.lit("20240101"), "t": 1704067200 + F.col("t") * 60})
    return catalogs.nowcast(STAND_IN, curve(spark, sf_dir).select("date", "t", "counts"), shift(soft(spark, sf_dir)), band_curves(spark, sf_dir), shift(hard(spark, sf_dir)), response(spark), mode)


@query()
def event_catalog(spark, sf_dir):
    return _catalog(spark, sf_dir, "COMBINED")


@query()
def event_catalog_soft(spark, sf_dir):
    return _catalog(spark, sf_dir, "SOFT")


@query()
def event_catalog_hard(spark, sf_dir):
    return _catalog(spark, sf_dir, "HARD")
