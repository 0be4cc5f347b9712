"""Registered queries of the time-series operators over the driver's tables, and their SQL twins for checking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import queries_events, queries_forecast  # noqa: F401 - they register their queries
from .config import STAND_IN
from .functions import scalar
from .operators import checks, detect, intervals, series, skill, spectra
from .registry import BIN, CATALOG, ISLANDS, LC, MERGED, READY, binned, catalog, curve, oracle_sql, queries, PRED, predictions, query, r, ready, table  # noqa: F401
from .sources import instruments, ledger


@query(f"WITH {LC} SELECT date, k, round(bt, 3) AS bt, round(flux, 6) AS flux, cnt FROM s")
def rebin_mean(spark, sf_dir):
    return binned(spark, sf_dir).select("date", "k", *r("bt", digits=3), *r("flux"), "cnt")


@query(f"WITH {LC} SELECT lc.date, CAST(floor((t - t0) / 600) AS BIGINT) AS k, round(min(t0) + (CAST(floor((t - t0) / 600) AS BIGINT) + 0.5) * 600, 3) AS bt, round(sum(counts), 6) AS total FROM lc JOIN z ON lc.date = z.date GROUP BY 1, 2")
def rebin_sum_centre(spark, sf_dir):
    return series.rebin_sum(curve(spark, sf_dir), BIN).select("date", "k", *r("bt", digits=3), *r("total"))


@query(f"WITH {READY} SELECT date, k, round(bg, 6) AS bg FROM w")
def rolling_p10(spark, sf_dir):
    return series.background(binned(spark, sf_dir), 24, 6).select("date", "k", *r("bg"))


@query(f"WITH {READY} SELECT date, k, round(med, 6) AS med FROM w")
def rolling_median_bg(spark, sf_dir):
    return series.background(binned(spark, sf_dir), 24, 6, 0.5, "med").select("date", "k", *r("med"))


@query(f"WITH {READY} SELECT date, k, round(noise, 6) AS noise, round((flux - bg_safe) / noise, 6) AS sigma FROM w")
def mad_noise_sigma(spark, sf_dir):
    return ready(spark, sf_dir).withColumn("sigma", (F.col("flux") - F.col("bg_safe")) / F.col("noise")).select("date", "k", *r("noise", "sigma"))


@query(f"WITH {READY} SELECT date, k, round(bg_safe, 6) AS bg_safe, round(flux / bg_safe, 6) AS norm FROM w")
def bg_floor_norm(spark, sf_dir):
    return ready(spark, sf_dir).withColumn("norm", F.col("flux") / F.col("bg_safe")).select("date", "k", *r("bg_safe", "norm"))


@query(f"""WITH {LC}, x AS (SELECT date, k, list(flux) OVER (PARTITION BY date ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM s)
SELECT date, k, round(list_reduce(l, lambda a, b: 0.9 * a + 0.1 * b) - list_reduce(l, lambda a, b: 0.5 * a + 0.5 * b), 6) AS fred FROM x""")
def ema_fred(spark, sf_dir):
    return series.fred(binned(spark, sf_dir)).select("date", "k", *r("fred"))


@query(f"""WITH {LC}, f AS (SELECT date, k, bt, flux FROM s WHERE cnt > 0), d AS (SELECT *, bt - lag(bt) OVER o AS hs, lead(bt) OVER o - bt AS hd, lag(flux) OVER o AS lo, lead(flux) OVER o AS up FROM f WINDOW o AS (PARTITION BY date ORDER BY k))
SELECT date, k, round(coalesce((hs * hs * up + (hd * hd - hs * hs) * flux - hd * hd * lo) / (hs * hd * (hd + hs)), (up - flux) / hd, (flux - lo) / hs), 9) AS slope FROM d""")
def gradient_nonuniform(spark, sf_dir):
    return binned(spark, sf_dir).where("cnt > 0").withColumn("slope", series.gradient("flux", "bt")).select("date", "k", *r("slope", digits=9))


@query(f"WITH {LC} SELECT date, k, round(flux - avg(flux) OVER (PARTITION BY date ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS wiggle FROM s")
def moving_avg_detrend(spark, sf_dir):
    return binned(spark, sf_dir).withColumn("wiggle", F.col("flux") - series.moving_average("flux")).select("date", "k", *r("wiggle"))


def _above(spark, sf_dir):
    return ready(spark, sf_dir).withColumn("above", (F.col("flux") - F.col("bg_safe")) / F.col("noise") > 1)


@query(f"WITH {ISLANDS} SELECT date, s, e FROM runs")
def islands_min_duration(spark, sf_dir):
    return intervals.islands(_above(spark, sf_dir), "above", 2).select("date", "s", "e")


@query(f"WITH {MERGED} SELECT date, s, e FROM one")
def islands_merge(spark, sf_dir):
    return intervals.merged(intervals.islands(_above(spark, sf_dir), "above", 2), 2).select("date", "s", "e")


@query(f'WITH {CATALOG} SELECT date, event_no, s, p, e, round(start, 3) AS start, round(peak, 3) AS peak, round("end", 3) AS "end", round(peak_flux, 6) AS peak_flux, round(bg, 6) AS bg, round(ratio, 6) AS ratio, round(sigma, 6) AS sigma, data_gap FROM ev')
def event_catalog_sigma(spark, sf_dir):
    return catalog(spark, sf_dir).select("date", "event_no", "s", "p", "e", *r("start", "peak", "end", digits=3), *r("peak_flux", "bg", "ratio", "sigma"), "data_gap")


@query(f"""WITH {READY}, u AS (SELECT date, k, CAST(sum(CAST(round(greatest(flux, 0) * 1e6) AS BIGINT)) OVER o AS BIGINT) AS c, CAST(sum(CAST(round(greatest(mu0, 1e-9) * 1e6) AS BIGINT)) OVER o AS BIGINT) AS b FROM w WINDOW o AS (PARTITION BY date ORDER BY k)),
l AS (SELECT date, k + 1 AS f, c, b FROM u UNION ALL SELECT DISTINCT date, 0, 0, 0 FROM u),
q AS (SELECT u.date, u.k, (u.c - l.c) / 1e6 AS n, (u.b - l.b) / 1e6 AS m FROM u JOIN l ON u.date = l.date AND l.f BETWEEN greatest(u.k - 11, 0) AND u.k)
SELECT date, k, round(max(CASE WHEN n > m THEN n * ln(n / m) - (n - m) ELSE 0 END), 4) AS llr FROM q GROUP BY date, k""")
def llr_multiwindow(spark, sf_dir):
    return detect.multiwindow(ready(spark, sf_dir), 12).select("date", "k", *r("llr", digits=4))


@query()
def focus_scan(spark, sf_dir):
    return detect.focus_scan(ready(spark, sf_dir), STAND_IN).select("date", "k", "stat", "onset")


@query()
def detect_events_focus(spark, sf_dir):
    return detect.focus_events(binned(spark, sf_dir), STAND_IN)


@query(f"""WITH {CATALOG} SELECT ev.date, event_no, count(lc.t) AS n, round(sum(lc.counts), 6) AS total, round(max(lc.counts), 6) AS top FROM ev JOIN lc ON lc.date = ev.date AND lc.t BETWEEN ev.start AND ev."end" GROUP BY ev.date, event_no""")
def interval_join_stats(spark, sf_dir):
    samples = curve(spark, sf_dir).select("date", "t", "counts")
    joined = intervals.interval_join(catalog(spark, sf_dir).select("date", "event_no", "start", "end"), samples, F.col("start"), F.col("end"), 3600.0)
    return joined.groupBy("date", "event_no").agg(F.count("t").alias("n"), F.round(F.sum("counts"), 6).alias("total"), F.round(F.max("counts"), 6).alias("top"))


@query(f"""WITH {CATALOG}, x AS (SELECT ev.date, event_no, avg(lc.counts) AS before FROM ev LEFT JOIN lc ON lc.date = ev.date AND lc.t >= ev.start - 3600 AND lc.t < ev.start GROUP BY ev.date, event_no) SELECT date, event_no, round(coalesce(before, 0), 6) AS before FROM x""")
def prebackground_join(spark, sf_dir):
    samples = curve(spark, sf_dir).select("date", "t", "counts")
    ev = catalog(spark, sf_dir).select("date", "event_no", "start")
    before = F.avg(F.when(F.col("t") < F.col("start"), F.col("counts"))).alias("before")
    out = intervals.interval_stats(ev, samples, F.col("start") - 3600, F.col("start"), 3600.0, ("date", "event_no"), [before])
    return out.select("date", "event_no", F.round(F.coalesce("before", F.lit(0.0)), 6).alias("before"))


@query(f"""WITH {CATALOG}, x AS (SELECT ev.date, event_no, lc.t, lc.counts, row_number() OVER (PARTITION BY ev.date, event_no ORDER BY abs(lc.t - ev.peak), lc.t) AS rk FROM ev JOIN lc ON lc.date = ev.date AND abs(lc.t - ev.peak) < 600) SELECT date, event_no, round(t, 3) AS t, round(counts, 6) AS counts FROM x WHERE rk = 1""")
def nearest_peak_sample(spark, sf_dir):
    samples = curve(spark, sf_dir).select("date", "t", "counts")
    near = intervals.nearest(catalog(spark, sf_dir), samples, "peak", 600.0, ("date", "event_no"))
    return near.select("date", "event_no", F.round("near.t", 3).alias("t"), F.round("near.counts", 6).alias("counts"))


@query(f"""WITH {LC}, y AS (SELECT date, t, counts FROM lc WHERE kind = 'purchase'), q AS (SELECT s.date, s.k, s.bt,
 (SELECT max(t) FROM y WHERE y.date = s.date AND y.t <= s.bt) AS ta, (SELECT min(t) FROM y WHERE y.date = s.date AND y.t >= s.bt) AS tb FROM s)
SELECT q.date, q.k, round(coalesce(CASE WHEN ta = tb THEN a.counts ELSE a.counts + (b.counts - a.counts) * (q.bt - ta) / (tb - ta) END, a.counts, b.counts), 6) AS y FROM q
LEFT JOIN y a ON a.date = q.date AND a.t = q.ta LEFT JOIN y b ON b.date = q.date AND b.t = q.tb""")
def asof_interp(spark, sf_dir):
    clock = binned(spark, sf_dir).select("date", "k", F.col("bt").alias("t"))
    y = curve(spark, sf_dir).where("kind = 'purchase'").select("date", "t", F.col("counts").alias("y"))
    return intervals.interpolated(clock, y).select("date", "k", *r("y"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(abs(CAST(x AS DOUBLE)) * 100 AS DOUBLE)) AS c FROM embeddings), u AS (SELECT vec_id, unnest(c) AS n, unnest(range(1, len(c) + 1)) AS ch FROM e), v AS (SELECT *, CASE WHEN ch <= 168 THEN ch * 0.0476 END AS kev FROM u)
SELECT vec_id, round(sum(CASE WHEN kev >= 0.5 AND kev < 1.5 THEN n ELSE 0 END), 4) AS low, round(sum(CASE WHEN kev >= 1.5 AND kev < 3.0 THEN n ELSE 0 END), 4) AS high FROM v GROUP BY vec_id""")
def band_counts(spark, sf_dir):
    counts = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 100)
    in_band = lambda lo, hi: F.aggregate(F.transform("c", lambda n, i: F.when((scalar.channel_kev(i + 1) >= lo) & (scalar.channel_kev(i + 1) < hi), n).otherwise(0.0)), F.lit(0.0), lambda a, n: a + n)
    e = table(spark, sf_dir, "embeddings").select("vec_id", counts.alias("c"))
    return e.select("vec_id", F.round(in_band(0.5, 1.5), 4).alias("low"), F.round(in_band(1.5, 3.0), 4).alias("high"))


@query("""WITH u AS (SELECT label, abs(CAST(unnest(embedding) AS DOUBLE)) * 100 AS n, unnest(range(1, len(embedding) + 1)) AS ch FROM embeddings) SELECT label, ch, round(sum(n), 3) AS total, round(avg(n), 5) AS mean FROM u GROUP BY label, ch""")
def spectrum_sum(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    n = F.abs(F.col("x").cast("double")) * 100
    return e.groupBy("label", (F.col("i") + 1).cast("long").alias("ch")).agg(F.round(F.sum(n), 3).alias("total"), F.round(F.avg(n), 5).alias("mean"))


@query("""WITH u AS (SELECT vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) * 100 AS n, unnest(range(1, len(embedding) + 1)) AS ch FROM embeddings) SELECT vec_id, round(sum(n * ch * 0.0476 * 1.602176634e-16 / (1 + ch / 64.0)) / 20 / 1e-4 * 1e12, 4) AS flux, round(sqrt(sum(n * power(ch * 0.0476 * 1.602176634e-16 / (1 + ch / 64.0), 2))) / 20 / 1e-4 * 1e12, 4) AS err FROM u GROUP BY vec_id""")
def flux_calibrated(spark, sf_dir):
    w = (F.col("i") + 1) * 0.0476 * 1.602176634e-16 / (1 + (F.col("i") + 1) / 64.0)
    n = F.abs(F.col("x").cast("double")) * 100
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("vec_id").agg(F.round(F.sum(n * w) / 20 / 1e-4 * 1e12, 4).alias("flux"), F.round(F.sqrt(F.sum(n * w * w)) / 20 / 1e-4 * 1e12, 4).alias("err"))


@query(f"""WITH {CATALOG} SELECT ev.date, event_no, round(sum(greatest(w.flux - ev.bg, 0)) * 600, 4) AS energy FROM ev JOIN w ON w.date = ev.date AND w.k >= ev.s AND w.k < ev.e GROUP BY ev.date, event_no""")
def event_energy(spark, sf_dir):
    return catalog(spark, sf_dir).select("date", "event_no", *r("energy", digits=4))


@query("""SELECT event_id, CASE WHEN f <= 0 THEN NULL WHEN f >= 1e-4 THEN 'X' || printf('%.1f', f / 1e-4) WHEN f >= 1e-5 THEN 'M' || printf('%.1f', f / 1e-5) WHEN f >= 1e-6 THEN 'C' || printf('%.1f', f / 1e-6) WHEN f >= 1e-7 THEN 'B' || printf('%.1f', f / 1e-7) WHEN f >= 1e-8 THEN 'A' || printf('%.1f', f / 1e-8) ELSE '<A1' END AS class FROM (SELECT event_id, CAST(value AS DOUBLE) * 1.00013e-7 AS f FROM events)""")
def goes_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.goes_class(F.col("value").cast("double") * 1.00013e-7).alias("class"))


@query("""SELECT event_id, ['sub-C', 'C-like', 'M-like', 'X-like'][1 + greatest(CASE WHEN v / 5 >= 50 THEN 3 WHEN v / 5 >= 20 THEN 2 WHEN v / 5 >= 8 THEN 1 ELSE 0 END, CASE WHEN v * 20 >= 5000 THEN 3 WHEN v * 20 >= 1500 THEN 2 WHEN v * 20 >= 400 THEN 1 ELSE 0 END)] AS class FROM (SELECT event_id, CAST(value AS DOUBLE) AS v FROM events)""")
def approx_class(spark, sf_dir):
    v = F.col("value").cast("double")
    return table(spark, sf_dir, "events").select("event_id", scalar.approx_class(v / 5, v * 20).alias("class"))


@query("SELECT ch, round(CASE WHEN ch <= 168 THEN ch * 0.0476 ELSE 168 * 0.0476 + (ch - 168) * 0.0952 END, 6) AS kev FROM (SELECT DISTINCT event_id % 340 + 1 AS ch FROM events)")
def channel_energy(spark, sf_dir):
    ch = (F.col("event_id") % 340 + 1).alias("ch")
    return table(spark, sf_dir, "events").select(ch).distinct().select("ch", F.round(scalar.channel_kev(F.col("ch")), 6).alias("kev"))


@query("SELECT event_id, round((epoch(ts) / 86400 + 40587 - 40587) * 86400, 3) AS t FROM events")
def mjd_roundtrip(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", F.round(scalar.mjd_to_unix(t / 86400 + 40587), 3).alias("t"))


MEASURED = """mm AS (SELECT event_id, user_id % 7 AS a, event_id % 11 AS b, event_id % 5 AS c, CAST(value AS DOUBLE) AS v FROM events),
me AS (SELECT event_id, CASE WHEN a <> 0 THEN a / 10.0 END AS corr, CASE WHEN b > 1 THEN b * 1.0 END AS hard_peak, c * 2.0 AS soft_peak, CASE WHEN c > 0 THEN (a - 3) * 150.0 END AS temp_offset, CASE WHEN b <> 3 THEN b * 1.0 END AS gamma,
 CASE WHEN a <> 5 THEN b + 3.0 END AS temp, CASE WHEN c > 1 THEN a + 1.0 END AS qpp_soft, CASE WHEN c > 2 THEN b + 1.0 END AS qpp_hard, v / 10 AS ratio, c AS bands, CASE WHEN a > 1 THEN b > 4 END AS confirmed, CASE WHEN b > 2 THEN a > 3 END AS agree,
 CASE WHEN c <> 2 THEN a * 3.0 END AS temp_fit, b % 4 AS yes, c % 4 AS covered, v AS focus_stat, CASE WHEN a > 2 THEN v / 20 END AS fred, (v - 20) / 8 AS excess, CASE WHEN b > 5 THEN a / 7.0 END AS match FROM mm)"""
CHECKED = (
    MEASURED
    + """, ck AS (SELECT *, CASE WHEN corr IS NULL THEN 'N/A' WHEN corr >= 0.3 THEN 'PASS' ELSE 'FLAG' END AS check_neupert,
 CASE WHEN hard_peak IS NULL THEN 'N/A' WHEN hard_peak <= soft_peak + 10 THEN 'PASS' ELSE 'FLAG' END AS check_accel_timing, CASE WHEN temp_offset IS NULL THEN 'N/A' WHEN abs(temp_offset) <= 300 THEN 'PASS' ELSE 'FLAG' END AS check_heat_timing,
 CASE WHEN gamma IS NULL OR temp IS NULL THEN 'N/A' WHEN gamma < 5 AND temp <= 8 THEN 'FLAG' ELSE 'PASS' END AS check_energy_budget,
 CASE WHEN qpp_soft IS NULL OR qpp_hard IS NULL THEN 'N/A' WHEN abs(qpp_soft - qpp_hard) / greatest(qpp_soft, qpp_hard) <= 0.3 THEN 'PASS' ELSE 'FLAG' END AS check_qpp_witness,
 CASE WHEN gamma IS NULL THEN 'N/A' WHEN ratio >= 8 AND gamma > 7 THEN 'FLAG' ELSE 'PASS' END AS check_class_accel,
 CASE WHEN bands = 0 THEN 'N/A' WHEN bands >= 2 THEN 'PASS' WHEN ratio >= 8 THEN 'FLAG' ELSE 'N/A' END AS check_cross_band, CASE WHEN confirmed IS NULL THEN 'N/A' WHEN confirmed THEN 'PASS' ELSE 'FLAG' END AS check_band_confirm,
 CASE WHEN agree IS NULL THEN 'N/A' WHEN agree THEN 'PASS' ELSE 'FLAG' END AS check_class_agree,
 CASE WHEN temp IS NULL OR temp_fit IS NULL THEN 'N/A' WHEN greatest(temp, temp_fit) / greatest(least(temp, temp_fit), 1e-6) <= 2 THEN 'PASS' ELSE 'FLAG' END AS check_temp_fit_agree,
 CASE WHEN covered < 2 THEN 'N/A' WHEN yes >= 2 THEN 'PASS' WHEN ratio >= 8 THEN 'FLAG' ELSE 'N/A' END AS check_band_vote FROM me),
cn AS (SELECT *, """
    + " + ".join(f"CAST(check_{k} = 'PASS' AS INTEGER)" for k in checks.CHECKS)
    + " AS n_pass, "
    + " + ".join(f"CAST(check_{k} = 'FLAG' AS INTEGER)" for k in checks.CHECKS)
    + " AS n_flag FROM ck)"
)


def measured(spark, sf_dir):
    """Measurements derived from events by rule, with nulls in every column that may lack one."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 7 AS a", "event_id % 11 AS b", "event_id % 5 AS c", "CAST(value AS DOUBLE) AS v")
    return e.selectExpr(
        "event_id", "CASE WHEN a <> 0 THEN a / 10D END AS corr", "CASE WHEN b > 1 THEN b * 1D END AS hard_peak", "c * 2D AS soft_peak", "CASE WHEN c > 0 THEN (a - 3) * 150D END AS temp_offset",
        "CASE WHEN b <> 3 THEN b * 1D END AS gamma", "CASE WHEN a <> 5 THEN b + 3D END AS temp", "CASE WHEN c > 1 THEN a + 1D END AS qpp_soft", "CASE WHEN c > 2 THEN b + 1D END AS qpp_hard", "v / 10 AS ratio", "c AS bands",
        "CASE WHEN a > 1 THEN b > 4 END AS confirmed", "CASE WHEN b > 2 THEN a > 3 END AS agree", "CASE WHEN c <> 2 THEN a * 3D END AS temp_fit", "b % 4 AS yes", "c % 4 AS covered", "v AS focus_stat", "CASE WHEN a > 2 THEN v / 20 END AS fred", "(v - 20) / 8 AS excess", "CASE WHEN b > 5 THEN a / 7D END AS match",
    )


@query(f"WITH {CHECKED} SELECT event_id, {', '.join(f'check_{k}' for k in checks.CHECKS)}, n_pass, n_flag, CAST(n_pass AS VARCHAR) || '/' || CAST(n_pass + n_flag AS VARCHAR) AS checks_run FROM cn")
def cross_checks(spark, sf_dir):
    return checks.cross_checks(measured(spark, sf_dir)).select("event_id", *(f"check_{k}" for k in checks.CHECKS), "n_pass", "n_flag", "checks_run")


@query(f"""WITH {CHECKED}, q AS (SELECT *, power(0.2, n_pass) * CASE WHEN focus_stat > 0 THEN 1 - focus_stat / 300 / (focus_stat / 300 + 1) ELSE 1 END * CASE WHEN fred > 0 THEN 1 - 0.6 * least(fred / greatest(excess, 1e-6), 1) ELSE 1 END * CASE WHEN confirmed THEN 1 - least(greatest(coalesce(match, 0), 0), 1) ELSE 1 END * power(0.5, greatest(yes - 1, 0)) AS miss FROM cn)
SELECT event_id, round_even(100 * (1 - miss) * (1 - 0.5 * n_flag / greatest(n_pass + n_flag, 1)), 1) AS confidence_pct, round_even(CAST(n_pass - n_flag AS DOUBLE) / greatest(n_pass + n_flag, 1), 3) AS confidence FROM q""")
def confidence_noisy_or(spark, sf_dir):
    return checks.confidence(checks.cross_checks(measured(spark, sf_dir))).select("event_id", "confidence_pct", "confidence")


@query(f"WITH {CHECKED}, t AS ({' UNION ALL '.join(f"SELECT '{k}' AS \"check\", check_{k} AS status FROM cn" for k in checks.CHECKS)}) SELECT \"check\", status, count(*) AS n FROM t GROUP BY 1, 2")
def check_tally(spark, sf_dir):
    return checks.tally(checks.cross_checks(measured(spark, sf_dir)))


@query(f"WITH {CATALOG} SELECT date, event_no, round(peak_flux, 6) AS peak_flux FROM ev ORDER BY ev.peak_flux DESC, date, event_no LIMIT 8")
def top_events(spark, sf_dir):
    return catalog(spark, sf_dir).orderBy(F.desc("peak_flux"), "date", "event_no").limit(8).select("date", "event_no", *r("peak_flux"))


@query(f"WITH {LC} SELECT DISTINCT date, kind FROM lc WHERE who % 2 = 0 INTERSECT SELECT DISTINCT date, kind FROM lc WHERE who % 5 = 1")
def date_intersect(spark, sf_dir):
    c = curve(spark, sf_dir)
    return c.where("who % 2 = 0").select("date", "kind").intersect(c.where("who % 5 = 1").select("date", "kind"))


@query(f"WITH {LC} SELECT date, who FROM lc WHERE kind = 'click' EXCEPT SELECT date, who FROM lc WHERE kind = 'view'")
def date_except(spark, sf_dir):
    c = curve(spark, sf_dir)
    return c.where("kind = 'click'").select("date", "who").subtract(c.where("kind = 'view'").select("date", "who"))


CELLS = "count(*) FILTER (prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (prob >= 0.5 AND y = 0) AS fp, count(*) FILTER (prob < 0.5 AND y = 1) AS fn, count(*) FILTER (prob < 0.5 AND y = 0) AS tn"


@query(f"""WITH {PRED}, c AS (SELECT date, {CELLS} FROM pr GROUP BY date) SELECT date, tp, fp, fn, tn, round(tp / greatest(tp + fn, 1), 6) AS pod, round(fp / greatest(tp + fp, 1), 6) AS far, round(tp / greatest(tp + fn, 1) - fp / greatest(fp + tn, 1), 6) AS tss,
 round(CASE WHEN (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) = 0 THEN 0 ELSE 2.0 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END, 6) AS hss FROM c""")
def pod_far_tss_hss(spark, sf_dir):
    return skill.contingency(predictions(spark, sf_dir), 0.5, ("date",)).select("date", "tp", "fp", "fn", "tn", *r("pod", "far", "tss", "hss"))


@query(f"WITH {PRED}, b AS (SELECT avg(y) AS base FROM pr) SELECT round(avg(power(prob - y, 2)), 6) AS bs, round(avg(power(base - y, 2)), 6) AS bs_ref, round(1 - avg(power(prob - y, 2)) / avg(power(base - y, 2)), 6) AS bss FROM pr, b")
def brier_skill(spark, sf_dir):
    return skill.brier_skill(predictions(spark, sf_dir)).select(*r("bs", "bs_ref", "bss"))


@query(f"""WITH {PRED}, a AS (SELECT p.prob AS x, n.prob AS z FROM pr p, pr n WHERE p.y = 1 AND n.y = 0) SELECT (SELECT count(*) FROM pr WHERE y = 1) AS n_pos, (SELECT count(*) FROM pr WHERE y = 0) AS n_neg, round(avg(CASE WHEN x > z THEN 1.0 WHEN x = z THEN 0.5 ELSE 0 END), 6) AS auc FROM a""")
def roc_auc_exact(spark, sf_dir):
    return skill.auc(predictions(spark, sf_dir)).select("n_pos", "n_neg", *r("auc"))


@query(f"""WITH {PRED}, th AS (SELECT unnest(range(1, 20)) / 20.0 AS thr), c AS (SELECT thr, count(*) FILTER (prob >= thr AND y = 1) AS tp, count(*) FILTER (prob >= thr AND y = 0) AS fp, count(*) FILTER (prob < thr AND y = 1) AS fn, count(*) FILTER (prob < thr AND y = 0) AS tn FROM pr, th GROUP BY thr),
d AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS q FROM c) SELECT round(thr, 3) AS thr, tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN 0.25 * p + q > 0 THEN 1.25 * p * q / (0.25 * p + q) ELSE 0 END, 6) AS f0_5, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, round(CASE WHEN 4 * p + q > 0 THEN 5 * p * q / (4 * p + q) ELSE 0 END, 6) AS f2 FROM d""")
def threshold_sweep(spark, sf_dir):
    thresholds = spark.range(1, 20).select((F.col("id") / 20.0).alias("thr"))
    return skill.sweep(predictions(spark, sf_dir), thresholds).select(*r("thr", digits=3), "tp", "fp", "fn", "tn", *r("precision", "recall", "f0_5", "f1", "f2"))


@query(f"""WITH {PRED}, t AS (SELECT max(prob) * 1.001 AS top FROM pr), b AS (SELECT least(CAST(floor(prob / top * 10) AS BIGINT), 9) AS bin, prob, y FROM pr, t) SELECT bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(y), 6) AS observed, CAST(sum(y) AS BIGINT) AS positives, CASE WHEN sum(y) < 5 THEN 'thin' WHEN sum(y) < 15 THEN 'ok' ELSE 'solid' END AS support FROM b GROUP BY bin""")
def reliability_bins(spark, sf_dir):
    return skill.reliability(predictions(spark, sf_dir)).select("bin", "n", *r("mean_prob", "observed"), "positives", "support")


@query(f"""WITH {PRED}, d AS (SELECT DISTINCT date FROM pr), n AS (SELECT greatest(1, CAST(round_even(count(*) * 0.3, 0) AS INTEGER)) AS n FROM d), k AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS rk FROM d) SELECT CASE WHEN rk <= n THEN 'test' ELSE 'train' END AS part, pr.date, count(*) AS rows FROM pr JOIN k ON pr.date = k.date, n GROUP BY 1, 2""")
def time_split(spark, sf_dir):
    return skill.time_split(predictions(spark, sf_dir)).groupBy("part", "date").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {PRED} SELECT doc_id, minutes, round(1 - power(1 - prob, minutes / 30.0), 6) AS p FROM pr, (SELECT unnest(range(5, 31, 5)) AS minutes)")
def horizon_spread(spark, sf_dir):
    p = predictions(spark, sf_dir).select("doc_id", "prob", F.explode(F.sequence(F.lit(5).cast("long"), F.lit(30).cast("long"), F.lit(5).cast("long"))).alias("minutes"))
    return p.select("doc_id", "minutes", F.round(scalar.horizon(F.col("prob"), F.col("minutes")), 6).alias("p"))


@query(f"""WITH {READY}, n AS (SELECT date, k, bt, flux / bg_safe AS f FROM w), x AS (SELECT date, k, bt, count(*) OVER o AS n, avg(f) OVER o AS flux_mean, max(f) OVER o AS flux_max, stddev_pop(f) OVER o AS flux_std, avg(f) OVER (PARTITION BY date ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS flux_end,
 regr_slope(f, k) OVER o AS slope, skewness(f) OVER o AS skew FROM n WINDOW o AS (PARTITION BY date ORDER BY k ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING))
SELECT date, k, round(flux_mean, 5) AS flux_mean, round(flux_max, 5) AS flux_max, round(flux_std, 5) AS flux_std, round(flux_end, 5) AS flux_end, round(coalesce(slope, 0), 5) AS flux_trend_slope, round(coalesce(skew, 0), 4) AS flux_skewness FROM x WHERE n = 18 AND k % 3 = 0""")
def sliding_features(spark, sf_dir):
    w = series.day().rowsBetween(-18, -1)
    f = ready(spark, sf_dir).select("date", "k", (F.col("flux") / F.col("bg_safe")).alias("f"))
    n = F.count("f").over(w)
    skew = F.skewness("f").over(w) * F.sqrt(n * (n - 1)) / (n - 2)
    out = f.select("date", "k", n.alias("n"), F.avg("f").over(w).alias("flux_mean"), F.max("f").over(w).alias("flux_max"), F.stddev_pop("f").over(w).alias("flux_std"), F.lag("f").over(series.day()).alias("flux_end"), F.coalesce(F.regr_slope("f", "k").over(w), F.lit(0.0)).alias("flux_trend_slope"), scalar.scrub(skew).alias("flux_skewness"))
    return out.where("n = 18 and k % 3 = 0").select("date", "k", *r("flux_mean", "flux_max", "flux_std", "flux_end", "flux_trend_slope", digits=5), *r("flux_skewness", digits=4))


@query(f"""WITH {CATALOG} SELECT w.date, w.k, CAST(count(ev.start) > 0 AS INTEGER) AS label, round(min(ev.start), 3) AS flare_start FROM w LEFT JOIN ev ON ev.date = w.date AND ev.ratio >= 8 AND ev.start > w.bt AND ev.start <= w.bt + 1800 WHERE w.k % 3 = 0 GROUP BY w.date, w.k""")
def label_lead(spark, sf_dir):
    ends = binned(spark, sf_dir).where("k % 3 = 0").select("date", "k", F.col("bt").alias("t"))
    ev = catalog(spark, sf_dir).where("ratio >= 8").select("date", F.col("start").alias("begun"))
    hit = intervals.interval_join(ev, ends, F.col("begun") - 1800, F.col("begun"), 7200.0).where("t < begun").groupBy("date", "k").agg(F.min("begun").alias("flare_start"))
    return ends.join(hit, ["date", "k"], "left").select("date", "k", F.col("flare_start").isNotNull().cast("int").alias("label"), *r("flare_start", digits=3))


@query("""WITH f AS (SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS name, page_id % 3 AS size FROM pages), done AS (SELECT name, size FROM f WHERE page_id % 2 = 0) SELECT f.page_id FROM f WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.name = f.name AND done.size = f.size)""")
def ledger_anti(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/]+)$", 1).alias("name"), (F.col("page_id") % 3).alias("size"))
    return ledger.pending(files, files.where("page_id % 2 = 0")).select("page_id")


@query("""SELECT DISTINCT unnest(regexp_extract_all('/' || CAST(20240100 + page_id % 31 AS VARCHAR) || '/' || url, '(20\\d{6})', 1)) AS date FROM pages""")
def regex_dates(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), (F.lit(20240100) + F.col("page_id") % 31).cast("string"), F.lit("/"), F.col("url")).alias("path"))
    return instruments.dates_in_paths(paths)


def channels(spark, sf_dir):
    """Embeddings as summed spectra by label: (label, e, counts, area, width)."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    sums = e.groupBy("label", "i").agg(F.sum(F.abs(F.col("x").cast("double")) * 100).alias("counts"))
    return sums.select("label", ((F.col("i") + 1) * 0.0476).alias("e"), "counts", (1 + F.col("i") / 64.0).alias("area"), F.lit(0.0476).alias("width"))


@query()
def isothermal_fit(spark, sf_dir):
    # The stand-in's channels are about flat; a thermal falloff of 0.6 keV gives the fit an inner optimum.
    return spectra.isothermal(channels(spark, sf_dir).withColumn("counts", F.col("counts") * F.exp(-F.col("e") / 0.6) / F.col("e") * F.col("area")), ("label",))


@query("""WITH u AS (SELECT label, abs(CAST(unnest(embedding) AS DOUBLE)) * 100 AS n, unnest(range(1, len(embedding) + 1)) AS ch FROM embeddings), b AS (SELECT label, ch * 0.0476 AS e, sum(n) / power(ch * 0.0476, 3) AS rate FROM u GROUP BY label, ch), f AS (SELECT label, count(*) AS n, -regr_slope(log10(rate), log10(e)) AS g, regr_r2(log10(rate), log10(e)) AS r2, regr_syy(log10(rate), log10(e)) AS syy, regr_sxx(log10(rate), log10(e)) AS sxx FROM b WHERE rate > 0 GROUP BY label) SELECT label, n, round(CASE WHEN g > 1 AND g < 10 THEN g END, 5) AS gamma, round(CASE WHEN g > 1 AND g < 10 THEN g + 1 END, 5) AS delta, round(CASE WHEN g > 1 AND g < 10 AND n > 2 THEN sqrt(greatest(1 - r2, 0) * syy / sxx / (n - 2)) END, 5) AS gamma_err FROM f""")
def power_law_fit(spark, sf_dir):
    rate = channels(spark, sf_dir).select("label", "e", (F.col("counts") / F.pow("e", F.lit(3.0))).alias("rate"))
    return spectra.power_law(rate, ("label",)).select("label", "n", *r("gamma", "delta", "gamma_err", digits=5))
