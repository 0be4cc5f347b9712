"""Queries of forecast windows, evaluation, models, replay and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .config import STAND_IN
from .operators import detect, features, learning, replay, series, skill
from .queries_events import LIMITS, band_curves
from .registry import CATALOG, LC, PRED, binned, catalog, curve, predictions, query, r, table
from .streaming import live
from .streaming import scan as stream_scan
from .streaming import windows
from .tables import written

# Stand-in: energies of events are their peak flux times a step of their number; 18 bins of look-back, steps of 3.
SIG = (
    CATALOG
    + """, en AS (SELECT *, CASE WHEN event_no % 4 <> 0 THEN peak_flux * (1 + event_no % 3) END AS energy_jm2 FROM ev),
ep AS (SELECT *, quantile_cont(energy_jm2, 0.7) OVER (PARTITION BY date) AS cut, count(energy_jm2) OVER (PARTITION BY date) AS n_en FROM en),
sig AS (SELECT date, event_no, start, "end", ratio FROM ep WHERE ratio >= 4 OR (n_en >= 3 AND energy_jm2 >= cut AND ratio >= 3)),
fb AS (SELECT *, greatest(bg, greatest(coalesce(0.01 * quantile_cont(CASE WHEN flux > 0 THEN flux END, 0.5) OVER (PARTITION BY date), 1e-6), 1e-6)) AS fbg FROM w),
nb AS (SELECT date, k, bt, cnt, flux / fbg AS norm FROM fb)"""
)
GRID = (
    SIG
    + """, dd AS (SELECT date, count(*) AS n, min(bt) AS t0 FROM nb GROUP BY date HAVING count(*) >= 10),
g0 AS (SELECT date, unnest(range(18, n - 1, 3)) AS i, 0 AS dense FROM dd WHERE n - 1 > 18),
g1 AS (SELECT DISTINCT nb.date, nb.k AS i, 1 AS dense FROM sig JOIN dd ON dd.date = sig.date JOIN nb ON nb.date = sig.date AND nb.bt >= sig.start - 1800 - 1e-6 AND nb.bt < sig.start - 1e-6 AND nb.k >= 18 AND nb.k < dd.n - 1),
ge AS (SELECT g.date, g.i, min(dense) AS dense FROM (SELECT * FROM g0 UNION ALL SELECT * FROM g1) g GROUP BY g.date, g.i),
en2 AS (SELECT ge.*, nb.bt AS t FROM ge JOIN nb ON nb.date = ge.date AND nb.k = ge.i)"""
)


def norm(spark, sf_dir):
    """(date, k, bt, cnt, norm): flux over the forecast's background."""
    rows = series.forecast_background(binned(spark, sf_dir), STAND_IN.bg_window, STAND_IN.bg_least)
    return rows.withColumn("norm", F.col("flux") / F.col("bg"))


def energetic(spark, sf_dir):
    ev = catalog(spark, sf_dir)
    return ev.withColumn("energy_jm2", F.when(F.col("event_no") % 4 != 0, F.col("peak_flux") * (1 + F.col("event_no") % 3)))


def sig_events(spark, sf_dir):
    # Few rows that queries join several times: written once.
    return written(features.significant(energetic(spark, sf_dir), STAND_IN), "significant")


def series_of(spark, sf_dir):
    return written(norm(spark, sf_dir), "series")


def ends(spark, sf_dir, sig=None, rows=None):
    return features.grid(rows if rows is not None else series_of(spark, sf_dir), sig if sig is not None else sig_events(spark, sf_dir), STAND_IN)


@query(f"WITH {SIG} SELECT date, event_no FROM sig")
def significant_events(spark, sf_dir):
    return sig_events(spark, sf_dir).select("date", "event_no")


@query(f"WITH {GRID} SELECT date, i, dense, round(t, 3) AS t FROM en2")
def dense_grid(spark, sf_dir):
    return ends(spark, sf_dir).select("date", "i", "dense", *r("t", digits=3))


@query(f"""WITH {GRID} SELECT DISTINCT en2.date, en2.i FROM en2 JOIN nb ON nb.date = en2.date AND nb.k = en2.i JOIN sig ON sig.date = en2.date AND en2.t - sig."end" BETWEEN 0 AND 5400 WHERE en2.t - sig."end" <= 600 OR norm >= 2""")
def decay_exclusion(spark, sf_dir):
    sig, rows = sig_events(spark, sf_dir), series_of(spark, sf_dir)
    return features.in_decay(ends(spark, sf_dir, sig, rows), rows, sig, STAND_IN).select("date", "i")


@query(f"""WITH {GRID} SELECT en2.date, en2.i, CAST(count(sig.start) > 0 AS INTEGER) AS label, round(min(sig.start), 3) AS flare_start FROM en2 LEFT JOIN sig ON sig.date = en2.date AND sig.start > en2.t AND sig.start <= en2.t + 1800 GROUP BY en2.date, en2.i""")
def window_labels(spark, sf_dir):
    sig = sig_events(spark, sf_dir)
    return features.labelled(ends(spark, sf_dir, sig), sig, STAND_IN).select("date", "i", "label", *r("flare_start", digits=3))


@query(f"""WITH {GRID} SELECT en2.date, en2.i, round(coalesce(sum(exp(-(en2.t - sig."end") / 21600)), 0), 6) AS decayed_flare_history, round(least(coalesce(min(en2.t - sig."end") / 60, 1440), 1440), 4) AS time_since_last_flare_min FROM en2 LEFT JOIN sig ON sig.date = en2.date AND sig."end" <= en2.t GROUP BY en2.date, en2.i""")
def hawkes_history(spark, sf_dir):
    sig = sig_events(spark, sf_dir)
    return features.history(written(ends(spark, sf_dir, sig), "ends"), sig, STAND_IN).select("date", "i", *r("decayed_flare_history"), *r("time_since_last_flare_min", digits=4))


def side_series(spark, sf_dir, flux=None):
    """Stand-in bands and hard series on the grid: binned fluxes of kinds of events, over the background."""
    rows = curve(spark, sf_dir)
    start = (flux if flux is not None else norm(spark, sf_dir)).select("date", "k", "bg").where("bg > 0")
    base = series.spans(rows, ("date",)).select("date", "t0")
    placed = rows.join(base, "date").withColumn("k", F.floor((F.col("t") - F.col("t0")) / STAND_IN.bin_s))
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("counts")))
    by = placed.groupBy("date", "k").agg(mean("click").alias("a"), mean("view").alias("b"), mean("purchase").alias("c"), mean("signup").alias("h"))
    return by.join(start, ["date", "k"]).select("date", "k", *[(F.col(x) / F.col("bg")).alias(x) for x in ("a", "b", "c", "h")])


FEATURES_SQL = """, kd AS (SELECT lc.date, CAST(floor((t - t0) / 600) AS BIGINT) AS k, avg(CASE WHEN kind = 'click' THEN counts END) AS a, avg(CASE WHEN kind = 'view' THEN counts END) AS b, avg(CASE WHEN kind = 'purchase' THEN counts END) AS c, avg(CASE WHEN kind = 'signup' THEN counts END) AS h FROM lc JOIN z ON z.date = lc.date GROUP BY ALL),
ra AS (SELECT fb.date, fb.k, fb.cnt, flux / fbg AS f, a / fbg AS a, b / fbg AS b, c / fbg AS c, h / fbg AS h FROM fb LEFT JOIN kd ON kd.date = fb.date AND kd.k = fb.k),
rb AS (SELECT *, f - lag(f) OVER o AS df, h - lag(h) OVER o AS dh, CASE WHEN a IS NOT NULL THEN b / greatest(a, 1e-6) END AS q FROM ra WINDOW o AS (PARTITION BY date ORDER BY k)),
mw AS (SELECT en2.date, en2.i, CAST(rb.k - en2.i + 18 AS DOUBLE) AS j, rb.* EXCLUDE (date, k) FROM en2 JOIN rb ON rb.date = en2.date AND rb.k >= en2.i - 18 AND rb.k < en2.i),
a AS (SELECT date, i, count(f) AS n, count(h) AS nh, count(a) AS na, avg(f) AS flux_mean, max(f) AS flux_max, avg(CASE WHEN j >= 17 THEN f END) AS flux_end, regr_slope(f, j) AS flux_trend_slope, stddev_pop(f) AS flux_std, avg(CASE WHEN j >= 1 THEN df END) AS dflux_mean, max(CASE WHEN j >= 1 THEN df END) AS dflux_max,
 avg(CASE WHEN j >= 1 THEN CAST(df > 0 AS INTEGER) END) AS dflux_pos_frac, avg(a) AS flux_bandA, avg(b) AS flux_bandB, avg(c) AS flux_bandC, regr_slope(q, j) AS ratio_B_A_trend, avg(CASE WHEN j >= 17 THEN q END) AS ratio_B_A_end, avg(CASE WHEN j < 1 THEN f END) AS flux_start, skewness(f) AS flux_skewness,
 avg(h) AS helos_flux_mean, max(h) AS helos_flux_max, regr_slope(h, j) AS helos_trend_slope, stddev_pop(h) AS helos_std, max(CASE WHEN j >= 1 THEN dh END) AS helos_dflux_max, avg(CASE WHEN j >= 17 THEN h END) AS h1, avg(CASE WHEN j < 1 THEN h END) AS h0, corr(f, h) AS c0, avg(CASE WHEN cnt > 0 THEN 1.0 ELSE 0 END) AS seen FROM mw GROUP BY date, i)"""
_PLAIN = ("flux_mean", "flux_max", "flux_end", "flux_trend_slope", "flux_std", "dflux_mean", "dflux_max", "dflux_pos_frac", "flux_bandA", "flux_bandB", "flux_bandC", "ratio_B_A_trend", "ratio_B_A_end", "flux_start", "flux_skewness", "helos_flux_mean", "helos_flux_max", "helos_trend_slope", "helos_std", "helos_dflux_max")
_MADE = {
    "excess_above_bg": "flux_max - 1",
    "max_sigma": "flux_max",
    "ratio_B_A": "CASE WHEN na > 0 THEN flux_bandB / greatest(flux_bandA, 1e-6) END",
    "ratio_C_total": "CASE WHEN na > 0 THEN flux_bandC / greatest(flux_bandA + flux_bandB + flux_bandC, 1e-6) END",
    "spectral_slope": "CASE WHEN na > 0 THEN log10(greatest(flux_bandC, 1e-6)) / greatest(log10(greatest(flux_bandA, 1e-6)), 1e-6) END",
    "recent_vs_early": "flux_end / greatest(flux_start, 1e-6)",
    "helos_max_sigma": "helos_flux_max",
    "helos_recent_vs_early": "CASE WHEN h0 IS NOT NULL THEN h1 / greatest(h0, 1e-6) END",
    "helos_precursor": "CASE WHEN nh > 0 AND isfinite(coalesce(helos_trend_slope, 0)) AND coalesce(helos_trend_slope, 0) > 0 AND coalesce(flux_trend_slope, 0) <= 0 THEN 1e0 ELSE 0e0 END",
    "helos_to_solexs_ratio": "helos_flux_mean / greatest(flux_mean, 1e-6)",
    "helos_lead_signal": "h0",
    "cross_corr": "CASE WHEN nh = n AND flux_std > 0 AND helos_std > 0 THEN c0 END",
    "hard_soft_trend_diff": "CASE WHEN nh > 0 THEN coalesce(CASE WHEN isfinite(helos_trend_slope) THEN helos_trend_slope END, 0) - coalesce(flux_trend_slope, 0) END",
    "data_gap_frac": "1 - seen",
}
_COLUMNS = [(x, x) for x in _PLAIN] + list(_MADE.items())
# A slope against six decimals of a ratio in the millions differs in its last places between engines.
_DIGITS = {"spectral_slope": 2}


@query(f"WITH {GRID}{FEATURES_SQL} SELECT date, i, {', '.join(f'round(CASE WHEN isfinite(coalesce({e}, 0)) THEN coalesce({e}, 0) ELSE 0 END, {_DIGITS.get(x, 4)}) + 0 AS {x}' for x, e in _COLUMNS)} FROM a")
def window_features(spark, sf_dir):
    rows = series_of(spark, sf_dir)
    side = side_series(spark, sf_dir, rows)
    out = features.features(ends(spark, sf_dir, rows=rows), rows, STAND_IN, side, side)
    return out.select("date", "i", *[(F.round(F.col(x), _DIGITS.get(x, 4)) + 0).alias(x) for x, _ in _COLUMNS])


HARD = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in LIMITS.items() if a >= 20)


@query(f"""WITH {GRID}, lim(kind, e_lo, e_hi) AS (VALUES {HARD}), bw AS (SELECT en2.date, en2.i, en2.t AS t1, lim.e_lo, lim.e_hi, lc.t, lc.counts FROM en2 JOIN lc ON lc.date = en2.date AND lc.t BETWEEN en2.t - 10800 AND en2.t JOIN lim ON lim.kind = lc.kind),
p AS (SELECT date, i, 0 AS part, e_lo, e_hi, counts FROM bw UNION ALL SELECT date, i, 1, e_lo, e_hi, counts FROM bw WHERE t <= t1 - 5400 UNION ALL SELECT date, i, 2, e_lo, e_hi, counts FROM bw WHERE t >= t1 - 5400),
q AS (SELECT date, i, part, e_lo, e_hi, avg(counts) AS rate FROM p GROUP BY ALL HAVING count(*) >= 2), sg AS (SELECT date, i, part, CASE WHEN count(*) >= 2 THEN -regr_slope(log10(rate / (e_hi - e_lo)), log10((e_lo + e_hi) / 2)) END AS g FROM q WHERE rate > 0 GROUP BY date, i, part),
v AS (SELECT date, i, part, CASE WHEN g > 0.5 AND g < 12 THEN g END AS g FROM sg) SELECT a.date, a.i, round(a.g, 5) AS gamma_window, round(coalesce(l.g - e.g, 0), 5) AS gamma_trend FROM v a LEFT JOIN v e ON e.date = a.date AND e.i = a.i AND e.part = 1 LEFT JOIN v l ON l.date = a.date AND l.i = a.i AND l.part = 2 WHERE a.part = 0 AND a.g IS NOT NULL""")
def window_gamma(spark, sf_dir):
    return features.gammas(ends(spark, sf_dir), band_curves(spark, sf_dir), STAND_IN).select("date", "i", *r("gamma_window", "gamma_trend", digits=5))


@query(f"""WITH {GRID}, tw AS (SELECT en2.date, en2.i, (lc.t - (en2.t - 10800)) / 60 AS x, lc.counts AS y FROM en2 JOIN lc ON lc.date = en2.date AND lc.kind = 'view' AND lc.t BETWEEN en2.t - 10800 AND en2.t) SELECT date, i, round(regr_slope(y, x), 6) AS trend FROM tw GROUP BY date, i HAVING count(*) >= 3""")
def temperature_trend(spark, sf_dir):
    t = curve(spark, sf_dir).where("kind = 'view'").select("date", "t", F.col("counts").alias("t_mk"))
    return features.temperature_trend(ends(spark, sf_dir), t, STAND_IN).select("date", "i", F.round("temp_trend_MK_per_min", 6).alias("trend"))


@query("""WITH x AS (SELECT event_id, CAST(value AS DOUBLE) / 10 AS e, CAST(value AS DOUBLE) / 25 AS s, CAST(event_id % 7 AS DOUBLE) AS b, (event_id % 5 - 2) / 4.0 AS g, (event_id % 11 - 5) / 50.0 AS h FROM events)
SELECT event_id, round(1 / (1 + exp(-(e - 8) / 3)) * (1 / (1 + exp(-(s - 3) / 1.5))) * (1 / (1 + exp(-(b - 3) / 2))) * (1 / (1 + exp(-(-g - 0.3) / 0.3))) * (1 / (1 + exp(-(h - 0.05) / 0.05))), 8) AS precursor_concentration FROM x""")
def precursor_score(spark, sf_dir):
    v, i = F.col("value").cast("double"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (v / 10).alias("excess_above_bg"), (v / 25).alias("max_sigma"), (i % 7).cast("double").alias("n_micro_peaks"), ((i % 5 - 2) / 4.0).alias("gamma_trend"), ((i % 11 - 5) / 50.0).alias("temp_trend_MK_per_min"))
    return features.precursor(rows).select("event_id", F.round("precursor_concentration", 8).alias("precursor_concentration"))


def dataset(spark, sf_dir):
    """Windows with all 43 features, as rows (date, t, y, dense, features..)."""
    rows = series_of(spark, sf_dir)
    side = written(side_series(spark, sf_dir, rows), "side")
    temps = curve(spark, sf_dir).where("kind = 'view'").select("date", "t", F.col("counts").alias("t_mk"))
    return features.windows(rows, energetic(spark, sf_dir), STAND_IN, side, side, band_curves(spark, sf_dir), temps)


def samples(spark, sf_dir):
    # Models read their rows many times.
    return written(dataset(spark, sf_dir).withColumnsRenamed({"window_end_unix": "t", "label": "y"}), "windows")


@query()
def window_dataset(spark, sf_dir):
    return dataset(spark, sf_dir)


@query()
def class_balance(spark, sf_dir):
    return features.balance(dataset(spark, sf_dir))


@query(f"""WITH {LC}, dv AS (SELECT date, count(*) AS n, greatest(stddev_pop(flux), 1e-6) * 0.5 AS least FROM s GROUP BY date),
sr AS (SELECT date, k, flux, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY date ORDER BY k) AS run FROM (SELECT date, k, flux, flux IS DISTINCT FROM lag(flux) OVER (PARTITION BY date ORDER BY k) AS new FROM s)),
st AS (SELECT date, run, min(k) AS a, max(k) AS b, max(flux) AS y FROM sr GROUP BY date, run),
tp AS (SELECT date, (a + b) // 2 AS k, y FROM st QUALIFY y > lag(y) OVER (PARTITION BY date ORDER BY run) AND y > lead(y) OVER (PARTITION BY date ORDER BY run)),
hi AS (SELECT tp.date, tp.k, tp.y, coalesce(max(s.k) FILTER (s.k < tp.k AND s.flux > tp.y), -1) AS lo, coalesce(min(s.k) FILTER (s.k > tp.k AND s.flux > tp.y), 1000000) AS up FROM tp JOIN s ON s.date = tp.date GROUP BY 1, 2, 3),
pr AS (SELECT hi.date, hi.k, hi.y, hi.y - greatest(min(s.flux) FILTER (s.k <= hi.k), min(s.flux) FILTER (s.k >= hi.k)) AS prominence FROM hi JOIN s ON s.date = hi.date AND s.k > hi.lo AND s.k < hi.up GROUP BY 1, 2, 3)
SELECT dv.date, CAST(count(pr.k) AS INTEGER) AS n_peaks, round(coalesce(avg(pr.y), 0), 8) AS micro_energy FROM dv LEFT JOIN pr ON pr.date = dv.date AND pr.prominence >= dv.least AND dv.n >= 5 GROUP BY dv.date""")
def micro_peaks(spark, sf_dir):
    rows = binned(spark, sf_dir).groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "flux"))), lambda x: x["flux"]).alias("y"))
    return rows.select("date", features.micro_peaks("y").alias("x")).select("date", F.col("x.n").alias("n_peaks"), F.round("x.height", 8).alias("micro_energy"))


@query(f"""WITH {PRED}, f AS (SELECT date AS test_date, min(t) AS fs, row_number() OVER (ORDER BY date DESC) AS fold, count(*) OVER () AS n FROM pr GROUP BY date), g AS (SELECT * FROM f WHERE fold <= 4 AND fold < n),
c AS (SELECT CAST(fold AS INTEGER) AS fold, test_date, count(*) FILTER (date < test_date AND t < fs - 120) AS n_train, count(*) FILTER (date = test_date) AS n_test, coalesce(sum(y) FILTER (date < test_date AND t < fs - 120), 0) AS pos FROM g, pr WHERE date <= test_date GROUP BY 1, 2) SELECT fold, test_date, n_train, n_test FROM c WHERE pos > 0""")
def walk_forward_folds(spark, sf_dir):
    return skill.walk_forward(predictions(spark, sf_dir), 4, 120.0)


@query(f"""WITH {PRED}, a AS (SELECT date, t, prob >= 0.5 AS alarm, lag(prob >= 0.5) OVER (PARTITION BY date ORDER BY t) AS was FROM pr) SELECT date, t, CASE WHEN alarm THEN 'raised' ELSE 'all-clear' END AS what FROM a WHERE alarm <> coalesce(was, false)""")
def alarm_transitions(spark, sf_dir):
    return skill.transitions(predictions(spark, sf_dir), 0.5)


@query(f"""WITH {PRED}, c AS (SELECT least(greatest(avg(y), 1e-6), 1 - 1e-6) AS base FROM pr WHERE date < '20240109') SELECT doc_id, round(base, 6) AS climatology, CASE WHEN prob * 3 >= 1.5 THEN 0.999e0 ELSE 0.001e0 END AS persistence FROM pr, c WHERE date >= '20240109'""")
def baselines(spark, sf_dir):
    p = predictions(spark, sf_dir)
    base = skill.climatology(p.where("date < '20240109'"))
    return p.where("date >= '20240109'").crossJoin(F.broadcast(base)).select("doc_id", F.round("base", 6).alias("climatology"), skill.persistence(F.col("prob") * 3).alias("persistence"))


LADDER = f"""{PRED}, qs AS (SELECT unnest(list_concat(quantile_cont(prob, {[round(0.02 + i * (0.995 - 0.02) / 39, 12) for i in range(40)]}), list_transform(range(1, 19), lambda i: i / 20.0))) AS q FROM pr), th AS (SELECT DISTINCT round_even(q, 3) AS thr FROM qs WHERE round_even(q, 3) > 0 AND round_even(q, 3) < 1),
c AS (SELECT thr, count(*) FILTER (prob >= thr AND y = 1) AS tp, count(*) FILTER (prob >= thr AND y = 0) AS fp, count(*) FILTER (prob < thr AND y = 1) AS fn, count(*) FILTER (prob < thr AND y = 0) AS tn FROM pr, th GROUP BY thr), d AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS q FROM c),
sw AS (SELECT *, 1.25 * p * q / greatest(0.25 * p + q, 1e-9) AS f0_5, 2 * p * q / greatest(p + q, 1e-9) AS f1, 5 * p * q / greatest(4 * p + q, 1e-9) AS f2, tp / greatest(tp + fn, 1) - fp / greatest(fp + tn, 1) AS tss FROM d)"""


@query(f"WITH {LADDER} SELECT round(thr, 3) AS thr, tp, fp, fn, round(f0_5, 6) AS f0_5, round(f1, 6) AS f1, round(f2, 6) AS f2, round(tss, 6) AS tss FROM sw")
def adaptive_sweep(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return skill.sweep(p, skill.ladder(p)).select(*r("thr", digits=3), "tp", "fp", "fn", *r("f0_5", "f1", "f2", "tss"))


@query(f"""WITH {LADDER}, k AS (SELECT * FROM sw) SELECT (SELECT thr FROM k ORDER BY round(f0_5, 9) DESC, thr LIMIT 1) AS "f0.5", (SELECT thr FROM k ORDER BY round(f1, 9) DESC, thr LIMIT 1) AS f1, (SELECT thr FROM k ORDER BY round(f2, 9) DESC, thr LIMIT 1) AS f2, (SELECT thr FROM k ORDER BY round(tss, 9) DESC, thr LIMIT 1) AS tss""")
def best_thresholds(spark, sf_dir):
    p = predictions(spark, sf_dir)
    swept = skill.sweep(p, skill.ladder(p))
    return skill.best_thresholds(swept.withColumns({c: F.round(F.col(c), 9) for c in skill.OBJECTIVES.values()}))


@query(f"""WITH {PRED}, c AS (SELECT count(*) FILTER (prob >= 0.5 AND y = 1) AS correct_alarm, count(*) FILTER (prob < 0.5 AND y = 0) AS correct_quiet, count(*) FILTER (prob >= 0.5 AND y = 0) AS false_alarm, count(*) FILTER (prob < 0.5 AND y = 1) AS missed FROM pr) SELECT * FROM c""")
def referee_tally(spark, sf_dir):
    return skill.referee(predictions(spark, sf_dir), 0.5)


@query(f"""WITH {PRED}, a AS (SELECT p.prob AS x, n.prob AS z FROM pr p, pr n WHERE p.y = 1 AND n.y = 0), u AS (SELECT avg(CASE WHEN x > z THEN 1.0 WHEN x = z THEN 0.5 ELSE 0 END) AS auc FROM a), b AS (SELECT avg(y) AS base FROM pr), s AS (SELECT 1 - avg(power(prob - y, 2)) / avg(power(base - y, 2)) AS bss FROM pr, b),
c AS (SELECT count(*) FILTER (prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (prob >= 0.5 AND y = 0) AS fp, count(*) FILTER (prob < 0.5 AND y = 1) AS fn, count(*) FILTER (prob < 0.5 AND y = 0) AS tn FROM pr)
SELECT round(tp / greatest(tp + fn, 1) - fp / greatest(fp + tn, 1), 6) AS tss, round(2.0 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS hss, round(bss, 6) AS bss, round(tp / greatest(tp + fn, 1), 6) AS pod, round(fp / greatest(tp + fp, 1), 6) AS far, round(auc, 6) AS auc FROM c, s, u""")
def skill_report(spark, sf_dir):
    return skill.report(predictions(spark, sf_dir)).select(*r("tss", "hss", "bss", "pod", "far", "auc"))


# A flare stand-in: positives announce the next start on a grid of two hours.
FLARES = f"{PRED}, fl AS (SELECT *, CASE WHEN y = 1 THEN (floor(t / 7200) + 1) * 7200 END AS flare_start FROM pr)"


def flares(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("flare_start", F.when(F.col("y") == 1, (F.floor(F.col("t") / 7200) + 1) * 7200.0))


@query(f"WITH {FLARES} SELECT date, flare_start, round((flare_start - min(t)) / 60, 4) AS lead_min FROM fl WHERE y = 1 AND prob >= 0.5 GROUP BY date, flare_start")
def lead_time(spark, sf_dir):
    return skill.lead_times(flares(spark, sf_dir), 0.5).select("date", "flare_start", *r("lead_min", digits=4))


@query("""WITH m AS (SELECT label % 5 AS model, count(*) AS n, avg(vec_id % 17) / 17 - 0.3 AS tss, avg(vec_id % 13) / 13 AS auc FROM embeddings GROUP BY 1), q AS (SELECT *, tss > 0.16 AS beats FROM m) SELECT 'm' || model AS model, round(tss, 6) AS tss, round(auc, 6) AS auc, (SELECT count(*) FROM q WHERE beats) AS n_beating FROM q ORDER BY beats DESC, CASE WHEN beats THEN tss ELSE auc END DESC, model LIMIT 1""")
def model_select(spark, sf_dir):
    m = (F.col("label") % 5).alias("m")
    rows = table(spark, sf_dir, "embeddings").groupBy(m).agg((F.avg(F.col("vec_id") % 17) / 17 - 0.3).alias("tss"), (F.avg(F.col("vec_id") % 13) / 13).alias("auc"))
    candidates = rows.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), F.col("m").alias("ordinal"), "tss", "auc")
    return skill.selected(candidates, 0.16).select("model", *r("tss", "auc"), F.col("n_beating").cast("long").alias("n_beating"))


@query(f"""WITH {FLARES}, st AS (SELECT DISTINCT date, flare_start FROM fl WHERE y = 1), al AS (SELECT date, t FROM fl WHERE prob >= 0.5), c AS (SELECT st.date, st.flare_start, (st.flare_start - min(al.t)) / 60 AS lead FROM st LEFT JOIN al ON al.date = st.date AND al.t < st.flare_start AND al.t >= st.flare_start - 1800 GROUP BY 1, 2),
f AS (SELECT date, count(*) AS flares, count(lead) AS caught, avg(lead) AS mean_lead_min FROM c GROUP BY date), x AS (SELECT date, count(*) AS false_steps FROM al WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.date = al.date AND st.flare_start - al.t BETWEEN 0 AND 1800) GROUP BY date),
u AS (SELECT date, prob >= 0.5 AND NOT coalesce(lag(prob >= 0.5) OVER (PARTITION BY date ORDER BY t), false) AS up FROM fl), n AS (SELECT date, count(*) FILTER (up) AS alerts FROM u GROUP BY date)
SELECT n.date, coalesce(flares, 0) AS flares, coalesce(caught, 0) AS caught, round(mean_lead_min, 4) AS mean_lead_min, coalesce(false_steps, 0) AS false_steps, alerts FROM n LEFT JOIN f ON f.date = n.date LEFT JOIN x ON x.date = n.date""")
def replay_scorecard(spark, sf_dir):
    return replay.scorecard(flares(spark, sf_dir), 0.5).select("date", "flares", "caught", *r("mean_lead_min", digits=4), "false_steps", "alerts")


@query(f"""WITH {CATALOG} SELECT w.date, w.k, round(min(ev.start), 3) AS next_start FROM w LEFT JOIN ev ON ev.date = w.date AND ev.ratio >= 4 AND ev.start > w.bt WHERE w.k % 6 = 0 GROUP BY w.date, w.k""")
def next_significant(spark, sf_dir):
    moments = binned(spark, sf_dir).where("k % 6 = 0").select("date", "k", F.col("bt").alias("t"))
    return replay.next_significant(moments, catalog(spark, sf_dir).where("ratio >= 4").select("date", "start")).select("date", "k", *r("next_start", digits=3))


@query(f"""WITH {CATALOG} SELECT date, event_no FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.date = ev.date AND b.ratio >= 4 AND abs(ev.start - b.start) < 60)""")
def minor_flares_anti(spark, sf_dir):
    ev = catalog(spark, sf_dir)
    return replay.minor(ev, ev.where("ratio >= 4").select("date", "start")).select("date", "event_no")


@query("""WITH lc AS (SELECT strftime(ts, '%Y%m%d') AS date, epoch(ts) AS t, CAST(value AS DOUBLE) AS counts FROM events WHERE epoch(ts) <= epoch(strptime('20240115 14:30', '%Y%m%d %H:%M'))), z AS (SELECT date, min(t) AS t0, max(t) AS t1 FROM lc GROUP BY date),
m AS (SELECT lc.date, CAST(floor((t - t0) / 600) AS BIGINT) AS k, avg(counts) AS f FROM lc JOIN z ON z.date = lc.date GROUP BY 1, 2), g AS (SELECT date, unnest(range(0, CAST(floor((t1 - t0) / 600) AS BIGINT) + 1)) AS k FROM z) SELECT g.date, g.k, round(coalesce(f, 0), 6) AS flux FROM g LEFT JOIN m ON m.date = g.date AND m.k = g.k""")
def moment_truncate(spark, sf_dir):
    rows = replay.truncated(curve(spark, sf_dir), replay.moment("20240115", "14:30"))
    return series.rebin(rows, STAND_IN.bin_s).select("date", "k", *r("flux"))


@query()
def lr_forecast(spark, sf_dir):
    return learning.forecast(samples(spark, sf_dir), "logistic").select("date", "t", "y", "prob")


@query()
def rf_forecast(spark, sf_dir):
    return learning.forecast(samples(spark, sf_dir), "forest_shallow").select("date", "t", "y", "prob")


@query()
def gbt_forecast(spark, sf_dir):
    # The operator's default is 300 rounds; one round is a job for each of four levels, so the query takes twenty.
    return learning.forecast(samples(spark, sf_dir), "boosted", maxIter=20).select("date", "t", "y", "prob")


@query()
def mlp_forecast(spark, sf_dir):
    return learning.forecast(samples(spark, sf_dir), "perceptron").select("date", "t", "y", "prob")


@query()
def out_of_fold_calibration(spark, sf_dir):
    """Fitted on the earlier folds' scores, shown on the last fold's."""
    oof = written(learning.out_of_fold(samples(spark, sf_dir), "logistic"), "scored")
    last = F.col("test_date") == oof.agg(F.max("test_date")).first()[0]
    return learning.calibrator(oof.where(~last)).transform(oof.where(last)).select("fold", "date", "t", "y", "prob", "calibrated")


@query()
def platt(spark, sf_dir):
    p = predictions(spark, sf_dir)
    early, late = p.where("date < '20240109'"), p.where("date >= '20240109'")
    return learning.Calibrator(early, "platt").transform(late).select("doc_id", "prob", "calibrated")


@query()
def isotonic_calibration(spark, sf_dir):
    p = predictions(spark, sf_dir)
    early, late = p.where("date < '20240109'"), p.where("date >= '20240109'")
    return learning.Calibrator(early, "isotonic").transform(late).select("doc_id", "prob", "calibrated")


@query()
def walk_forward_summary(spark, sf_dir):
    oof = written(learning.out_of_fold(samples(spark, sf_dir), "logistic"), "scored")
    return skill.fold_summary(oof)


def event_feed(spark, sf_dir):
    return windows.source(spark, sf_dir, "events.parquet")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS bin, round(avg(value), 6) AS flux, count(*) AS cnt FROM events GROUP BY 1")
def stream_tumbling(spark, sf_dir):
    return windows.to_table(windows.tumbled(event_feed(spark, sf_dir), "1 hour")).select(F.unix_seconds("bin").alias("bin"), *r("flux"), "cnt")


@query("""WITH w AS (SELECT unnest(range(0, 6)) AS back), e AS (SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 AS step, CAST(value AS DOUBLE) AS v FROM events)
SELECT step - 1800 * back AS "start", step - 1800 * back + 10800 AS "end", round(avg(v), 6) AS flux_mean, max(v) AS flux_max, round(stddev_pop(v), 6) AS flux_std, count(*) AS cnt FROM e, w GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    out = windows.to_table(windows.slid(event_feed(spark, sf_dir), "3 hours", "30 minutes"))
    return out.select(F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), *r("flux_mean"), "flux_max", *r("flux_std"), "cnt")


@query("""WITH a AS (SELECT event_type, epoch_us(ts) AS t, value AS v FROM events WHERE value > 60), b AS (SELECT *, CASE WHEN t - lag(t) OVER o <= 1800000000 THEN 0 ELSE 1 END AS new FROM a WINDOW o AS (PARTITION BY event_type ORDER BY t)),
c AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY t) AS no FROM b) SELECT event_type, min(t) AS "start", max(t) + 1800000000 AS "end", max(v) AS top, count(*) AS cnt FROM c GROUP BY event_type, no""")
def stream_session(spark, sf_dir):
    out = windows.to_table(windows.sessions(event_feed(spark, sf_dir), 60.0, "30 minutes"))
    return out.select("event_type", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "top", "cnt")


@query()
def stream_focus(spark, sf_dir):
    """The keyed scan over a stream; tests hold it against the scan of a finished table, in one and in many batches."""
    return windows.to_table(stream_scan.scanned(event_feed(spark, sf_dir), STAND_IN))


@query()
def live_alarms(spark, sf_dir):
    """A day's forecast as a stream: windows of what was known, chances by a model of finished days, changes of the alarm."""
    model = learning.fitted(samples(spark, sf_dir), "logistic")
    feed = live.live_windows(event_feed(spark, sf_dir), STAND_IN, {"click": "a", "view": "b", "purchase": "c", "signup": "h"})
    return windows.to_table(live.alarms(feed.map(lambda rows: learning.scored(model, rows)), 0.5))


@query()
def replay_causal(spark, sf_dir):
    """Detection on what was known at a moment: raw samples are cut before anything is made of them."""
    rows = replay.truncated(curve(spark, sf_dir), replay.moment("20240115", "14:30"))
    return detect.focus_events(series.rebin(rows, STAND_IN.bin_s), STAND_IN)
