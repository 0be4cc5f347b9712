"""The registry of queries, and what several of them share: stand-in tables and their SQL.

Events stand in for a photon light curve, embeddings for spectra, labels for predictions. The SQL follows the
definitions of the quantities, not the code beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import STAND_IN
from .operators import detect, series

BIN = STAND_IN.bin_s
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.light_curve(table(spark, sf_dir, "events"))


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rebin(curve(spark, sf_dir), BIN)


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.prepared(binned(spark, sf_dir), STAND_IN)


def r(*names: str, digits: int = 6) -> list:
    return [F.round(F.col(n), digits).alias(n) for n in names]


LC = """lc AS (SELECT strftime(ts, '%Y%m%d') AS date, event_type AS kind, user_id AS who, epoch(ts) AS t, CAST(value AS DOUBLE) AS counts FROM events),
z AS (SELECT date, min(t) AS t0, max(t) AS t1 FROM lc GROUP BY date),
m AS (SELECT lc.date, CAST(floor((t - t0) / 600) AS BIGINT) AS k, avg(counts) AS f, count(*) AS n FROM lc JOIN z ON lc.date = z.date GROUP BY 1, 2),
g AS (SELECT date, t0, unnest(range(0, CAST(floor((t1 - t0) / 600) AS BIGINT) + 1)) AS k FROM z),
s AS (SELECT g.date, g.k, g.t0 + g.k * 600 AS bt, coalesce(f, 0) AS flux, coalesce(n, 0) AS cnt FROM g LEFT JOIN m ON g.date = m.date AND g.k = m.k)"""
READY = (
    LC
    + """, p1 AS (SELECT *, CASE WHEN count(flux) OVER f >= 6 THEN quantile_cont(flux, 0.1) OVER f END AS p, CASE WHEN count(flux) OVER f >= 6 THEN quantile_cont(flux, 0.5) OVER f END AS q FROM s WINDOW f AS (PARTITION BY date ORDER BY k ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
p2 AS (SELECT *, coalesce(last_value(p IGNORE NULLS) OVER b, first_value(p IGNORE NULLS) OVER a) AS bg, coalesce(last_value(q IGNORE NULLS) OVER b, first_value(q IGNORE NULLS) OVER a) AS med FROM p1
 WINDOW b AS (PARTITION BY date ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY date ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
pd AS (SELECT *, abs((flux - bg) - coalesce(lag(flux - bg) OVER (PARTITION BY date ORDER BY k), flux - bg)) AS d FROM p2),
pm AS (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY date ORDER BY k ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) * (1.4826 / sqrt(2)) AS mad FROM pd),
p3 AS (SELECT *, greatest(coalesce(0.1 * quantile_cont(CASE WHEN bg > 0 THEN bg END, 0.5) OVER (PARTITION BY date), 1), 1) AS floor,
 quantile_cont(CASE WHEN mad > 0 THEN mad END, 0.5) OVER (PARTITION BY date) AS mm FROM pm),
w AS (SELECT *, greatest(bg, floor) AS bg_safe, greatest(med, floor) AS mu0, greatest(CASE WHEN mad > 0 THEN mad ELSE coalesce(mm, 1) END, 1) AS noise FROM p3)"""
)
ISLANDS = (
    READY
    + """, a0 AS (SELECT *, (flux - bg_safe) / noise > 1 AS above FROM w),
a1 AS (SELECT *, CASE WHEN above IS DISTINCT FROM lag(above) OVER (PARTITION BY date ORDER BY k) THEN 1 ELSE 0 END AS ch, max(k) OVER (PARTITION BY date) AS top FROM a0),
a2 AS (SELECT *, sum(ch) OVER (PARTITION BY date ORDER BY k) AS no FROM a1),
runs AS (SELECT date, min(k) AS s, least(max(k) + 1, max(top)) AS e FROM a2 WHERE above GROUP BY date, no HAVING max(k) - min(k) + 1 >= 2)"""
)
MERGED = (
    ISLANDS
    + """, b1 AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY date ORDER BY s) IS NULL OR s - lag(e) OVER (PARTITION BY date ORDER BY s) > 2 THEN 1 ELSE 0 END AS new FROM runs),
b2 AS (SELECT *, sum(new) OVER (PARTITION BY date ORDER BY s) AS no FROM b1),
one AS (SELECT date, min(s) AS s, max(e) AS e FROM b2 GROUP BY date, no)"""
)
CATALOG = (
    MERGED
    + """, c1 AS (SELECT one.date, one.s, one.e, w.k, w.bt, w.flux, w.bg, w.bg_safe, w.noise, w.floor, row_number() OVER (PARTITION BY one.date, one.s ORDER BY w.flux DESC, w.k) AS rk,
 first_value(w.bg_safe) OVER (PARTITION BY one.date, one.s ORDER BY w.k) AS b0, first_value(w.bt) OVER (PARTITION BY one.date, one.s ORDER BY w.k) AS start FROM one JOIN (SELECT date FROM w GROUP BY date HAVING count(*) >= 24) g ON g.date = one.date JOIN w ON one.date = w.date AND w.k BETWEEN one.s AND greatest(one.s, one.e - 1)),
ev AS (SELECT c1.date, CAST(row_number() OVER (PARTITION BY c1.date ORDER BY c1.s) AS INTEGER) AS event_no, c1.s, c1.k AS p, c1.e, c1.start, c1.bt AS peak, x.bt AS "end", c1.flux AS peak_flux, c1.bg_safe AS bg,
 c1.flux / c1.bg_safe AS ratio, (c1.flux - c1.bg_safe) / c1.noise AS sigma, c1.bg < c1.floor AS data_gap FROM c1 JOIN w x ON x.date = c1.date AND x.k = c1.e WHERE rk = 1 AND c1.flux >= 1.4 * b0)"""
)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.sigma_events(binned(spark, sf_dir), STAND_IN)



PRED = "pr AS (SELECT doc_id, quality AS y, ((doc_id * 37) % 100) / 100.0::DOUBLE AS prob, CAST(20240101 + doc_id % 12 AS VARCHAR) AS date, CAST(doc_id AS DOUBLE) * 60 AS t FROM labels)"


def predictions(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 37) % 100 / 100.0).alias("prob"), (F.lit(20240101) + F.col("doc_id") % 12).cast("string").alias("date"), (F.col("doc_id") * 60.0).alias("t"))
