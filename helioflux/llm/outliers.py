"""Quality rules: base counts of every text, and robust multivariate outliers by language and source.

Base counts come from one pass over whole texts. Transformed statistics of each (language, source) group then get
a reweighted minimum-covariance-determinant estimate (Rousseeuw and Van Driessen, 1999) over all rows of the group:

1. Two starts, medians with quartile ranges and the plain moments. A concentration step takes distances under the
   present estimate, and the mean and covariance of the nearest three quarters; steps go on until no group's
   determinant falls any more. Of both ends a group keeps the one with the smaller determinant.
2. The covariance is scaled to be consistent for normal rows, and rows within its 0.975 quantile give the final
   mean and covariance, scaled again.

A step is two aggregations with partial sums over a table of counts that is small beside the texts; a group is
never brought together, so it may hold any share of the rows. A group counts ``SHRINK`` rows of its language on
top of its own, a language as many of the whole table, so an estimate fades into the next wider one as rows get
few. Each axis has a floor: most texts have no symbols or repeated lines at all, and three quarters of equal values
would otherwise make any other value infinitely distant.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, gamma, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import discard, spill
from .textblocks import SPACED, Block, blocks, distinct_sets, mix, sequence_hashes, span_hashes, starts_of_code_points, words

#: Characters that count as symbols
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
AXES = 5
#: Standard deviations added to each axis: log words, log word length, symbols, repeated lines, repeated words
FLOORS = (0.5, 0.15, 0.3, 0.3, 0.3)
SUPPORT, REWEIGHT = 0.75, 0.975
#: Most concentration steps; they end sooner when no log determinant falls by STILL
STEPS, STILL = 10, 0.02
#: Rows of the next wider group that count beside a group's own
SHRINK = 50.0
#: Estimates of up to so many groups are broadcast (52 numbers each); beyond, a group's rows are dealt over SALTS parts
BROADCAST_GROUPS, SALTS = 10_000, 32
#: A fiftieth of a distance: bins of the histograms
FINE = 50


def chi_square(x: float, df: int) -> float:
    """Distribution function for an odd number of degrees of freedom."""
    out = erf(sqrt(x / 2))
    for k in range(1, df, 2):
        out -= (x / 2) ** (k / 2) * exp(-x / 2) / gamma(k / 2 + 1)
    return out


def quantile(p: float, df: int = AXES) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, df) < p else (low, mid)
    return high


def consistency(p: float) -> float:
    """Scale of the covariance of the nearest share p of normal rows."""
    return p / chi_square(quantile(p), AXES + 2)


#: Three times the 0.999 quantile: text statistics have heavier tails than the normal
CUTOFF = 3 * quantile(0.999)


def counts(block: Block) -> dict[str, np.ndarray]:
    w = words(block, SPACED)
    chars = starts_of_code_points(block.data)
    per_word = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[block.data])])
    # Lines: cut after each line feed and at document ends.
    feed = np.flatnonzero(block.data == 10)
    start = np.unique(np.concatenate([block.at[:-1], feed + 1]))
    start = start[start < len(block.data)]
    end = np.minimum(np.concatenate([start[1:], [len(block.data)]]), len(block.data)) if len(start) else start
    end = np.where((end > start) & (block.data[np.maximum(end - 1, 0)] == 10), end - 1, end) if len(start) else end
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start) if len(start) else np.zeros(0, bool)
    start, end = start[full], end[full]
    bounds = np.searchsorted(start, block.at)
    _, unique = distinct_sets(span_hashes(block.data, start, end, fold=False), bounds)
    # Windows of three words found twice or more in their text.
    n_words = w.counts
    hashes, first = sequence_hashes(span_hashes(block.data, w.start, w.end, fold=False), w.doc, 3)
    of = np.repeat(np.arange(block.n), np.diff(np.searchsorted(first, w.doc)))
    long_ = n_words[of] >= 3
    hashes, first, of = hashes[long_], first[long_], of[long_]
    key = mix(hashes ^ mix(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.start) + 4, dtype=np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + 3, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[: len(w.start)]) > 0)])
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": per_word[w.doc[1:]] - per_word[w.doc[:-1]],
        "n_symbols": symbols[block.at[1:]] - symbols[block.at[:-1]],
        "n_dup_lines": np.diff(bounds) - np.diff(unique),
        "n_repeat_words": covered[w.doc[1:]] - covered[w.doc[:-1]],
    }


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            own = counts(block)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(block.first, block.n) for i in (0, 2, 3)), *(pa.array(own[c].astype(np.int64)) for c in COUNTS)], ["doc_id", "lang", "source", *COUNTS])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (null: empty) and the base counts of every row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text("lang").alias("lang"), text("source").alias("source"))
    return rows.mapInArrow(_counter, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def axes() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log1p(F.col("n_words").cast("double")), F.log(chars / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n)]


PAIRS = [(i, j) for i in range(AXES) for j in range(i, AXES)]
_X = [f"x{i}" for i in range(AXES)]
_MOMENTS = ["m", *(f"s{i}" for i in range(AXES)), *(f"q{i}{j}" for i, j in PAIRS)]
_ESTIMATE = ["log_det", "was", *(f"c{i}" for i in range(AXES)), *(f"v{i}{j}" for i, j in PAIRS)]


def estimate(m: float, s: np.ndarray, q: np.ndarray, scale: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Log determinant, mean and inverse of the scaled and floored covariance, from a count, sums and sums of products."""
    mean = s / max(m, 1e-9)
    spread = scale * (q / max(m, 1e-9) - np.outer(mean, mean)) + np.diag(np.square(FLOORS))
    return float(np.linalg.slogdet(spread)[1]), mean, np.linalg.inv(spread)


def _estimates(scale: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                q = np.zeros((AXES, AXES))
                for i, j in PAIRS:
                    q[i, j] = q[j, i] = getattr(row, f"q{i}{j}")
                log_det, mean, inverse = estimate(row.m, np.array([getattr(row, f"s{i}") for i in range(AXES)]), q, scale)
                out.append([row.start, row.lang, row.source, log_det, row.was, *mean, *(inverse[i, j] for i, j in PAIRS)])
            yield pd.DataFrame(out, columns=["start", "lang", "source", *_ESTIMATE])

    return run


def _shrunk(moments: DataFrame) -> DataFrame:
    """Moments by (start, lang, source) with SHRINK rows of the language, and that with as many of all."""

    def toward(own: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
        wide = wide.selectExpr(*keys, *[f"{c} / greatest(m, 1e-9D) * {SHRINK} AS _{c}" for c in _MOMENTS])
        return own.join(wide, keys).selectExpr(*[c for c in own.columns if c not in _MOMENTS], *[f"{c} + _{c} AS {c}" for c in _MOMENTS])

    summed = lambda df, keys: df.groupBy(*keys).agg(*[F.expr(f"sum({c}) AS {c}") for c in _MOMENTS])
    by_lang = summed(moments, ["start", "lang"])
    return toward(moments, toward(by_lang, summed(by_lang, ["start"]), ["start"]), ["start", "lang"])


def _fitted(moments: DataFrame, scale: float) -> DataFrame:
    schema = "start int, lang string, source string, " + ", ".join(f"{c} double" for c in _ESTIMATE)
    held = spill(moments, "moments")
    out = spill(_shrunk(held).coalesce(8).mapInPandas(_estimates(scale), schema), "estimate")
    discard(held)
    return out


def _sums() -> list[Column]:
    names = ["CAST(count(1) AS DOUBLE) AS m", *[f"sum(x{i}) AS s{i}" for i in range(AXES)], *[f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in PAIRS]]
    return [F.expr(x) for x in names]


def _distance() -> Column:
    return F.expr(" + ".join(f"{1 if i == j else 2} * (x{i} - c{i}) * (x{j} - c{j}) * v{i}{j}" for i, j in PAIRS))


def _starts(rows: DataFrame) -> DataFrame:
    """Moments of both starts: 0, medians and squared quartile ranges; 1, all rows."""
    own = ["lang", "source"]
    spots = rows.groupBy(*own).agg(F.count(F.lit(1)).cast("double").alias("m"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i, c in enumerate(_X)])
    moments = [F.col("m"), *[(F.col("m") * F.col(f"p{i}")[1]).alias(f"s{i}") for i in range(AXES)]]
    for i, j in PAIRS:
        spread = F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)
        moments.append((F.col("m") * (F.col(f"p{i}")[1] * F.col(f"p{j}")[1] + spread)).alias(f"q{i}{j}"))
    plain = rows.groupBy(*own).agg(*_sums())
    return spots.select(F.lit(0).alias("start"), *own, *moments).unionByName(plain.select(F.lit(1).alias("start"), *own, *_MOMENTS)).withColumn("was", F.lit(float("inf")))


def _met(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """rows with each of their estimates and d2."""
    if few:
        met = rows.join(F.broadcast(now), ["lang", "source"])
    else:
        held = now.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.join(held, ["lang", "source", "_salt"])
    return met.withColumn("d2", F.greatest(_distance(), F.lit(1e-9)))


_OWN = ["start", "lang", "source"]


def _cuts(near: DataFrame, support: float) -> DataFrame:
    """For each group the distance bin that completes its nearest share."""
    bins = near.groupBy(*_OWN, F.floor(FINE * F.log("d2")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*_OWN)
    full = bins.withColumns({"_upto": F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(group)})
    return full.where(F.col("_upto") >= support * F.col("_all")).groupBy(*_OWN).agg(F.min("bin").alias("cut"))


def _concentrated(rows: DataFrame, now: DataFrame, support: float, few: bool) -> DataFrame:
    """Moments of the nearest share of each group, to whole distance bins."""
    cut = spill(_cuts(_met(rows, now, few), support), "cuts")
    near = _met(rows, now.join(cut, _OWN), few).where(F.floor(FINE * F.log("d2")) <= F.col("cut"))
    return near.groupBy(*_OWN).agg(*_sums(), F.first("log_det").alias("was"))


def _least(fits: DataFrame) -> DataFrame:
    """Of each group the fit of the smaller determinant, as start 0."""
    best = fits.groupBy("lang", "source").agg(F.min(F.struct("log_det", "start", *_ESTIMATE[1:])).alias("best"))
    return best.select(F.lit(0).alias("start"), "lang", "source", *[F.col("best")[c].alias(c) for c in _ESTIMATE])


def distances(table: DataFrame, steps: int = STEPS, support: float = SUPPORT) -> DataFrame:
    """counted() rows with d2, the squared Mahalanobis distance under their group's estimate."""
    salt = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)).cast("int")
    rows = spill(table.withColumn("_salt", salt).withColumns(dict(zip(_X, axes(), strict=True))), "axes")
    few = rows.select("lang", "source").distinct().count() <= BROADCAST_GROUPS
    now = _fitted(_starts(rows), 1.0)
    for step in range(steps):
        later = _fitted(_concentrated(rows, now, support, few), 1.0)
        discard(now)
        now = later
        # The starts aren't estimates of the support yet, so the first step may rise.
        if step and (now.agg(F.max(F.col("was") - F.col("log_det"))).first()[0] or 0.0) < STILL:
            break
    raw = _least(now).withColumns({f"v{i}{j}": F.col(f"v{i}{j}") / consistency(support) for i, j in PAIRS})
    near = _met(rows, raw, few).where(F.col("d2") <= quantile(REWEIGHT))
    final = _fitted(near.groupBy(*_OWN).agg(*_sums(), F.first("log_det").alias("was")), consistency(REWEIGHT))
    # A group without a near row keeps its raw estimate.
    used = spill(raw.join(final.select("lang", "source"), ["lang", "source"], "left_anti").unionByName(final), "final")
    discard(now)
    discard(final)
    return _met(rows, used, few).select("doc_id", "lang", "source", *COUNTS, "d2")


def judged(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """Per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words. kept: not base_failed, and d2 at most
    cutoff. Null and empty texts have no words, so they fail the base rule. A null language or source is a group
    of its own, like the empty string. Repeated rows each count; an empty table gives an empty result; columns
    other than doc_id, text, lang and source are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = distances(counted(docs), steps).withColumn("base_failed", failed)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("d2") <= cutoff)).alias("kept"), "d2")
