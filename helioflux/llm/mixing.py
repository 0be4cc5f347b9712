"""Mixing to target weights under soft domain membership; DataFrame functions only.

1. A naive Bayes classifier over binned text statistics, counted on the labelled rows, gives each document a
   posterior over domains. Its tables hold domains x statistics x bins numbers, whatever the corpus.
2. Document rates r between 0 and max_rate minimise sum_k (T_k - t_k)^2 / m_k, where T_k is domain k's expected
   token total sum_d r_d tokens_d p_dk, t_k its target and m_k its total at rate 1. They come from projected gradient
   steps from rate 1, r <- clip(r - sum_k p_k s_k), with residuals preconditioned by the matrix sum of tokens p p':
   where targets can be reached, every positive definite weighting of residuals has the same least value, and a step
   or a few reach it. Where STEPS of them don't, targets are out of reach or nearly so, and projected gradient needs
   hundreds of steps where a domain is rare. Then the same objective is minimised with a penalty of vanishing weight
   for rates off 1: such rates are one projected step from 1, r_d = clip(1 - sum_k p_dk s_k), with one shift s_k a
   domain, which maximise the concave dual and are found by damped Newton steps while the penalty's weight falls.
   Posterior and rate depend on the bins alone, so one aggregation reduces the corpus to token sums by combination
   of bins, and a step is one aggregation of that table to a few sums.
3. The rate becomes a whole number of copies: its floor, plus one with the fraction's probability by a
   hash of doc_id.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import spill, whole_row

#: Domains made of the label columns quality and toxic
DOMAINS = ("junk", "toxic", "clean")
#: Common insults, one of the binned statistics counts them
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless")
BINS = 12


def domain_of_labels() -> Column:
    """Index into DOMAINS of a labels row; null where it can't be told."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)


def _share(part: Column, whole: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.sqrt(part / F.greatest(whole, F.lit(1))) * BINS)).cast("int")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with tokens and bins (array of ints below BINS).

    Tokens are the pieces between single blanks and line feeds; a null text is empty and has 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    docs = docs.withColumns({"_words": F.split(text, " "), "_lines": lines, "_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]|!!")), "_capitals": F.regexp_count(text, F.lit("[A-Z]{3,}"))})
    docs = docs.withColumns({"_unique": F.array_distinct("_words"), "tokens": F.when(text == "", 0).otherwise(F.size("_words") + F.col("_lines")).cast("long")})
    n = F.col("tokens")
    insults = F.size(F.array_intersect("_unique", F.array(*[F.lit(w + t) for w in INSULTS for t in ("", ".", ",")])))
    bins = F.array(
        _share(F.col("_symbols"), n),
        _share(F.col("_capitals"), n),
        _share(F.size("_unique"), n),
        _share(F.col("_lines"), n),
        F.least(F.lit(BINS - 1), insults).cast("int"),
        F.least(F.lit(BINS - 1), F.floor(F.log2(n + F.lit(1)))).cast("int"),
    )
    return docs.withColumn("bins", bins).drop("_words", "_lines", "_symbols", "_capitals", "_unique")


STATISTICS = 6


class Classifier:
    """Log prior and log likelihood tables, counted on labelled rows with one added to each cell."""

    def __init__(self, measured: DataFrame, labels: DataFrame, domains: int = len(DOMAINS)) -> None:
        known = labels.select("doc_id", domain_of_labels().alias("domain")).where("domain is not null").dropDuplicates(["doc_id", "domain"])
        rows = measured.join(known, "doc_id").select("domain", F.posexplode("bins").alias("statistic", "bin"))
        counts = {(r["domain"], r["statistic"], r["bin"]): r["count"] for r in rows.groupBy("domain", "statistic", "bin").count().collect()}
        totals = [sum(c for (d, s, _), c in counts.items() if d == k and s == 0) for k in range(domains)]
        self.domains = domains
        self.prior = [log((t + 1) / (sum(totals) + domains)) for t in totals]
        self.table = [[[log((counts.get((k, s, b), 0) + 1) / (totals[k] + BINS)) for b in range(BINS)] for s in range(STATISTICS)] for k in range(domains)]

    def posterior(self, bins: Column) -> list[Column]:
        scores = []
        for k in range(self.domains):
            score = F.lit(self.prior[k])
            for s in range(STATISTICS):
                score = score + F.element_at(F.array(*[F.lit(x) for x in self.table[k][s]]), F.element_at(bins, s + 1) + 1)
            scores.append(score)
        return [1 / sum((F.exp(F.least(other - own, F.lit(700.0))) for other in scores), F.lit(0.0)) for own in scores]


#: Projected gradient steps before the dual takes over
STEPS = 6


@dataclass
class Fit:
    """The rate of a row, domains' token totals at rate 1, targets and totals reached; met: within tolerance."""

    rate: Column
    mass: list[float]
    targets: list[float]
    reached: list[float]
    met: bool


def rate_of(shifts: list[float], max_rate: float) -> Column:
    moved = F.lit(1.0)
    for k, s in enumerate(shifts):
        moved = moved - F.col(f"p{k}") * F.lit(float(s))
    return F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), moved))


def _sums(measured: DataFrame, shifts: np.ndarray, max_rate: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Over all tokens at these shifts: (rate - 1)^2 / 2 + rate * (p . shifts), domains' totals, and p p' where the rate is free."""
    k = len(shifts)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rate, n, p = F.col("_rate"), F.col("tokens"), [F.col(f"p{i}") for i in range(k)]
    pull = sum((p[i] * F.lit(float(shifts[i])) for i in range(k)), F.lit(0.0))
    free = F.when((rate > 0) & (rate < max_rate), n).otherwise(0)
    value = F.sum(n * ((rate - 1) * (rate - 1) / 2 + rate * pull))
    row = measured.withColumn("_rate", rate_of(list(shifts), max_rate)).agg(value, *[F.sum(n * rate * x) for x in p], *[F.sum(free * p[i] * p[j]) for i, j in pairs]).first()
    got = [float(x or 0) for x in row]
    bend = np.zeros((k, k))
    for (i, j), x in zip(pairs, got[1 + k :], strict=True):
        bend[i, j] = bend[j, i] = x
    return got[0], np.array(got[1 : 1 + k]), bend


def _descended(measured: DataFrame, target: np.ndarray, max_rate: float, near: np.ndarray) -> tuple[Column | None, np.ndarray]:
    """The rate after projected gradient steps that bring all totals near their targets, and the totals; None if STEPS don't."""
    k = len(target)
    names = [f"p{i}" for i in range(k)]
    n = F.col("tokens")
    row = measured.agg(*[F.sum(n * F.col(a) * F.col(b)) for a in names for b in names]).first()
    gram = np.array([float(x or 0) for x in row]).reshape(k, k)
    # The trace of a diagonal keeps the inverse there where posteriors leave a direction out.
    weighting = np.linalg.inv(gram + np.diag(1e-9 * np.maximum(gram.diagonal(), 1e-9 * max(gram.trace(), 1.0))))
    rate, total = F.lit(float(min(1.0, max_rate))), np.zeros(k)
    for step in range(STEPS + 1):
        got = measured.agg(*[F.sum(n * rate * F.col(p)) for p in names]).first()
        total = np.array([float(x or 0) for x in got])
        if (np.abs(total - target) <= near).all():
            return rate, total
        if step < STEPS:
            moved = rate
            for p, s in zip(names, weighting @ (total - target), strict=True):
                moved = moved - F.col(p) * F.lit(float(s))
            rate = F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), moved))
    return None, total


def fit_rates(measured: DataFrame, weights: list[float], max_rate: float = 1.0, budget: float | None = None, tolerance: float = 1e-4, slack: float = 0.95, scarce: str = "limit") -> Fit:
    """Rates for all domains' targets, from rows (tokens, p0..).

    budget: tokens wanted in all. None with ``scarce`` "limit": ``slack`` times the most for which every domain's
    target is within its total at max_rate, so the scarcest domain sets the size. None with "short": so much that
    the domain of the largest weight is wanted whole, once. With "short", targets end at a domain's total at
    max_rate: domains that have less fall short of their share. Ends when all totals are within ``tolerance`` of
    their targets; if no rates reach them, at the nearest totals, with ``met`` false.
    """
    k = len(weights)
    share = [w / sum(weights) for w in weights]
    shifts = np.zeros(k)
    _, mass, _ = _sums(measured, shifts, float("inf"))
    if budget is None and scarce == "short":
        main = max(range(k), key=lambda i: share[i])
        budget = mass[main] / share[main]
    elif budget is None:
        budget = slack * max_rate * min((m / w for m, w in zip(mass, share, strict=True) if w > 0), default=0.0)
    target = np.array([w * budget for w in share])
    if scarce == "short":
        target = np.minimum(target, max_rate * mass)
    near = tolerance * max(budget, 1.0) * np.maximum(share, 1e-3)
    unit = np.maximum(mass, 1e-9 * max(float(mass.sum()), 1.0))
    rate, reached = _descended(measured, target, max_rate, near)
    if rate is not None:
        return Fit(rate, mass.tolist(), target.tolist(), reached.tolist(), True)
    value, reached, bend = _sums(measured, shifts, max_rate)
    for weight in (10.0**-e for e in range(1, 8)):
        dual = lambda v, s: v - float(s @ target) - weight * float(unit @ (s * s)) / 2  # noqa: B023, E731
        while True:
            rise = reached - target - weight * unit * shifts
            if (np.abs(reached - target) <= near).all() or (np.abs(rise) <= 1e-6 * unit).all():
                break
            step, part = np.linalg.solve(bend + np.diag(weight * unit), rise), 1.0
            while True:
                after = _sums(measured, shifts + part * step, max_rate)
                gain = dual(after[0], shifts + part * step) - dual(value, shifts)
                if gain >= 1e-4 * part * float(rise @ step) or part < 1e-6:
                    break
                part /= 2
            if gain <= 0:  # as near as floating point tells
                break
            shifts, (value, reached, bend) = shifts + part * step, after
        if (np.abs(reached - target) <= near).all():
            break
    return Fit(rate_of(shifts.tolist(), max_rate), mass.tolist(), target.tolist(), reached.tolist(), bool((np.abs(reached - target) <= near).all()))


def _uniform(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def fitted(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float = 1.0, budget: float | None = None, scarce: str = "limit", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, Fit]:
    """The statistics of all documents beside columns to carry, the table of posteriors and rate by combination of bins, and the fit.

    Logs targets and totals reached: as a warning where they differ or a domain falls short of its weight.
    """
    order = [float(weights.get(d, 0.0)) for d in DOMAINS]
    if min(order) < 0 or sum(order) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    measured = spill(statistics(docs.select("doc_id", "text", *carry)).select("doc_id", "tokens", "bins", *carry), "statistics")
    chances = Classifier(measured, labels).posterior(F.col("bins"))
    by_bins = measured.groupBy("bins").agg(F.sum("tokens").alias("tokens"))
    held = spill(by_bins.select("bins", "tokens", *[p.alias(f"p{k}") for k, p in enumerate(chances)]), "posteriors")
    fit = fit_rates(held, order, max_rate, budget, scarce=scarce)
    main = max(range(len(order)), key=lambda i: order[i])
    short = [d for d, t, w in zip(DOMAINS, fit.targets, order, strict=True) if t < w / order[main] * fit.targets[main] * (1 - 1e-9)]
    said = ", ".join(f"{d} {t:.0f} of {m:.0f} wanted, {r:.0f} reached" for d, m, t, r in zip(DOMAINS, fit.mass, fit.targets, fit.reached, strict=True))
    log_ = logging.getLogger(__name__)
    (log_.info if fit.met and not short else log_.warning)("mixing, tokens by domain: %s; targets %s; short of their weight: %s", said, "met" if fit.met else "out of reach, nearest totals", ", ".join(short) or "none")
    return measured, spill(held.withColumn("rate", fit.rate).drop("tokens"), "rates"), fit


def _with_copies(rows: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    fraction = F.col("rate") - F.floor("rate")
    copies = F.floor("rate") + F.when(_uniform(seed) < fraction, 1).otherwise(0)
    return rows.join(rates, "bins").withColumn("copies", copies.cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float = 1.0, budget: float | None = None, seed: int = 7, scarce: str = "limit") -> DataFrame:
    """doc_id, tokens, p0.. (posteriors in DOMAINS' order), rate and copies of every row.

    Null or empty texts have no tokens: they get a rate, and no effect on totals. Rows with an equal doc_id draw
    the same number; labels without a matching document, null labels and repeated equal labels are harmless.
    Without any label all domains are equally likely. A domain that no document may belong to can't be filled:
    its target is then out of reach and the nearest totals result, with a warning. budget and scarce: as in
    fit_rates. Columns of docs other than doc_id and text are
    ignored.
    """
    measured, rates, _ = fitted(docs, labels, weights, max_rate, budget, scarce)
    return _with_copies(measured, rates, seed).drop("bins")


def drawn(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float = 1.0, budget: float | None = None, seed: int = 7, scarce: str = "limit") -> DataFrame:
    """docs' rows, each as often as its copies say; columns as in docs, whatever their names.

    Odd rows are handled as by ``mixed``; a null or empty text is kept or dropped by its bins' rate like others.
    """
    whole = docs.select("doc_id", "text", whole_row(docs).alias("_row"))
    rows, rates, _ = fitted(whole, labels, weights, max_rate, budget, scarce, ("_row",))
    out = _with_copies(rows, rates, seed).where("copies > 0")
    if max_rate > 1:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
