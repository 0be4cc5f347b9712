"""Exact quantiles by selection: histograms of a shrinking range, never all values in one place.

Each round counts the rows of every open range in equal buckets, one aggregation over all ranges and groups, and keeps
of each range the bucket that holds the wanted rank, from its least to its greatest value. A range ends when it holds
one value, or few enough rows to list. The driver sees a range and its buckets' counts for each group and rank, so
groups are meant to be few, such as folds; rows stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a range; rows of a range that are listed rather than counted again
BUCKETS, LISTED = 1024, 1000


@dataclass(frozen=True)
class _Range:
    """Values lo to hi of a group, which hold the rank-th value of all; before: rows below lo."""

    key: tuple
    rank: int
    lo: float
    hi: float
    before: int
    rows: int


def _within(rows: DataFrame, ranges: list[_Range], keys: tuple[str, ...]) -> DataFrame:
    """(_r, x) of rows in ranges, numbered; equal ranges count once. Ranges are few, a group's ranks at most."""
    kinds = [f"`_k{i}` {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    table = rows.sparkSession.createDataFrame([(i, r.lo, r.hi, *r.key) for i, r in enumerate(ranges)], ", ".join(["_r int", "_lo double", "_hi double", *kinds]))
    on = (F.col("x") >= F.col("_lo")) & (F.col("x") <= F.col("_hi"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(table), on).select("_r", "x", "_lo", "_hi")


def _narrowed(rows: DataFrame, ranges: list[_Range], keys: tuple[str, ...]) -> list[_Range]:
    shared = list({(r.key, r.lo, r.hi): r for r in ranges}.values())
    # Halves, so that the widest range of doubles doesn't overflow; x - lo grows with x, and so does its bucket.
    part = (F.col("x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    placed = _within(rows, shared, keys).withColumn("_b", F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)))
    counts: dict[int, list[tuple]] = {}
    for r in placed.groupBy("_r", "_b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_r", "_b").collect():
        counts.setdefault(r["_r"], []).append((r["n"], r["lo"], r["hi"]))
    number = {(r.key, r.lo, r.hi): i for i, r in enumerate(shared)}
    out = []
    for r in ranges:
        before = r.before
        for n, lo, hi in counts[number[r.key, r.lo, r.hi]]:
            if r.rank < before + n:
                out.append(replace(r, lo=lo, hi=hi, before=before, rows=n))
                break
            before += n
    return out


def exact_quantiles(table: DataFrame, column: str, shares: list[float], keys: tuple[str, ...] = ()) -> dict[tuple, list[float]]:
    """Of each group (a tuple of the keys' values), the interpolated quantiles of a column, as ``percentile`` gives them.

    Null values are skipped; a group without any has no entry. An empty table gives none.
    """
    rows = table.select(*keys, F.col(column).cast("double").alias("x")).where("x is not null")
    size = {tuple(r[k] for k in keys): (r["n"], r["lo"], r["hi"]) for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect() if r["n"]}
    at = {key: [p * (n - 1) for p in shares] for key, (n, _, _) in size.items()}
    open_ = [_Range(key, rank, lo, hi, 0, n) for key, (n, lo, hi) in size.items() for rank in sorted({f(p) for p in at[key] for f in (floor, ceil)})]
    value: dict[tuple, float] = {}
    while open_:
        value |= {(r.key, r.rank): r.lo for r in open_ if r.lo == r.hi}
        few = [r for r in open_ if r.lo < r.hi and r.rows <= LISTED]
        if few:
            shared = list({(r.key, r.lo, r.hi): r for r in few}.values())
            listed: dict[int, list[float]] = {}
            for x in _within(rows, shared, keys).groupBy("_r", "x").agg(F.count(F.lit(1)).alias("n")).orderBy("_r", "x").collect():
                listed.setdefault(x["_r"], []).extend([x["x"]] * x["n"])
            number = {(r.key, r.lo, r.hi): i for i, r in enumerate(shared)}
            value |= {(r.key, r.rank): listed[number[r.key, r.lo, r.hi]][r.rank - r.before] for r in few}
        open_ = [r for r in open_ if r.lo < r.hi and r.rows > LISTED]
        open_ = _narrowed(rows, open_, keys) if open_ else []
    out = {}
    for key, places in at.items():
        own = []
        for p in places:
            low, high = value[key, floor(p)], value[key, ceil(p)]
            own.append(low if floor(p) == ceil(p) else (ceil(p) - p) * low + (p - floor(p)) * high)
        out[key] = own
    return out
