"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mjd_to_unix(mjd: Column) -> Column:
    return (mjd - 40587.0) * 86400.0


def utc(t: Column) -> Column:
    """Unix seconds as yyyy-MM-dd HH:mm:ss in UTC, whatever the session's zone; ``?`` where there is none."""
    whole = F.timestamp_seconds(F.floor(t))
    return F.coalesce(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), whole.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"), F.lit("?"))


def hhmm(t: Column) -> Column:
    return F.substring(utc(t), 12, 5)


def channel_kev(ch: Column) -> Column:
    """Two-slope channel energy with the break at channel 168."""
    return F.when(ch <= 168, ch * 0.0476).otherwise(168 * 0.0476 + (ch - 168) * 0.0952)


def fixed(x: Column, digits: int) -> Column:
    """Text with so many decimals, rounded from the exact binary value (half to even), as C and Python print it."""
    return F.translate(F.format_number(x, digits), ",", "")


def goes_class(flux: Column, prefix: str = "") -> Column:
    """Letter and one-decimal mantissa; below the lowest floor ``<A1``; null if not positive."""
    out = F.lit(f"{prefix}<A1")
    for letter, floor in (("A", 1e-8), ("B", 1e-7), ("C", 1e-6), ("M", 1e-5), ("X", 1e-4)):
        out = F.when(flux >= floor, F.concat(F.lit(f"{prefix}{letter}"), fixed(flux / floor, 1))).otherwise(out)
    return F.when(flux > 0, out)


def approx_class(ratio: Column, rate: Column) -> Column:
    """The higher of two ladders: ratio at 8, 20, 50 and peak rate at 400, 1500, 5000."""

    def step(x: Column, cuts: tuple[float, float, float]) -> Column:
        return F.when(x >= cuts[2], 3).when(x >= cuts[1], 2).when(x >= cuts[0], 1).otherwise(0)

    rank = F.greatest(step(ratio, (8, 20, 50)), step(rate, (400, 1500, 5000)))
    return F.element_at(F.array(*[F.lit(c) for c in ("sub-C", "C-like", "M-like", "X-like")]), rank + 1)


def squash(x: Column, centre: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), (x - centre) / scale))))


def scrub(x: Column) -> Column:
    """NaN, infinities and null read as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def none_holds(items: Column, first: Column | float = 1.0) -> Column:
    """first * prod(1 - p) over an array in its order, p clipped to [0, 1], nulls skipped."""
    clean = F.filter(items, lambda p: p.isNotNull())
    return F.aggregate(clean, F.lit(first), lambda a, p: a * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def noisy_or(items: Column) -> Column:
    """1 - prod(1 - p) over an array, p clipped to [0, 1], nulls skipped; 0 for an empty array."""
    return 1 - none_holds(items)


def horizon(p30: Column, minutes: Column) -> Column:
    return 1 - F.pow(1 - p30, minutes / 30.0)


def correlation(x: str, y: str) -> Column:
    """Pearson's coefficient as an aggregate; null if either is constant, or nearly so (deviation below 1e-9)."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx >= 1e-9) & (sy >= 1e-9), F.covar_pop(x, y) / (sx * sy))
