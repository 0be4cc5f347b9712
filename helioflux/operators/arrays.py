"""Spectra and peaks of arrays in a row, by array functions: what one event or window holds goes through no join."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean(x: Column) -> Column:
    """Null of an empty array."""
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size(x))


def deviation(x: Column) -> Column:
    """Population standard deviation."""
    return bound(mean(x), lambda m: F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(x))))


def centred(x: Column, reach: int) -> Column:
    """Means over each value and up to ``reach`` neighbours on both sides."""

    def around(_: Column, i: Column) -> Column:
        total = F.coalesce(F.get(x, i - reach), F.lit(0.0))
        for d in range(1 - reach, reach + 1):
            total = total + F.coalesce(F.get(x, i + d), F.lit(0.0))
        return total / (F.least(i + reach, F.size(x) - 1) - F.greatest(i - reach, F.lit(0)) + 1)

    return F.transform(x, around)


def dft_power(x: Column) -> Column:
    """Squared magnitudes of the discrete Fourier transform at frequencies 0 to half the length.

    A table of n sines and cosines serves all products of index and frequency. The work grows with the square of the
    length, which for an event of a hundred bins is some thousands of products; x must not be empty.
    """
    n = F.size(x)
    turn = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.cos(2 * math.pi * j / n).alias("c"), F.sin(2 * math.pi * j / n).alias("s")))
    at = F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))

    def power(wheel: Column, places: Column, k: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        step = lambda a, j: bound(F.get(wheel, (k * j) % n), lambda w: F.struct((a["re"] + F.get(x, j) * w["c"]).alias("re"), (a["im"] - F.get(x, j) * w["s"]).alias("im")))
        return F.aggregate(places, zero, step, lambda a: a["re"] * a["re"] + a["im"] * a["im"])

    return bound(turn, lambda wheel: bound(at, lambda places: F.transform(F.sequence(F.lit(0).cast("long"), F.floor(n / 2)), lambda k: power(wheel, places, k))))


def peak_places(y: Column) -> Column:
    """Ascending indices of local maxima; a flat top counts once at its floored middle, ends never do.

    A peak is a run of equal values that is entered upwards and left downwards, so only the places where runs begin matter.
    """
    steps = F.when(F.size(y) > 1, F.filter(F.sequence(F.lit(1), F.greatest(F.size(y) - 1, F.lit(1))), lambda i: F.get(y, i) != F.get(y, i - 1))).otherwise(F.array().cast("array<int>"))
    runs = bound(steps, lambda s: F.transform(s, lambda a, m: F.struct(a.alias("a"), F.get(s, m + 1).alias("b"))))
    tops = F.filter(runs, lambda r: r["b"].isNotNull() & (F.get(y, r["a"]) > F.get(y, r["a"] - 1)) & (F.get(y, r["b"]) < F.get(y, r["a"])))
    return F.transform(tops, lambda r: F.floor((r["a"] + r["b"] - 1) / 2).cast("int"))


def spaced(places: Column, y: Column, distance: int) -> Column:
    """Places of which none is nearer than ``distance`` to a higher one that stays; of equal heights the later one stays."""
    order = F.array_sort(F.transform(places, lambda p: F.struct((-F.get(y, p)).alias("h"), (-p).alias("q"))))
    near = lambda kept, x: F.exists(kept, lambda k: F.abs(k + x["q"]) < distance)
    return F.array_sort(F.aggregate(order, F.array().cast("array<int>"), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.array_append(kept, -x["q"]))))
