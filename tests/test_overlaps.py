"""Bucketed overlap joins against the plain condition."""

import numpy as np
import pytest

from helioflux.operators import intervals, replay


def spans(draw, n, longest):
    start = draw.uniform(-5000, 20000, n).round(1)
    return [(i, "ab"[i % 2], float(a), float(a + b)) for i, (a, b) in enumerate(zip(start, draw.choice([0.0, 3600.0, 1.5, longest], n), strict=True))]


@pytest.mark.parametrize("pad", [0.0, 120.0, 4000.0])
def test_overlaps_equal_the_condition_and_come_once(spark, pad):
    draw = np.random.default_rng(int(pad))
    left, right = spans(draw, 60, 9000.0), spans(draw, 70, 15000.0)
    left += [(900, "a", 3600.0, 7200.0), (901, "a", 50.0, 40.0)]
    right += [(900, "a", 7200.0 + pad, 9000.0), (901, "a", 0.0, 3600.0 - pad)]
    a = spark.createDataFrame(left, "i int, date string, start double, end double")
    b = spark.createDataFrame([*right, (999, "a", 1.0, None)], "j int, date string, start double, end double")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= x[3] and y[2] - pad <= y[3] + pad and y[2] - pad <= x[3] and y[3] + pad >= x[2])
    got = sorted((r.i, r.j) for r in intervals.overlapping(a, b, pad).collect())
    assert got == want and len(set(got)) == len(got) > 50


def test_long_intervals_meet_in_linear_space(spark):
    """Many short intervals a day against each other: pairs that meet, not pairs of a day."""
    a = spark.range(20000).selectExpr("id AS i", "'d' AS date", "id * 4.0D AS start", "id * 4.0D + 1 AS end")
    b = spark.range(20000).selectExpr("id AS j", "'d' AS date", "id * 4.0D + 0.5D AS start", "id * 4.0D + 2 AS end")
    assert intervals.overlapping(a, b, 0.0, bucket=60.0).count() == 20000


def test_scorecard_by_hand(spark):
    rows = [("a", 0.0, 0.9, 1, 1800.0), ("a", 600.0, 0.9, 1, 1800.0), ("a", 1800.0, 0.9, 0, None), ("a", 4000.0, 0.8, 0, None), ("a", 5000.0, 0.1, 1, 6000.0), ("b", 100.0, 0.2, 0, None)]
    df = spark.createDataFrame(rows, "date string, t double, prob double, y int, flare_start double")
    got = {r.date: tuple(r)[1:] for r in replay.scorecard(df, 0.5).collect()}
    assert got == {"a": (2, 1, 30.0, 1, 1), "b": (0, 0, None, 0, 0)}


def test_no_frame_ends_at_the_last_row(spark):
    """Spark reads such a frame again for each of its rows: work would grow with the square of a day's rows."""
    clock, known = spark.range(5).selectExpr("'d' AS date", "id", "id * 2D AS t"), spark.range(4).selectExpr("'d' AS date", "id * 3D AS t", "id * 1D AS y")
    starts = known.selectExpr("date", "t AS start")
    for df in (intervals.interpolated(clock, known), replay.next_significant(clock, starts)):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    assert [r.y for r in intervals.interpolated(clock, known, clamp=False).orderBy("t").collect()] == pytest.approx([0, 2 / 3, 4 / 3, 2, 8 / 3])
    assert [r.next_start for r in replay.next_significant(clock, starts).orderBy("t").collect()] == [3, 3, 6, 9, 9]
