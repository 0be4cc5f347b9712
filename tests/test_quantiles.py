"""Exact quantiles against ``percentile``."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioflux.operators import quantiles, skill

SHARES = [0.0, 0.02, 0.25, 0.5, 0.731, 0.995, 1.0]


@pytest.mark.parametrize("kind", ["uniform", "ties", "wide", "one", "few"])
def test_equal_to_percentile(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "LISTED", 20)
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    draw = np.random.default_rng(len(kind))
    x = {"uniform": draw.random(3000), "ties": draw.integers(0, 5, 3000) / 7, "wide": np.concatenate([draw.normal(size=1500) * 1e300, draw.normal(size=1500) * 1e-300]), "one": np.full(500, 0.25), "few": draw.random(3)}[kind]
    rows = spark.createDataFrame([(int(i % 3) if i % 11 else None, float(v)) for i, v in enumerate(x)] + [(9, None), (1, None)], "g int, x double").repartition(5)
    assert quantiles.exact_quantiles(rows, "x", SHARES) == {(): rows.agg(F.percentile("x", SHARES)).first()[0]}
    want = {(r.g,): r.q for r in rows.where("x is not null").groupBy("g").agg(F.percentile("x", SHARES).alias("q")).collect()}
    assert quantiles.exact_quantiles(rows, "x", SHARES, ("g",)) == want
    assert quantiles.exact_quantiles(rows.limit(0), "x", SHARES) == {}


def test_no_task_sees_more_than_its_share(spark, monkeypatch):
    """What reaches a shuffled task is buckets' counts: of 40,000 scores none but a listed range's."""
    rows = spark.range(40_000).select((F.hash("id") / 2**31).alias("x")).repartition(8)
    seen = []
    within = quantiles._within
    monkeypatch.setattr(quantiles, "_within", lambda *a: seen.append(within(*a)) or seen[-1])
    quantiles.exact_quantiles(rows, "x", SHARES)
    listed = [df.count() for df in seen[1:]]
    assert listed and max(listed) <= quantiles.LISTED * 2 * len(SHARES)


def test_ladder_without_rows_has_the_steps(spark):
    none = spark.createDataFrame([], "prob double, y int")
    assert sorted(r.thr for r in skill.ladder(none).collect()) == [round(i / 20, 2) for i in range(1, 19)]
