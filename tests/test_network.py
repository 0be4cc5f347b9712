"""The network: its gradient, sums over partitions, fit, and saving."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from helioflux.operators import learning, network

LAYERS = [3, 5, 4, 1]
RNG = np.random.default_rng(7)


def rows_of(spark, n):
    x = RNG.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (RNG.random(n) < 0.05)).astype(int)
    return spark.createDataFrame([(f"202401{1 + i % 20:02d}", float(i), *map(float, v), int(b)) for i, (v, b) in enumerate(zip(x, y, strict=True))], "date string, t double, a double, b double, c double, y int")


def test_gradient():
    x, y, weight = RNG.normal(size=(40, 3)), RNG.integers(0, 2, 40).astype(float), RNG.random(40)
    w = network.start(LAYERS, 1)
    assert len(w) == 3 * 5 + 5 + 5 * 4 + 4 + 4 + 1
    loss, gradient = network.sums(x, y, weight, w, LAYERS)
    p = 1 / (1 + np.exp(-network.outputs(x, network.unpacked(w, LAYERS))[-1][:, 0]))
    assert loss == pytest.approx(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    for i in range(len(w)):
        d = np.zeros(len(w))
        d[i] = 1e-6
        slope = (network.sums(x, y, weight, w + d, LAYERS)[0] - network.sums(x, y, weight, w - d, LAYERS)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, rel=1e-4, abs=1e-5)


def test_sums_over_partitions(spark):
    rows = rows_of(spark, 9000).select(array_to_vector(F.array("a", "b", "c")).alias("x"), "y", (1 + F.col("t") % 3).alias("weight"))
    w = network.start(LAYERS, 2)
    one, many = (network.total(network.packed(rows.repartition(k), 0.2, 5), w, LAYERS) for k in (1, 7))
    assert one == pytest.approx(many, rel=1e-9) and one[1] + one[3] == pytest.approx(18000) and 0.17 < one[3] / 18000 < 0.23
    local = rows.toPandas()
    x = np.stack([v.toArray() for v in local["x"]])
    loss, _ = network.sums(x, local["y"].to_numpy(float), local["weight"].to_numpy(float), w, LAYERS)
    assert one[0] + one[2] == pytest.approx(loss)


def test_fits_what_no_line_parts(spark, tmp_path):
    rows = rows_of(spark, 3000)
    train, test = rows.where("date <= '20240115'").cache(), rows.where("date > '20240115'").cache()
    model = learning.fitted(train, "perceptron", ("a", "b", "c"), layers=[3, 16, 8, 1], maxIter=40)
    got = learning.scored(model, test)
    loss = -F.ln(F.when(F.col("y") == 1, F.col("prob")).otherwise(1 - F.col("prob")))
    out = got.agg(F.avg(loss).alias("loss"), F.avg(((F.col("prob") >= 0.5).cast("int") == F.col("y")).cast("int")).alias("right")).first()
    # The base rate's loss is ln 2; a line tells nothing here.
    assert out["loss"] < 0.45 and out["right"] > 0.85
    model.write().save(str(tmp_path / "m"))
    again = learning.scored(PipelineModel.load(str(tmp_path / "m")), test)
    assert [r.prob for r in again.orderBy("t").collect()] == [r.prob for r in got.orderBy("t").collect()]
    assert learning.scored(model, test.limit(0)).isEmpty()
    with pytest.raises(Exception, match="no rows"):
        network.Network(layers=LAYERS).fit(train.limit(0).select(array_to_vector(F.array("a", "b", "c")).alias("x"), "y", F.lit(1.0).alias("weight")))
