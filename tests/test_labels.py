"""Models and calibration where labels are all alike or missing."""

from pyspark.sql import functions as F

from helioflux.operators import learning


def days(spark, positive):
    """Four days of windows, one feature."""
    rows = spark.range(80).select(F.concat(F.lit("2024010"), (F.col("id") % 4 + 1).cast("string")).alias("date"), (F.col("id") % 4 * 86400.0 + F.col("id") * 60).alias("t"), F.rand(3).alias("a"), "id")
    return rows.withColumn("y", F.lit(int(positive)))


def test_no_usable_fold_leaves_nothing_to_calibrate(spark):
    """Without a positive no fold is usable: an empty table, calibrated."""
    oof = learning.out_of_fold(days(spark, False), "logistic", names=("a",))
    out = learning.calibrator(oof).transform(oof)
    assert out.count() == 0 and dict(out.dtypes)["calibrated"] == "double"
    some = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "prob double")
    assert [r.calibrated for r in learning.calibrator(oof).transform(some).collect()] == [1e-6, 0.3, 1 - 1e-6]


def test_a_forest_of_one_label(spark):
    """Rows of one class only: the chance of the other is there, and 0."""
    for positive in (False, True):
        out = learning.forecast(days(spark, positive), "forest_shallow", names=("a",), numTrees=3)
        assert {r.prob for r in out.collect()} == {float(positive)}
        out = learning.forecast(days(spark, positive), "logistic", names=("a",))
        assert {r.prob for r in out.collect()} == {float(positive)}
