"""Confidence as its SQL twin has it."""

from helioflux.operators import checks


def test_confidence_takes_powers_as_its_sql_does(spark):
    """0.2 squared, not (1 - 0.8) squared: next to a tie the tenth depends on it."""
    rows = spark.sql("SELECT 2 AS n_pass, 3 AS n_flag, 100D AS focus_stat, CAST(NULL AS DOUBLE) AS fred, 10D AS excess, CAST(NULL AS BOOLEAN) AS confirmed, 0D AS match, 2 AS yes")
    assert checks.confidence(rows).first()["confidence_pct"] == 68.9
