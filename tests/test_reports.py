"""Reports' text as its SQL twin has it."""

from pyspark.sql import functions as F

from helioflux import catalog


def test_a_flux_of_zero_is_no_missing_flux(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 0D, NULL), ('b', 0D, 2e-6), ('c', NULL, 0D), ('d', NULL, NULL), ('e', 1e-6, 2e-6) AS t(event_id, peak_flux_wm2, hard_peak_flux_wm2)")
    rows = rows.withColumns({"peak_flux_wm2": F.col("peak_flux_wm2").cast("double"), "hard_peak_flux_wm2": F.col("hard_peak_flux_wm2").cast("double"), "start_utc": F.lit("2024-01-01 00:00:00"), "peak_utc": F.lit("2024-01-01 00:00:00"), "duration_s": F.lit(60.0), "peak_rate": F.lit(1.0), "class_approx": F.lit("x"), "dominant_energy_band": F.lit("band1"), "n_bands_covered": F.lit(2)})
    assert {r.event_id: r.flux for r in catalog.event_table(rows).collect()} == {"a": "0.00e+00", "b": "2.00e-06", "c": "0.00e+00", "d": "-", "e": "1.00e-06"}
