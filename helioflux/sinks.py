"""Results as files: the catalog, test predictions. Nothing is overwritten: a run has a folder of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog_csv(catalog: DataFrame, folder: str) -> None:
    """The catalog as CSV with a header."""
    catalog.write.mode("errorifexists").option("header", True).csv(folder)


def catalog_parquet(catalog: DataFrame, folder: str) -> None:
    """The catalog as Parquet by date, so that readers of some dates read only those."""
    catalog.write.mode("errorifexists").partitionBy("date").parquet(folder)


def predictions(test: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """test (.., prob) with ``alarm_default_0.5`` and an alarm ``alarm_<objective>_<threshold>`` for each named threshold."""
    alarms = {f"alarm_{name}_{value:.3f}": F.col("prob") >= value for name, value in thresholds.items()}
    return test.withColumns({"alarm_default_0.5": F.col("prob") >= 0.5, **alarms})


def predictions_csv(rows: DataFrame, folder: str) -> None:
    """Test predictions as CSV with a header."""
    rows.write.mode("errorifexists").option("header", True).csv(folder)
