"""Incremental ingest: files that a ledger of name and size hasn't seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of files (name, size, ...) without an equal (name, size) in the ledger."""
    return files.join(ledger.select("name", "size").distinct(), ["name", "size"], "left_anti")
