"""Operators that prepare a corpus for training language models."""

from __future__ import annotations

from pyspark.sql import SparkSession

TEXTS_PER_BATCH = "1000"


def small_batches(spark: SparkSession) -> None:
    """Few texts at a time go to Python workers, which keep the memory that they once took."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
