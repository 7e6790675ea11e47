"""Session and storage helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables
from ..sources.tables import materialize, shared_dir

__all__ = ["bounded_batches", "materialize", "shared_dir", "shuffle_partitions", "table"]

BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows: with whole texts the default of 10,000 takes much memory in both the
    executor and its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return tables.table(spark, sf_dir, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
