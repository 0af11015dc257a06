"""Which regions are done, and which still have to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_status(regions: DataFrame, stores: DataFrame, key: str, count: str) -> DataFrame:
    """regions with status: missing without a store, empty with a store of 0 rows, else ready."""
    joined = regions.join(stores.select(key, F.col(count).alias("__n")), key, "left")
    return joined.withColumn("status", F.when(F.col("__n").isNull(), "missing").when(F.col("__n") == 0, "empty").otherwise("ready")).drop("__n")


def pending(regions: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The regions that have no result yet."""
    return regions.join(done.select(*keys).distinct(), keys, "left_anti")
