"""Array stores with an index beyond the whole numbers of INT, and of many small stems."""

import os

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from svloom.plans import catalogue
from svloom.sources import array_store


def test_windows_beyond_int(spark, sf, tmp_path):
    """At 60 times sf0.1 windows begin at up to 6,000,000,000, where the SQL's CAST has no result; its INT is BIGINT then."""
    far = 1_000_000
    for name in os.listdir(sf):
        if name != "lineitem.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    spark.read.parquet(f"{sf}/lineitem.parquet").limit(300).withColumn("l_partkey", F.col("l_partkey") + far).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalogue.QUERIES["scan_npy_store"](spark, str(tmp_path))
    assert dict(found.dtypes)["first"] == "bigint" and found.agg(F.min("first")).first()[0] > 1 << 32
    same_rows(found, catalogue.ORACLE_SQL["scan_npy_store"].replace("AS INT) AS first", "AS BIGINT) AS first").replace("AS INT) AS last", "AS BIGINT) AS last"), str(tmp_path))
    assert dict(catalogue.QUERIES["scan_npy_store"](spark, sf).dtypes)["first"] == "int"


def test_an_index_that_does_not_fit_is_an_error_and_small_stores_share_a_task(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 200).cast("string").alias("stem"), "id", F.array(F.col("id") + (1 << 33)).alias("index"), F.array(F.col("id") / 8).alias("features"), F.lit(None).cast("int").alias("label"))
    array_store.write_arrays(rows, str(tmp_path), ["id"])
    read = array_store.read_arrays(spark, str(tmp_path), "bigint")
    assert sorted(r["index"][0] for r in read.collect()) == [k + (1 << 33) for k in range(600)]
    assert read.rdd.getNumPartitions() < 10
    with pytest.raises(Exception, match="does not fit"):
        array_store.read_arrays(spark, str(tmp_path)).collect()
