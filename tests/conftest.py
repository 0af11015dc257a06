import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    session = builder.config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


def close(value):
    """Floats to nine digits, lists to tuples."""
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(close(x) for x in value)
    return value


def same_rows(df, sql: str, sf_dir: str) -> None:
    """df and the DuckDB rows of sql hold the same rows under the same names."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    found = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    place = [found.columns.index(c) for c in names]
    ours = sorted(repr([close(r[c]) for c in names]) for r in df.collect())
    theirs = sorted(repr([close(r[k]) for k in place]) for r in found.fetchall())
    assert ours == theirs
