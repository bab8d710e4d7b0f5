import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the smallest test tables as views."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return float(f"{value:.6g}") if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def same():
    """Whether two pandas tables hold the same rows in any order, numbers to six digits."""

    def rows(df):
        df = df[sorted(df.columns)]
        return sorted((tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None)), key=str)

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
