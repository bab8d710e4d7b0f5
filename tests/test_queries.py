"""Every relational query against its SQL, on the smallest tables."""

import pytest

from loomwright import queries

FOLDER = "/root/testdata/sf0.001"
WITHOUT_SQL = {"full_run", "journal_predictor", "journal_table", "journal_pattern", "journal_run"}


def test_all_have_sql_but_the_known():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == WITHOUT_SQL
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_patterns_of_one_table_share_one_shuffle(spark):
    """Fused aggregates and lagged columns need one exchange on the base keys."""
    from pyspark.sql import functions as F

    from loomwright.functions import PATTERNS, Binding
    from loomwright.plans.fuse import fused

    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("x"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"))
    b = Binding(("k",), {"numerical": "x", "temporal": "t"})
    from dataclasses import replace

    parts = [(f, PATTERNS["aggregate"].build(replace(b, params={"f": f}))) for f in ("avg", "min", "sum")]
    parts += [(n, PATTERNS[n].build(b)) for n in ("integral", "zero_crossing")]
    out = fused(df, b, parts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
