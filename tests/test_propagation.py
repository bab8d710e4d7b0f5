"""What propagation reads, keeps and spreads, and runs that go on where they stopped."""

import datetime as dt
import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomwright.functions import PATTERNS, Binding
from loomwright.functions.registry import Agg, Counts
from loomwright.operators import base as base_ops
from loomwright.operators import propagate as propagate_ops
from loomwright.operators.propagate import Propagated, heavy_slots, join_on, propagate
from loomwright.operators.temporal import span_of
from loomwright.plans import run as runs
from loomwright.plans.expand import expand
from loomwright.plans.fuse import fused
from loomwright.settings import Settings
from loomwright.sources.catalog import Catalog
from loomwright.sources.keys import key
from loomwright.sources.store import Store

S = Settings("customers", ["id"], ["y"], "asked", unit="month", lead=1, lag=3)
NOW = dt.datetime(2021, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def whole_plans(spark):
    """Plans tell all filters, columns and folders that a scan has."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def near(df):
    """Rows as text, numbers to nine digits: sums come in another order where another plan makes them."""
    return sorted(str(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Customers, their orders and the lines of these, as files; orders and lines have columns that no feature uses."""
    folder = tmp_path_factory.mktemp("shop")
    d = lambda m, day=1: dt.datetime(2020, m, day)
    tables = {
        "customers": spark.createDataFrame([(i, d(6, 1 + 3 * (i // 2)), "p" if i % 2 else "n") for i in range(8)], "id int, asked timestamp_ntz, y string"),
        "orders": spark.createDataFrame([(k, k % 8, d(1 + k % 11, 1 + k % 5), float(k), "x" * k) for k in range(80)], "o int, id int, at timestamp_ntz, amount double, waste string"),
        "lines": spark.createDataFrame([(k, k % 80, float(k % 7), d(1 + k % 11, 1 + k % 5).date(), f"w{k}") for k in range(400)], "l int, o int, price double, sent date, waste string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}, [key("customers", "id", "orders"), key("orders", "o", "lines")]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
@pytest.mark.parametrize("unit", ["day", "month"])
def test_both_ends_of_all_windows_reach_the_scan(spark, tmp_path, kind, unit):
    s = replace(S, unit=unit)
    base = base_ops.build_base(spark.createDataFrame([(i, dt.datetime(2020, 3 + i, 1 + i, 7 * i), "p") for i in range(3)], "id int, asked timestamp_ntz, y string"), s)
    spark.sql(f"SELECT CAST(id % 3 AS INT) AS who, CAST(TIMESTAMP_NTZ'2019-09-01 00:00:00' + make_dt_interval(0, CAST(5 * id AS INT)) AS {kind}) AS at FROM range(2000)").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    got = join_on(base, rows, ["propagated_id1"], ["who"], s, "at", span_of(base))
    filters = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(got), re.S)[1]
    assert "GreaterThanOrEqual(at," in filters and "LessThanOrEqual(at," in filters
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, join_on(base, rows, ["propagated_id1"], ["who"], s, "at").collect())) != []


def test_only_bound_columns_are_read(spark, shop):
    tables, keys = shop
    catalog = Catalog(tables, keys, S)
    base = base_ops.build_base(tables["customers"], S)
    found = propagate(base, catalog, NOW)
    assert [(p.table, p.rows > 0) for p in found] == [("customers", True), ("orders", True), ("lines", True)]
    specs = list(expand(found, Catalog(tables, keys, replace(S, column_white=["orders.amount", "lines.price"])), [PATTERNS["aggregate"]]))
    read = {}
    for p in found[1:]:
        plan = runs.bound(p, [x for x in specs if x.table == p.name], S)._jdf.queryExecution().executedPlan().toString()
        read[p.table] = {tuple(sorted(c.split(":")[0] for c in m.split(","))) for m in re.findall(r"ReadSchema: struct<(.*?)>", plan)}
        assert "spine-" in plan  # the level before, not the tables that made it
    assert ("amount", "at", "id", "o") in read["orders"] and ("o", "price", *(["sent"] if found[2].temporal else [])) in read["lines"]
    assert not any("waste" in columns for some in read.values() for columns in some) and not any("amount" in c for c in read["lines"])


def test_a_level_has_no_lineage_but_the_spine_before(spark, shop):
    tables, keys = shop
    found = propagate(base_ops.build_base(tables["customers"], S), Catalog(tables, keys, S), NOW)
    plan = plan_of(found[2].df)
    assert plan.count("FileScan parquet") == 2 and "waste" not in plan_of(found[1].spine)
    assert set(found[1].spine.columns) == {"propagated_id1", "propagated_date", "propagated_target1", "propagated_fold", "id", "o"}


@pytest.mark.parametrize("heavy_side", ["table", "before"])
def test_a_heavy_key_is_spread(spark, heavy_side):
    """One key has half of all rows: its rows are dealt to all partitions, and no row is lost or repeated."""
    s = Settings("t", ["id"], ["y"])
    base = base_ops.build_base(spark.range(2000).selectExpr("CAST(id AS INT) AS id", "CAST(id % 2 AS STRING) AS y"), s, warn=False)
    many = spark.range(40_000).selectExpr("CAST(CASE WHEN id % 2 = 0 THEN 7 ELSE id % 2000 END AS INT) AS k", "id AS row")
    one = spark.range(2000).selectExpr("CAST(id AS INT) AS k", "id AS row")
    before, table, own = (base, many, "propagated_id1") if heavy_side == "table" else (base.drop("propagated_id1").limit(1).crossJoin(many.withColumnRenamed("row", "propagated_id1")), one, "k")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = join_on(before, table, [own], ["k"], s, None)
        spread = join_on(before, table, [own], ["k"], s, None, heavy=1000)
        rows = lambda df: sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        assert rows(plain)[-1] > 5 * rows(plain)[len(rows(plain)) // 2]
        assert len(rows(spread)) == 16 and rows(spread)[-1] < 3 * rows(spread)[8]
        columns = ["propagated_id1", "row"]
        assert Counter(map(tuple, spread.select(columns).collect())) == Counter(map(tuple, plain.select(columns).collect()))
        assert spread.columns == plain.columns
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("persist", [True, False])
def test_pairs_through_a_key_of_few_values_are_counted_not_made(spark, persist):
    """Each side has half of its rows at one of two places: 5,000,000 pairs, which no join gives out."""
    t = {
        "people": spark.range(4000).selectExpr("id AS p", "CAST(id % 2 AS INT) AS place", "CAST(id % 3 AS STRING) AS y"),
        "places": spark.range(2).selectExpr("CAST(id AS INT) AS place"),
        "shops": spark.range(2500).selectExpr("id AS shop", "CAST(id % 2 AS INT) AS place"),
    }
    keys = [key("people", "place", "places", "place"), key("shops", "place", "places", "place")]
    s = Settings("people", ["p"], ["y"])
    base = base_ops.build_base(t["people"], s, warn=False)
    seen = []
    shape = propagate_ops._shape
    propagate_ops._shape = lambda df, s: (seen.append(df.count()), shape(df, s))[1]
    try:
        found = {p.table: p for p in propagate(base, Catalog(t, keys, s), persist=persist)}
    finally:
        propagate_ops._shape = shape
    assert {n: (p.rows, p.is_target_id_unique) for n, p in found.items()} == {"people": (4000, True), "places": (4000, True), "shops": (5_000_000, False)}
    assert max(seen) == 4000 and found["shops"].spine is None


def test_sketch_of_keys(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 300 THEN 5 WHEN id < 400 THEN NULL ELSE id END AS k")
    assert len(heavy_slots(df, ["k"], 200)) == 1 and not heavy_slots(df, ["k"], 400)


def test_uniqueness_is_looked_at_once(spark, shop):
    tables, keys = shop
    catalog = Catalog(tables, keys, S)
    assert catalog.is_unique("orders", ("o",)) and not catalog.is_unique("orders", ["id"])
    catalog.tables["orders"].df = None  # a second look would fail
    assert catalog.is_unique("orders", ("o",))


LIBRARY = [PATTERNS[n] for n in ("aggregate", "count", "slope", "entropy", "change_count")]


def test_samples_come_from_written_sets(spark, shop):
    tables, keys = shop
    got = runs.run(tables, keys, replace(S, fuse_width=6), LIBRARY, now=NOW)
    assert len(got.sets) > 3 and sorted(n for own in got.sets.values() for n in own) == sorted(x.spec.name for x in got.journal.all)
    sample = got.main_sample()
    assert "features-" in plan_of(sample) and "Window" not in plan_of(sample)
    rows = near(sample)
    got.release()
    again = got.main_sample()
    assert again.columns == sample.columns and near(again) == rows


def test_a_run_that_died_goes_on(spark, shop, tmp_path, monkeypatch):
    """Killed after two sets, a second start computes the others only, and ends with the same sample and journal."""
    tables, keys = shop
    s, folder = replace(S, fuse_width=6), f"{tmp_path}/kept"
    calls, real = [], runs.score_table

    def dies(wide, specs, *rest):
        if len(calls) == 2:
            raise KeyboardInterrupt
        calls.append([x.name for x in specs])
        return real(wide, specs, *rest)

    monkeypatch.setattr(runs, "score_table", dies)
    with pytest.raises(KeyboardInterrupt):
        runs.run(tables, keys, s, LIBRARY, now=NOW, folder=folder)

    def counted(wide, specs, *rest):
        calls.append([x.name for x in specs])
        return real(wide, specs, *rest)

    monkeypatch.setattr(runs, "score_table", counted)
    second = runs.run(tables, keys, s, LIBRARY, now=NOW, folder=folder)
    names = [x.spec.name for x in second.journal.all]
    assert [n for own in calls for n in own] == names and len(calls) > 3
    fresh = runs.run(tables, keys, s, LIBRARY, now=NOW)
    told = lambda r: [(x.spec, x.relevance, x.rows, x.nulls, x.ok, x.data_type, x.category, x.duplicate_of) for x in r.journal.all]
    assert told(second) == told(fresh)
    assert near(second.main_sample()) == near(fresh.main_sample())
    before = len(calls)
    third = runs.run(tables, keys, s, LIBRARY, now=NOW, folder=folder)
    assert len(calls) == before and told(third) == told(fresh)  # nothing was left to do
    runs.run(tables, keys, replace(s, lag=2), LIBRARY, now=NOW, folder=folder)
    assert len(calls) > before  # other settings are another run


def test_store_knows_whole_tables(spark, tmp_path):
    store = Store(spark, "x", str(tmp_path))
    assert not store.has("a")
    df = store.keep(spark.range(3), "a")
    assert store.has("a") and df.count() == 3 and runs.once(store, spark.range(9), "a").count() == 3
    store.drop("a")
    assert not store.has("a")


def test_rows_joined_by_a_base_id_are_grouped_without_a_shuffle(spark):
    """Both sides of the join are shuffled, its rows by base id are not; nor are they sorted for the text of a target."""
    s = Settings("base", ["id"], ["y"])
    base = spark.range(20).selectExpr("id AS propagated_id1", "CAST(id % 3 AS STRING) AS propagated_target1", "0 AS propagated_fold")
    rows = spark.range(200).selectExpr("id AS n", "id % 25 AS k")
    b = Binding(("propagated_id1",), target="propagated_target1")
    parts = [("total", Agg("sum(n)")), ("kinds", Counts("n", "count(*)"))]
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_on(base, rows, ["propagated_id1"], ["k"], s, None)
        assert plan_of(joined.groupBy("propagated_id1").count()).count("Exchange ") == 2
        got = fused(joined, b, parts)
        assert "SortAggregate" not in plan_of(got)
        assert {r["propagated_id1"]: tuple(r)[1:] for r in got.collect()} == {i: (str(i % 3), sum(range(i, 200, 25)), 8) for i in range(20)}
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)


def test_rows_of_a_base_row_lie_in_one_partition_unless_they_are_too_many(spark):
    table = Propagated("t", "t", spark.range(0, 40, 1, 4).selectExpr("id % 5 AS propagated_id1"), ("t",), most=8)
    s = Settings("base", ["id"], ["y"])

    def parts(t: Propagated) -> int:
        return max(r["n"] for r in t.df.withColumn("p", F.spark_partition_id()).groupBy("propagated_id1").agg(F.countDistinct("p").alias("n")).collect())

    assert parts(runs.by_base_row(table, s)) == 1 and parts(runs.by_base_row(table, replace(s, heavy_key_rows=7))) == 4


def test_a_side_of_unique_keys_is_not_looked_at(spark, monkeypatch):
    """Rows counted by key hold each key once: no scan looks for heavy ones."""
    seen = []
    monkeypatch.setattr(propagate_ops, "heavy_slots", lambda df, columns, rows: seen.append(tuple(columns)) or set())
    customers = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "id long, y string")
    orders = spark.createDataFrame([(i, i % 6) for i in range(30)], "o long, c long")
    s = Settings("customers", ["id"], ["y"])
    catalog = Catalog({"customers": customers, "orders": orders}, [key("orders", "c", "customers", "id")], s)
    found = propagate(base_ops.build_base(customers, s), catalog)
    assert [(p.table, p.rows, p.most) for p in found] == [("customers", 6, 1), ("orders", 30, 5)]
    assert seen == [("_f0",)]  # of the orders themselves, once
