"""Keys, lists, catalog, base, propagation, expansion, scores, journal and whole runs."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import types as T

from loomwright.functions import PATTERNS
from loomwright.functions.registry import Agg, Binding, Pattern, Row, Sweep
from loomwright.operators import base as base_ops
from loomwright.operators.propagate import Propagated, path_hash, propagate
from loomwright.operators.temporal import find_constraint
from loomwright.plans import score
from loomwright.plans.expand import FeatureSpec, column_tuples, cut, expand, parameters, patterns_for, sweep
from loomwright.plans.fuse import fused
from loomwright.plans.journal import Journal, Relevance, Scored, from_json, predictor_table, run_table, to_json
from loomwright.plans.run import run, two_stages
from loomwright.settings import REGRESSION, Settings
from loomwright.sources.catalog import Catalog, kinds
from loomwright.sources.keys import ForeignKey, both_ways, from_ddl, from_xml, key, to_xml
from loomwright.sources import keys as key_io
from loomwright.sources.lists import by_table, chosen, natural, parse


def test_ddl_keys():
    text = """
      alter table "orders"  add constraint fk1 foreign key (customer_id) references customers (id);
      ALTER TABLE s.child ADD FOREIGN KEY (a, "b c") REFERENCES p.parent(x , y) ON DELETE CASCADE;
      CREATE TABLE t (id int);
    """
    one, two = from_ddl(text, "main")
    assert one == ForeignKey("customers", ("id",), "orders", ("customer_id",), "fk1", "main", "main")
    assert two == ForeignKey("parent", ("x", "y"), "child", ("a", "b c"), "", "p", "s")


def test_keys_round_trip():
    ks = [key("a", ["x", "y"], "b", ["u", "v"], "n"), key("b", "u", "c")]
    assert from_xml(to_xml(ks)) == ks and key_io.from_json(key_io.to_json(ks)) == ks
    assert len(both_ways([*ks, ks[0].reversed()])) == 4
    with pytest.raises(ValueError):
        ForeignKey("a", ("x",), "b", ())


def test_lists():
    assert chosen(["a", "b", "c"], ["a", "b"], ["b"]) == ["a"]
    assert chosen(["t10", "t2"], [], []) == ["t2", "t10"]
    assert parse(" a, b ,,c ") == ["a", "b", "c"]
    assert by_table(["s.t.c", "t.d", "u"]) == {"t": {"c", "d"}, "u": set()}
    assert natural("a2") < natural("a10") < natural("b1")


def test_names_with_schemas():
    """One name in two schemas is two tables; an entry without a schema holds for both."""
    tables = ["a.orders", "b.orders", "plain"]
    assert by_table(["a.orders.x", "orders.y", "b.orders", "s.plain.z", "c.orders.q"], tables) == {"a.orders": {"x", "y"}, "b.orders": {"y"}, "plain": {"z"}}


def test_one_table_name_in_two_schemas(spark):
    """A run over schemas a and b, which both have orders, with keys within and across them."""
    rows = lambda k: spark.createDataFrame([(i, i % 4, float(i * k)) for i in range(12)], "o int, id int, amount double")
    tables = {"a.customers": spark.createDataFrame([(i, "pn"[i % 2]) for i in range(4)], "id int, y string"), "a.orders": rows(1), "b.orders": rows(10)}
    keys = [ForeignKey("customers", ("id",), "orders", ("id",), schema="a", f_schema="a"), ForeignKey("customers", ("id",), "orders", ("id",), schema="a", f_schema="b")]
    s = Settings("a.customers", ["id"], ["y"], column_black=["b.orders.amount"], least_relevance=0.0)
    got = run(tables, keys, s, [PATTERNS["aggregate"], PATTERNS["count"]])
    assert [t.table for t in got.tables] == ["a.customers", "a.orders", "b.orders"]
    assert {(x.spec.original, x.spec.pattern) for x in got.journal.all if ("numerical", "amount") in x.spec.columns or x.spec.pattern == "count"} == {("a.orders", "aggregate"), ("a.orders", "count"), ("b.orders", "count")}
    assert got.main_sample().count() == 4
    only = run(tables, keys, replace(s, table_white=["a.orders"]), [PATTERNS["count"]])
    assert [t.table for t in only.tables] == ["a.customers", "a.orders"]
    left = run(tables, keys, replace(s, table_black=["orders"]), [PATTERNS["count"]])
    assert [t.table for t in left.tables] == ["a.customers"]


def test_kinds():
    assert "nominal" in kinds(T.IntegerType()) and "numerical" in kinds(T.IntegerType())
    assert "nominal" in kinds(T.DecimalType(9, 0)) and "nominal" not in kinds(T.DecimalType(9, 2))
    assert kinds(T.ArrayType(T.StringType())) == set() and kinds(T.DayTimeIntervalType()) == {"any"}


def test_base_drops_repeated_keys_and_missing_dates(spark):
    d = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, d, "a"), (1, d, "b"), (2, d, "a"), (3, None, "a")], "id int, d timestamp_ntz, y string")
    s = Settings("t", ["id"], ["y"], "d")
    with pytest.warns(UserWarning):
        base = base_ops.build_base(df, s)
    assert [r["propagated_id1"] for r in base.collect()] == [2]
    assert base.collect() == base_ops.build_base(df, s, warn=False).collect()


def test_sample_keeps_all_classes(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else None if i % 20 else "rare") for i in range(100)], "id int, y string")
    s = Settings("t", ["id"], ["y"], sample_count=5)
    got = base_ops.sample_base(base_ops.build_base(df, s, warn=False), s).groupBy("propagated_target1").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 5, None: 5, "rare": 5}


def _shop(spark):
    d = lambda m, day=1: dt.datetime(2020, m, day)
    customers = spark.createDataFrame([(i, d(6, 1 + 3 * (i // 2)), "p" if i % 2 else "n") for i in range(8)], "id int, asked timestamp_ntz, y string")
    trades = spark.createDataFrame([(k, k % 8, d(1 + k % 11, 1 + k % 5), float(k)) for k in range(80)], "trade int, id int, at timestamp_ntz, amount double")
    return {"customers": customers, "trades": trades}, [key("customers", "id", "trades")]


S = Settings("customers", ["id"], ["y"], "asked", unit="month", lead=1, lag=3)


def test_window_is_inclusive_at_both_ends(spark):
    d = dt.datetime
    days = [d(2020, 5, 1), d(2020, 2, 1), d(2020, 5, 1, 0, 0, 1), d(2020, 1, 31, 23, 59, 59)]
    tables = {"customers": spark.createDataFrame([(1, d(2020, 6, 1), "p")], "id int, asked timestamp_ntz, y string"), "trades": spark.createDataFrame([(k, 1, x) for k, x in enumerate(days)], "trade int, id int, at timestamp_ntz")}
    s = replace(S)
    catalog = Catalog(tables, [key("customers", "id", "trades")], s)
    found = propagate(base_ops.build_base(tables["customers"], s), catalog, dt.datetime(2021, 1, 1), persist=False)
    assert sorted(r["trade"] for r in found[1].df.collect()) == [0, 1]


def test_empty_window_is_dropped(spark):
    tables, keys = _shop(spark)
    s = replace(S, lead=600)
    catalog = Catalog(tables, keys, s)
    base = base_ops.build_base(tables["customers"], s)
    found = propagate(base, catalog, dt.datetime(2021, 1, 1), persist=False)
    assert found[1].temporal is None and found[1].rows == 80


def test_temporal_constraint_rules(spark):
    tables, keys = _shop(spark)
    base = base_ops.build_base(tables["customers"], S)
    now = dt.datetime(2021, 1, 1)
    find = lambda t, unique=False, not_null=(), now=now: find_constraint(Catalog({**tables, "trades": t}, keys, S, not_null=not_null), "trades", base, unique, now)
    t = tables["trades"]
    assert find(t) == "at"
    assert find(t, unique=True) is None
    assert find(t, now=dt.datetime(2020, 3, 1)) is None  # future dates
    from pyspark.sql import functions as F

    assert find(t.withColumn("at", F.when(F.col("trade") > 0, F.col("at")))) is None  # a null
    past = F.when(F.col("trade") >= 0, F.lit(dt.datetime(1990, 1, 1)).cast("timestamp_ntz"))
    two = t.withColumn("old", past)
    assert find(two) == "at"
    assert find(two, not_null=["trades.old"]) == "old"
    assert find(t.withColumn("zz", F.col("at"))) == "zz"  # of equals the last
    assert find(t.withColumn("at", past)) is None  # nothing usable


def test_parallel_keys_give_two_tables(spark):
    tables = {
        "molecule": spark.createDataFrame([(1, "a"), (2, "b")], "m int, y string"),
        "atom": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "a int, m int"),
        "bond": spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a1 int, a2 int"),
        "island": spark.createDataFrame([(1,)], "z int"),
    }
    keys = [key("molecule", "m", "atom"), key("atom", "a", "bond", "a1"), key("atom", "a", "bond", "a2")]
    s = Settings("molecule", ["m"], ["y"])
    found = propagate(base_ops.build_base(tables["molecule"], s), Catalog(tables, keys, s), persist=False)
    assert [p.table for p in found] == ["molecule", "atom", "bond", "bond"]
    assert [p.rows for p in found] == [2, 3, 3, 3] and len({p.name for p in found}) == 4
    near = propagate(base_ops.build_base(tables["molecule"], s), Catalog(tables, keys, replace(s, max_depth=1)), persist=False)
    assert [p.table for p in near] == ["molecule", "atom"]


def test_hash_is_stable():
    assert path_hash("a/b") == path_hash("a/b") != path_hash("b/a") and len(path_hash("")) == 12


def test_main_sample_keeps_the_best_of_the_budget(spark):
    """Features beyond the budget go by worth, not by number, and not silently."""
    tables, keys = _shop(spark)
    library = [PATTERNS[n] for n in ("aggregate", "count", "slope", "entropy", "time_aggregate")]
    got = run(tables, keys, replace(S, least_relevance=0.0), library, now=dt.datetime(2021, 1, 1))
    ranked = [x.spec.name for x in got.journal.ranked()]
    got.settings = replace(S, column_budget=len(got.base.columns) + 2)
    with pytest.warns(UserWarning, match="keeps the best 2"):
        sample = got.main_sample()
    kept = set(sample.columns) - set(got.base.columns)
    assert kept == set(ranked[:2]) and len(ranked) > 2
    assert sorted(got.journal.best(), key=lambda x: -x.weighted("propagated_target1"))[0].spec.name in kept


def test_a_feature_that_fails_leaves_the_others(spark):
    tables, keys = _shop(spark)
    broken = Pattern("broken", "n", ("numerical",), lambda b: Agg(b.sql("max(raise_error({numerical_raw}))")))
    unknown = Pattern("unknown", "n", (), lambda b: Agg("no_such_function(1)"))
    PATTERNS.update({p.key: p for p in (broken, unknown)})
    try:
        got = run(tables, keys, S, [PATTERNS["aggregate"], broken, unknown, PATTERNS["count"]], now=dt.datetime(2021, 1, 1))
        by = {}
        for x in got.journal.all:
            by.setdefault(x.spec.pattern, []).append(x)
        assert all(x.exception and not x.ok for x in by["broken"] + by["unknown"]) and all(x.rows == 8 and not x.exception for x in by["aggregate"] + by["count"])
        assert set(got.journal.failed_patterns()) == {"broken", "unknown"} and got.main_sample().count() == 8
        journal = {r["predictor_id"]: r for r in predictor_table(spark, got.journal, got.tables).collect()}
        one = journal[by["aggregate"][0].spec.number]
        assert one["data_type"] == "double" and one["category_type"] == "numerical" and one["propagation_depth"] == 1 and one["is_ok"] == 1 and one["date_constraint"] == "at" and one["start_time"]
        assert all(journal[x.spec.number]["exception_message"] for x in by["unknown"])
        assert run_table(spark, S, 2, got.journal).first()["error_count"] == len(by["broken"] + by["unknown"])
    finally:
        del PATTERNS["broken"], PATTERNS["unknown"]


def test_a_feature_that_takes_too_long_is_given_up(spark):
    tables, keys = _shop(spark)
    forever = "aggregate(sequence(1, 40000000), 0D, (a, i) -> a + sqrt(i))"
    slow = Pattern("slow", "n", (), lambda b: Agg(f"max({forever} + rand())"))
    PATTERNS["slow"] = slow
    try:
        got = run(tables, keys, replace(S, seconds_limit=20.0), [PATTERNS["count"], slow], now=dt.datetime(2021, 1, 1))
        by = {x.spec.pattern: x for x in got.journal.all}
        assert by["slow"].exception and not by["slow"].ok and by["count"].ok
    finally:
        del PATTERNS["slow"]


def test_sweeps_to_the_ends_of_the_window():
    assert Sweep("leadMin", "lagMax", 3, True).values(10, 2) == [2, 7, 12]
    swept = Pattern("swept", "n", (), lambda b: Row("1"), sweeps={"n": Sweep("leadMin", "lagMax", 2)})
    assert [x["n"] for x in sweep(swept, S)] == [1, 4]


def test_literals_parse(spark):
    from loomwright.functions.registry import literal

    values = [float("nan"), float("inf"), -float("inf"), 1.5, "a'b\\c", None, True, 3]
    got = spark.range(1).selectExpr(*(f"{literal(v)} AS c{k}" for k, v in enumerate(values))).first()
    assert all(a == b or a != a and b != b for a, b in zip(got, values))


def test_braces_in_column_names(spark):
    df = spark.createDataFrame([(1, 1.0, dt.datetime(2020, 1, 1)), (1, 3.0, dt.datetime(2020, 1, 2))], "id int, `a{b}` double, t timestamp_ntz")
    part = PATTERNS["integral"].build(Binding(("id",), {"numerical": "a{b}", "temporal": "t"}))
    assert fused(df, Binding(("id",)), [("x", part)]).first()["x"] == 2 * 86400


def test_each_distinct_input_has_a_grouping_of_its_own(spark):
    """No grouping has a copy of each row for each distinct column."""
    df = spark.range(50).selectExpr("id % 5 AS k", "id AS a", "id % 3 AS b", "CAST(id % 7 AS double) AS c")
    parts = [(n, PATTERNS["distinct_count"].build(Binding(("k",), {"nominal": n}))) for n in ("a", "b")]
    parts += [(f, PATTERNS["aggregate_distinct"].build(Binding(("k",), {"numerical": "c"}, {"f": f}))) for f in ("avg", "sum")]
    out = fused(df, Binding(("k",)), parts)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: (r["a"], r["b"]) for r in out.collect()} == {k: (10, 3) for k in range(5)}


def test_scores_join_no_rows(spark):
    """R squared and chi-square look at counts by value only: no join on rows, and none by feature alone that is shuffled."""
    df = spark.range(200).selectExpr("CAST(id % 13 AS string) AS f", "CAST(id AS double) AS x", "CAST(id % 5 AS double) AS y", "CAST(id % 3 AS string) AS z")
    for got in (score.r_square(df, ["f", "x"], "y"), score.chi_square(df, ["f", "x"], "z")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "Cartesian" not in plan
    import numpy as np

    pdf = df.toPandas()
    x = pdf.groupby("f")["y"].transform("mean")
    want = {"f": len(pdf) * np.corrcoef(x, pdf["y"])[0, 1] ** 2, "x": len(pdf) * np.corrcoef(pdf["x"], pdf["y"])[0, 1] ** 2}
    assert {r[0]: r[1] for r in score.r_square(df, ["f", "x"], "y").collect()} == pytest.approx(want, rel=1e-9)


def test_naive_bayes_with_many_classes(spark, monkeypatch):
    """Salted classes give what broadcast ones give."""
    from loomwright.functions import target

    df = spark.createDataFrame([(k, "abc"[k % 3], "xyz"[(k * k) % 3]) for k in range(60)], "id int, v string, t string")
    b = Binding(("id",), {"nominal": "v"}, target="t", target_value="x")
    want = sorted(map(tuple, PATTERNS["direct_nb"].build(b).make(df).collect()))
    monkeypatch.setattr(target, "MOST_CLASSES", 0)
    assert sorted(map(tuple, PATTERNS["direct_nb"].build(b).make(df).collect())) == want and len(want) == 60


def test_tables_and_keys_of_a_database(spark):
    """An embedded database: tables, views, keys, composite keys, unique indexes and columns without null."""
    from loomwright.sources.database import Database
    from loomwright.sources.keys import ForeignKey

    url = "jdbc:derby:memory:loomwright;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()
    for sql in (
        "CREATE TABLE customers (id INT PRIMARY KEY, y VARCHAR(9) NOT NULL)",
        "CREATE TABLE trades (trade INT, part INT, id INT REFERENCES customers (id), amount DOUBLE, CONSTRAINT p PRIMARY KEY (trade, part))",
        "CREATE TABLE notes (trade INT, part INT, text VARCHAR(20), code INT NOT NULL CONSTRAINT u UNIQUE, CONSTRAINT f FOREIGN KEY (trade, part) REFERENCES trades (trade, part))",
        "INSERT INTO customers VALUES (1, 'a'), (2, 'b'), (3, 'a')",
        "INSERT INTO trades VALUES (1, 1, 1, 5), (2, 1, 1, 7), (3, 1, 2, 1), (4, 1, 3, 9)",
    ):
        statement.execute(sql)
    with Database(spark, url, "APP") as database:
        names = database.tables()
        assert names == ["CUSTOMERS", "NOTES", "TRADES"] and database.tables(black=["NOTES"]) == ["CUSTOMERS", "TRADES"] and "APP" in database.schemas()
        keys = database.foreign_keys(names)
        assert {(k.table, k.columns, k.f_table, k.f_columns) for k in keys} == {("CUSTOMERS", ("ID",), "TRADES", ("ID",)), ("TRADES", ("TRADE", "PART"), "NOTES", ("TRADE", "PART"))}
        assert all(isinstance(k, ForeignKey) for k in keys) and database.foreign_keys(["TRADES"]) == []
        assert database.primary_keys(names) == {"CUSTOMERS": "ID", "NOTES": "CODE"}
        assert {"CUSTOMERS.Y", "TRADES.PART", "NOTES.CODE"} <= set(database.not_null(names)) and "TRADES.ID" not in database.not_null(names)
        tables = {n: database.table(n) for n in names}
        got = run(tables, keys, Settings("CUSTOMERS", ["ID"], ["Y"], least_relevance=0.0), [PATTERNS["aggregate"], PATTERNS["count"]], primary=database.primary_keys(names))
        assert got.main_sample().count() == 3 and {t.table for t in got.tables} == {"CUSTOMERS", "TRADES"}


def test_expansion(spark):
    tables, keys = _shop(spark)
    catalog = Catalog(tables, keys, S)
    found = propagate(base_ops.build_base(tables["customers"], S), catalog, dt.datetime(2021, 1, 1), persist=False)
    two = Pattern("two", "n", (), lambda b: Row("1"), params={"a": (1, 2), "b": (3, 4)})
    assert len(parameters(two)) == 4 and len(list(expand(found, catalog, [two]))) == 4
    swept = Pattern("swept", "n", (), lambda b: Row("1"), sweeps={"n": Sweep(1, 10, 4, True)})
    assert [x["n"] for x in sweep(swept)] == [1, 4, 7, 10]
    got = list(expand(found, catalog, [swept]))
    assert len({x.group for x in got}) == 1 and [x.number for x in got] == [100000, 100001, 100002, 100003]
    names = [dict(x.columns) for x in expand(found, catalog, [PATTERNS["correlation"]])]
    assert {"numerical": "amount", "temporal": "at"} in names and all(n["temporal"] == "at" for n in names)
    assert all(len(set(t.values())) == 2 for t in column_tuples(PATTERNS["ratio"], found[1], catalog))
    values = list(expand(found, catalog, [PATTERNS["existential_count"]]))
    assert values and all("value" in dict(x.params) for x in values)


def test_alternative_column_kinds(spark):
    rows = [(1, 7, 1.5, "a", dt.date(2020, 1, 1)), (1, 7, 2.5, "b", dt.date(2020, 1, 2)), (1, 8, 2.5, "b", dt.date(2020, 1, 3)), (1, 8, 0.5, "b", dt.date(2020, 1, 3))]
    df = spark.createDataFrame(rows, "id long, n int, price double, word string, day date")
    catalog = Catalog({"b": spark.createDataFrame([(1, "x")], "id long, t string"), "c": df}, [key("c", "id", "b", "id")], Settings("b", ["id"], ["t"]))
    table = Propagated("c_of_b", "c", df, ("b", "c"))
    columns = {n: [x["nominal"] for x in column_tuples(PATTERNS[n], table, catalog) if x.get("temporal", "day") == "day"] for n in ("change_count", "change_ratio", "duplicate_ratio", "concentration", "entropy")}
    assert all(len(set(c)) == len(c) for c in columns.values())
    for n in ("change_count", "change_ratio", "duplicate_ratio"):
        assert {"n", "price", "word"} <= set(columns[n]) and "day" not in columns[n]
    assert {"word", "day"} <= set(columns["concentration"]) and "price" not in columns["concentration"] + columns["entropy"]
    b = Binding(("id",), {"nominal": "price", "temporal": "day"})
    parts = [("count", PATTERNS["change_count"].build(b)), ("ratio", PATTERNS["change_ratio"].build(b)), ("repeats", PATTERNS["duplicate_ratio"].build(b))]
    parts.append(("most", PATTERNS["concentration"].build(replace(b, columns={"nominal": "day"}))))
    got = fused(df, Binding(("id",)), parts, ["price"]).collect()
    assert [(r["repeats"], r["most"]) for r in got] == [(0.5, 50.0)]
    # Of the last day's two rows the lower price comes first: 1.5, 2.5, 0.5, 2.5.
    assert [(r["count"], r["ratio"]) for r in got] == [(3, 1.5)]


def test_patterns_that_need_dates_or_classes():
    dated = {p.key for p in patterns_for(S)}
    static = {p.key for p in patterns_for(replace(S, target_date=None))}
    numeric = {p.key for p in patterns_for(replace(S, task=REGRESSION))}
    assert "frequency" in dated - static and "woe" in dated - numeric
    assert [p.key for p in patterns_for(replace(S, pattern_white=["count", "mode"], pattern_black=["mode"]))] == ["count"]


def test_names_are_cut_between_characters():
    assert cut("žžž", 5) == "žž" and cut("a b", 9) == "a_b"
    assert FeatureSpec("count", "p", "trades", number=7).name == "trades_count_7"


def test_chi_square_of_identity(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x"), ("a", None)], "f string, y string")
    assert score.chi_square(df, ["f"], "y").collect()[0]["relevance"] == pytest.approx(1.0)  # 2 over two bins


def test_scores_of_constants_and_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (1.0, None, 2.0)], "c double, n double, y double")
    assert {r[0]: r[1] for r in score.r_square(df, ["c", "n"], "y").collect()} == {"c": 0.0}
    got = {r[0]: r[1] for r in score.r_square(df.selectExpr("y AS f", "y"), ["f"], "y").collect()}
    assert got["f"] == pytest.approx(2.0)


def test_drift_of_stable_and_turned(spark):
    rows = [(dt.datetime(2020, 1, 1 + k % 20), "u" if k % 2 else "v", "u" if (k % 2) == (k % 20 < 10) else "v") for k in range(400)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, same string, turned string").withColumnRenamed("same", "stable").selectExpr("*", "stable AS y")
    got = {r[0]: r[1] for r in score.concept_drift(df, ["stable", "turned"], "y", "d", score.pivot_date(df, "d")).collect()}
    assert got["stable"] > 0.9 > 0.1 > got["turned"]


def _scored(n, *relevance, group="", ok=True, target=None, pattern="x"):
    return Scored(FeatureSpec(pattern, "t", "t", number=n, group=group, target=target), {f"t{k}": Relevance(r) for k, r in enumerate(relevance)}, rows=n, ok=ok)


def test_journal_keeps_the_best_of_each_target():
    j = Journal(["t0", "t1"], 2)
    for n, (a, b) in enumerate([(0.5, 0.0), (0.0, 0.8), (0.7, 0.2), (0.6, 0.1)]):
        j.add(_scored(n, a, b))
    assert [x.relevance["t0"].relevance for x in j.of("t0")] == [0.7, 0.6]
    assert [x.relevance["t1"].relevance for x in j.of("t1")] == [0.8, 0.2]
    assert [x.spec.number for x in j.best()] == [1, 2, 3]


def test_journal_leaves_out():
    j = Journal(["t0"], 5)
    assert not j.add(_scored(1, 0.0)) and not j.add(_scored(2, 0.9, ok=False, pattern="broken"))
    still = _scored(3, 0.5)
    still.relevance["t0"].drift = 0.0
    assert not j.add(still)
    assert j.add(_scored(4, 0.4, group="g")) and not j.add(_scored(5, 0.3, group="g")) and j.add(_scored(6, 0.6, group="g"))
    assert [x.spec.number for x in j.best()] == [6]
    twin = _scored(7, 0.6)
    twin.rows = 6
    assert not j.add(twin) and twin.duplicate_of == j.best()[0].spec.name
    assert j.failed_patterns() == ["broken"]


def test_duplicates_of_features_that_were_not_kept():
    """A twin of a good feature is left out also where the first has gone since."""
    j = Journal(["t0"], 1)
    assert j.add(_scored(1, 0.5)) and j.add(_scored(2, 0.9))
    twin = _scored(3, 0.5)
    twin.rows = 1
    assert not j.add(twin) and twin.duplicate_of and [x.spec.number for x in j.best()] == [2]


def test_specs_round_trip():
    x = _scored(1, 0.5)
    x.spec = replace(x.spec, columns=(("numerical", "a"),), params=(("f", "avg"), ("lag", 3)))
    assert from_json(to_json([x])) == [x.spec]


def test_whole_run_keeps_every_base_row_and_repeats(spark):
    tables, keys = _shop(spark)
    library = [PATTERNS[n] for n in ("aggregate", "count", "woe", "slope", "entropy", "time_aggregate_since")]
    now = dt.datetime(2021, 1, 1)
    first = run(tables, keys, S, library, now=now)
    sample = first.main_sample()
    assert sample.count() == 8 and len(sample.columns) > 4
    again = run(tables, keys, S, library, now=now).main_sample()
    assert sample.columns == again.columns and sorted(map(str, sample.collect())) == sorted(map(str, again.collect()))
    assert list(first.main_samples()) == ["mainsample_y"]
    first.release()
    uncached = run(tables, keys, S, library, now=now, persist=False).main_sample()
    assert sorted(map(str, uncached.collect())) == sorted(map(str, sample.collect()))


def test_two_stages(spark):
    tables, keys = _shop(spark)
    library = [PATTERNS[n] for n in ("aggregate", "count")]
    explored, exploited = two_stages(tables, keys, S, 2, library=library, now=dt.datetime(2021, 1, 1))
    assert explored.base.count() == 4 and exploited.base.count() == 8
    assert {x.spec for x in exploited.journal.all} == {x.spec for x in explored.journal.best()}


def test_future_leak_is_out_of_reach(spark):
    """A column that tells the target only after the base date does not show in features under the window."""
    d = dt.datetime
    customers = spark.createDataFrame([(i, d(2020, 6, 1 + i // 2), "p" if i % 2 else "n") for i in range(40)], "id int, asked timestamp_ntz, y string")
    rows = [(i, d(2020, m, 2), float(i % 2) if m > 6 else 0.5) for i in range(40) for m in (3, 4, 9)]
    tables = {"customers": customers, "events": spark.createDataFrame(rows, "id int, at timestamp_ntz, leak double")}
    got = run(tables, [key("customers", "id", "events")], S, [PATTERNS["aggregate"]], now=d(2021, 1, 1))
    assert not got.journal.best()


def test_regression_run(spark):
    tables, keys = _shop(spark)
    from pyspark.sql import functions as F

    tables["customers"] = tables["customers"].withColumn("y", F.col("id") * 1.5)
    got = run(tables, keys, replace(S, task=REGRESSION, target_date=None), [PATTERNS["aggregate"], PATTERNS["woe"]])
    assert got.journal.best() and all(x.spec.pattern == "aggregate" for x in got.journal.best())
