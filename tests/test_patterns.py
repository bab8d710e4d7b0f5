"""Patterns on small tables with values worked out by hand."""

import datetime as dt
import math
from dataclasses import replace

import pytest
from pyspark.sql import types as T

from loomwright.functions import PATTERNS, Binding
from loomwright.plans.fuse import single

B = Binding(("id",), target="y", target_value="p")


def value(spark, name, rows, schema, columns, params=None, b=B, **more):
    df = spark.createDataFrame(rows, schema)
    part = PATTERNS[name].build(replace(b, columns=columns, params=params or {}, **more))
    return {r["id"]: r["value"] for r in single(df, b, part).collect()}


def numbers(spark, name, xs, params=None, slot="numerical"):
    return value(spark, name, [(1, "p", x) for x in xs], "id int, y string, x double", {slot: "x"}, params).get(1)


def timed(spark, name, pairs, params=None):
    rows = [(1, "p", x, dt.datetime(2020, 1, 1) + dt.timedelta(days=d)) for d, x in pairs]
    schema = T.StructType.fromDDL("id int, y string, x double, t timestamp_ntz")
    return value(spark, name, rows, schema, {"numerical": "x", "nominal": "x", "temporal": "t"}, params).get(1)


def test_woe_of_ids_is_unbiased(spark):
    balanced = value(spark, "woe", [(i, y, i) for i, y in enumerate("pnpn")], "id int, y string, v int", {"nominal": "v"})
    assert all(abs(x) < 1e-9 for x in balanced.values()) and len(balanced) == 4
    uneven = value(spark, "woe", [(i, y, i) for i, y in enumerate("pnpnp")], "id int, y string, v int", {"nominal": "v"})
    assert all(x == pytest.approx(-22.314, abs=1e-3) for x in uneven.values())


def test_woe_leaves_null_values_out(spark):
    assert set(value(spark, "woe", [(1, "p", 1), (2, "n", None)], "id int, y string, v int", {"nominal": "v"})) == {1}


def test_sequences(spark):
    assert timed(spark, "zero_crossing", [(0, -1.0), (1, 0.0), (2, 0.0), (3, 1.0)]) == 2
    assert timed(spark, "change_ratio", [(0, 5.0), (1, 5.0), (2, 5.0)]) == 1
    assert timed(spark, "change_count", [(0, 5.0), (1, None), (2, 6.0), (3, 7.0)]) == 1
    assert timed(spark, "integral", [(0, 1.0), (1, 3.0)]) == 2 * 86400


def test_skewness(spark):
    assert numbers(spark, "skewness", [1.0, 2.0, 9.0]) == pytest.approx(0.362235, abs=1e-6)
    assert numbers(spark, "skewness", [3.0, 3.0]) is None
    assert numbers(spark, "skewness", [3.0]) is None


def test_robust(spark):
    assert numbers(spark, "aggregate_robust", [4.0, 1.0], {"order": "ASC", "nth": 3}) == 4
    assert numbers(spark, "aggregate_robust", [4.0, 1.0], {"order": "DESC", "nth": 3}) == 1
    assert numbers(spark, "aggregate_robust", [4.0, 1.0, 7.0, None], {"order": "DESC", "nth": 2}) == 4


def test_undefined_is_null(spark):
    assert timed(spark, "correlation", [(0, 1.0), (1, 1.0)]) is None
    assert timed(spark, "slope", [(0, 1.0)]) is None
    assert numbers(spark, "geometric_mean", [-1.0, 0.0], slot="number") is None
    assert numbers(spark, "coefficient_of_variation", [1.0, -1.0]) is None


def test_means(spark):
    assert numbers(spark, "geometric_mean", [2.0, 8.0, -5.0], slot="number") == pytest.approx(4)
    assert numbers(spark, "harmonic_mean", [1.0, 0.5, 0.0]) == pytest.approx(2 / 3)
    assert numbers(spark, "mean_absolute_difference", [1.0, 3.0]) == 1
    assert numbers(spark, "entropy_continuous", [1.0, 1.0, -4.0]) == pytest.approx(math.log(2))
    assert numbers(spark, "product", [-2.0, 3.0]) == pytest.approx(-6)
    assert numbers(spark, "product", [-2.0, 0.0]) == 0


def test_counts_of_values(spark):
    rows = [(1, "p", v) for v in ("a", "a", "b", None)]
    of = lambda name: value(spark, name, rows, "id int, y string, v string", {"nominal": "v"})[1]
    assert of("mode") == "a"
    assert of("concentration") == pytest.approx(200 / 3)
    assert of("duplicate_ratio") == 0.5
    assert of("entropy") == pytest.approx(1.5 * math.log(2))
    assert of("distinct_count") == 2


def test_ratio(spark):
    rows = [(i, "p", a, b) for i, (a, b) in enumerate([(None, 1.0), (1.0, None), (1.0, 0.0), (0.0, 2.0), (1.0, 4.0)])]
    got = value(spark, "ratio", rows, "id int, y string, a double, b double", {"numerical1": "a", "numerical2": "b"})
    assert [got[i] for i in range(5)] == [None, None, None, 0, 25]


def test_zeros_and_decimals(spark):
    rows = [(i, "p", float(x)) for i, x in enumerate((0, 10, 500, 2000, 7))]
    got = value(spark, "zeros", rows, "id int, y string, x double", {"numerical": "x"})
    assert [got[i] for i in range(5)] == [0, 1, 2, 3, 0]
    rows = [(i, "p", x) for i, x in enumerate((2.5, 3.0, 1.25, -0.125))]
    got = value(spark, "decimals", rows, "id int, y string, x double", {"decimal": "x"})
    assert [got[i] for i in range(4)] == [1, 0, 2, 3]


def test_parts_of_times(spark):
    hours = (4, 5, 8, 9, 17, 18, 20, 21)
    rows = [(i, "p", dt.datetime(2024, 2, 1, h)) for i, h in enumerate(hours)]
    got = value(spark, "time_day_part", rows, "id int, y string, t timestamp_ntz", {"time": "t"})
    assert [got[i] for i in range(8)] == ["night", "morning", "morning", "working", "working", "evening", "evening", "night"]
    days = [dt.date(2024, 2, 10), dt.date(2024, 2, 29), dt.date(2024, 2, 1)]
    got = value(spark, "time_month_part", [(i, "p", d) for i, d in enumerate(days)], "id int, y string, d date", {"date": "d"})
    assert [got[i] for i in range(3)] == [2, 3, 1]
    days = [dt.date(2024, 3, d) for d in (1, 2, 3, 4)]  # Friday to Monday
    got = value(spark, "time_is_weekend", [(i, "p", d) for i, d in enumerate(days)], "id int, y string, d date", {"date": "d"})
    assert [got[i] for i in range(4)] == [0, 1, 1, 0]


def test_texts(spark):
    of = lambda name, *texts: [value(spark, name, [(i, "p", t) for i, t in enumerate(texts)], "id int, y string, s string", {"character": "s"}).get(i) for i in range(len(texts))]
    assert of("accented", "Žluť", "Zlut") == [1, 0]
    assert of("title_case", "Hello World", "hello World", "HeLlo", "Hello-World", None) == [1, 0, 0, 1, None]
    assert of("email_domain", "a@b.c", "none", None) == ["@b.c", None, None]
    assert of("ip_local", "10.1.1.1", "192.168.0.1", "172.99.0.1", "8.8.8.8") == [1, 1, 1, 0]


def test_booleans_are_numbers(spark):
    assert value(spark, "aggregate", [(1, "p", x) for x in (True, False, True)], "id int, y string, x boolean", {"numerical": "x"}, {"f": "avg"})[1] == pytest.approx(2 / 3)


def test_frequency_counts_peers_together(spark):
    d1, d2 = dt.datetime(2020, 1, 1, 5), dt.datetime(2020, 1, 2)
    rows = [(1, d1, "p", "a"), (2, d1, "p", "b"), (3, d2, "p", "a"), (4, d2, "p", None)]
    got = value(spark, "frequency", rows, "id int, d timestamp_ntz, y string, v string", {"nominal": "v"}, b=replace(B, date="d"))
    assert got == {1: 0.5, 2: 0.5, 3: pytest.approx(2 / 3)}


def test_segment_comparison(spark):
    rows = [(1, "p", "a", 1.0), (2, "p", "a", 3.0), (3, "p", "b", 5.0), (4, "p", None, 5.0)]
    got = value(spark, "segment_comparison", rows, "id int, y string, v string, x double", {"nominal": "v", "numerical": "x"})
    assert got == {1: pytest.approx(1 / 3), 2: 3, 3: None, 4: None}


def test_literals_with_quotes(spark):
    rows = [(1, "p", "it's \\ a"), (1, "p", "b")]
    assert value(spark, "existential_count", rows, "id int, y string, v string", {"nominal": "v"}, {"value": "it's \\ a"})[1] == 1


def test_empty_tables_give_empty_results(spark):
    for name in ("aggregate_robust", "woe", "entropy", "aggregate_nb", "integral"):
        p = PATTERNS[name]
        columns = {s: {"numerical": "x", "nominal": "v", "temporal": "t"}[s] for s in p.slots}
        params = {k: v[0] for k, v in p.params.items()}
        assert value(spark, name, [], "id int, y string, x double, v string, t timestamp_ntz", columns, params) == {}
