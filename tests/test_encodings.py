"""Sparse naive Bayes and running shares against plain Python."""

import datetime as dt
import math
import random
from collections import Counter

import pytest

from loomwright.functions import PATTERNS, target
from loomwright.functions.registry import Binding

B = Binding(("id",), {"nominal": "v"}, target="t", target_value="x")


def likelihoods(rows, all_values):
    joint, size = Counter((v, t) for _, v, t in rows if t is not None), Counter(t for _, _, t in rows if t is not None)
    return lambda v, t: math.log((1 + joint[v, t]) / (size[t] + len(all_values))), size


def plain_direct(rows):
    lik, size = likelihoods(rows, {v for _, v, _ in rows})
    known, total = {v for _, v, t in rows if t is not None}, sum(size.values())
    post = lambda v: math.exp(lik(v, "x")) * size["x"] / sum(math.exp(lik(v, t)) * size[t] for t in size)
    assert total
    return {i: post(v) for i, v, _ in rows if v in known}


def plain_aggregate(rows):
    known = {v for _, v, t in rows if t is not None}
    lik, size = likelihoods(rows, known)
    ids = {t: len({i for i, _, u in rows if u == t}) for t in size}
    total = len({i for i, _, t in rows if t is not None})
    out = {}
    for i in {i for i, _, _ in rows}:
        own = [v for j, v, _ in rows if j == i and v in known]
        if own:
            scores = {t: math.log(ids[t] / total) + sum(lik(v, t) for v in own) for t in size}
            top = max(scores.values())
            out[i] = math.exp(scores["x"] - top) / sum(math.exp(x - top) for x in scores.values())
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    of = {i: draw.choice(["x", "y", "z", "w", None]) for i in range(40)}
    return [(i, draw.choice(["a", "b", "c", "d", None, f"own{i}"]), of[i]) for i in (draw.randrange(40) for _ in range(300))]


@pytest.mark.parametrize("most", [10_000, 0, 2])
@pytest.mark.parametrize("name", ["direct_nb", "aggregate_nb"])
def test_naive_bayes_equals_the_whole_grid(spark, rows, name, most, monkeypatch):
    monkeypatch.setattr(target, "MOST_CLASSES", most)
    if name == "direct_nb":  # a row for each id
        rows = [(k, v, t) for k, (_, v, t) in enumerate(rows)]
    got = PATTERNS[name].build(B).make(spark.createDataFrame(rows, "id int, v string, t string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = (plain_direct if name == "direct_nb" else plain_aggregate)(rows)
    values = [(r["id"], r["value"]) for r in got.collect()]
    assert {i for i, _ in values} == set(want)
    assert all(v == pytest.approx(want[i], rel=1e-9) for i, v in values)


@pytest.mark.parametrize("name", ["direct_nb", "aggregate_nb"])
def test_many_values_and_classes_meet_only_where_seen(spark, name):
    """10**5 values and 10**4 classes would be 10**9 pairs."""
    df = spark.range(200_000).selectExpr("CAST(id % 70000 AS INT) AS id", "concat('v', id % 100000) AS v", "CASE WHEN id % 70000 % 10007 = 0 THEN 'x' ELSE concat('t', id % 70000 % 10007) END AS t")
    got = PATTERNS[name].build(B).make(df).selectExpr("count(*) AS n", "min(value) AS low", "max(value) AS high").first()
    assert got["n"] == (200_000 if name == "direct_nb" else 70_000) and 0 < got["low"] <= got["high"] < 1


def test_long_histories_do_not_overflow(spark):
    """A base row of many values: exponents far beyond what a double holds."""
    rows = [(i, f"v{k % 5}", "x" if i % 2 else "y") for i in range(6) for k in range(2000)]
    got = {r["id"]: r["value"] for r in PATTERNS["aggregate_nb"].build(B).make(spark.createDataFrame(rows, "id int, v string, t string")).collect()}
    want = plain_aggregate(rows)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_running_share_of_a_value_with_half_of_all_rows(spark):
    """Exact times, one value in half of all rows: sums run within an hour, and then over hours."""
    start = dt.datetime(1969, 12, 30, 23, 59)
    draw = random.Random(9)
    rows = [(k, start + dt.timedelta(seconds=draw.randrange(300_000) + draw.choice([0, 0.5])), "hot" if k % 2 else draw.choice(["a", "b", None])) for k in range(3000)]
    b = Binding(("id",), {"nominal": "v"}, date="d")
    got = PATTERNS["frequency"].build(b).make(spark.createDataFrame(rows, "id int, d timestamp_ntz, v string"))
    some = sorted((d, v, k) for k, d, v in rows if v is not None)
    want, all_, own = {}, 0, Counter()
    at = 0
    while at < len(some):
        end = at
        while end < len(some) and some[end][0] == some[at][0]:
            own[some[end][1]] += 1
            end += 1
        all_ = end
        want |= {k: own[v] / all_ for _, v, k in some[at:end]}
        at = end
    assert {r["id"]: r["value"] for r in got.collect()} == pytest.approx(want)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("_h#") and "windowspecdefinition(_v#" in plan
