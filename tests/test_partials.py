"""Percentiles by stretches and windows by cells, against plain computations."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from loomwright.functions import PATTERNS, Binding
from loomwright.plans.expand import sweep
from loomwright.plans.fuse import fused, single

SHARES = (0.0, 0.05, 0.31, 0.5, 0.95, 1.0)


def percentiles(b, shares=SHARES):
    from loomwright.functions import Quantile

    return [(f"p{k}", Quantile(b.number("numerical"), p)) for k, p in enumerate(shares)]


def test_percentiles_are_exact(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        draw = rng.choice([lambda: rng.gauss(0, 1e3), lambda: float(rng.randint(-3, 3)), lambda: rng.lognormvariate(0, 6), lambda: 1e9 + rng.random()])
        rows += [(i, "p", rng.choice([draw(), draw(), draw(), None])) for _ in range(rng.randint(1, 40))]
    rows += [(99, "p", None), (100, "p", -0.0), (100, "p", 0.0), (101, "p", math.inf), (101, "p", math.inf), (101, "p", 1.0)]
    df = spark.createDataFrame(rows, "id int, y string, x double")
    b = Binding(("id",), {"numerical": "x"}, target="y")
    got = {r["id"]: r for r in fused(df, b, percentiles(b)).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, r in got.items():
        xs = [x for k, _, x in rows if k == i and x is not None]
        for k, p in enumerate(SHARES):
            if not xs:
                assert r[f"p{k}"] is None
            elif i != 101:
                assert r[f"p{k}"] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12, abs=1e-12)
        assert r["y"] == "p"
    assert got[101]["p0"] == 1.0 and got[101]["p5"] == math.inf


def test_percentiles_equal_the_built_in_with_nan_largest(spark):
    rows = [(1, x) for x in (math.nan, 1.0, -2.0, 5.0)] + [(2, math.nan)]
    df = spark.createDataFrame(rows, "id int, x double")
    b = Binding(("id",), {"numerical": "x"})
    got = {r["id"]: r["value"] for r in single(df, b, PATTERNS["percentile"].build(Binding(("id",), {"numerical": "x"}, {"p": 0.5}))).collect()}
    assert got[1] == 3.0 and math.isnan(got[2])
    assert single(df.limit(0), b, PATTERNS["percentile"].build(Binding(("id",), {"numerical": "x"}, {"p": 0.5}))).count() == 0


def test_a_base_row_of_most_rows_is_no_single_task(spark):
    """One base row of a million values: no task past the counts sorts more than a few times what others do."""
    df = spark.range(1_000_000).selectExpr("CAST(1 AS INT) id", "CAST(id * 7919 % 1000003 AS DOUBLE) x")
    b = Binding(("id",), {"numerical": "x"})
    out = fused(df, b, percentiles(b, (0.05, 0.5, 0.95)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
    r = out.collect()[0]
    want = np.quantile(np.array([i * 7919 % 1000003 for i in range(1_000_000)]), (0.05, 0.5, 0.95))
    assert [r["p0"], r["p1"], r["p2"]] == pytest.approx(list(want))


def test_windows_match_rows(spark):
    rng = random.Random(5)
    day = dt.date(2024, 1, 1)
    rows = [(i, "p", day, rng.choice([rng.gauss(1e7, 3), rng.gauss(0, 5), None]), rng.choice([day - dt.timedelta(days=rng.randint(-5, 260)), None])) for i in range(40) for _ in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "id int, y string, b date, x double, d date")
    b = Binding(("id",), {"numerical": "x", "date": "d"}, date="b", target="y")
    pattern = PATTERNS["aggregate_frame"]
    variants = [{"f": f, **point} for f in pattern.params["f"] for point in sweep(pattern)]
    assert len(variants) == 80
    parts = [(f"v{k}", pattern.build(Binding(b.ids, b.columns, v, date="b", target="y"))) for k, v in enumerate(variants)]
    wide = fused(df, b, parts)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "Join" not in plan  # one set of partial sums
    got = {r["id"]: r for r in wide.collect()}
    plain = {"avg": np.mean, "sum": np.sum, "min": min, "max": max, "stddev_samp": lambda xs: np.std(xs, ddof=1) if len(xs) > 1 else None}
    seen = 0
    for k, v in enumerate(variants):
        alone = {r["id"]: r["value"] for r in single(df, b, parts[k][1]).collect()} if k % 9 == 0 else None
        for i in got:
            inside = [x for j, _, at, x, d in rows if j == i and d is not None and v["lead_fraction"] * v["lag"] + 1e-9 < (at - d).days < v["lag"]]
            xs = [x for x in inside if x is not None]
            want = plain[v["f"]](xs) if xs else None
            seen += want is not None
            assert got[i][f"v{k}"] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-6))
            if alone is not None:
                # Alone a window has fewer cells: sums may differ in their last digit.
                assert (i in alone) == bool(inside) and (alone.get(i) is None) == (want is None)
                assert want is None or alone[i] == pytest.approx(want, rel=1e-9, abs=1e-6)
    assert seen > 1000
