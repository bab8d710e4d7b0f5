"""Clustering against brute force in integers, and SQL."""

import hashlib
import math

import numpy as np
import pytest

from loomwright.llm import clustering, oracle, queries

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>"


def brute(rows, clusters=8, rounds=10, dimensions=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centroids = [v for _, _, v in named[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, centroids, strict=True)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), centroids


def got(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(4)
    v = draw.normal(size=(6, 64))[draw.integers(0, 6, 400)] + draw.normal(size=(400, 64)) * 0.4
    few = [(k, x) for k, x in enumerate(v.round(1).tolist())]
    bad = [(900, None), (901, [1.0] * 63), (902, []), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")]), (905, [float("inf")] * 64)]
    return few + [(k + 400, x) for k, x in few[:150]] + [few[0], few[0], (None, few[3][1])] + bad


def test_query_matches_sql(spark, duck, same):
    same(queries.QUERIES["op12_centroid_clustering"](spark, FOLDER).toPandas(), duck.execute(oracle.CLUSTERED).df())


@pytest.mark.parametrize("more", [{}, {"bounds": 1}, {"bounds": 7}, {"clusters": 30, "bounds": 6, "rounds": 4}])
def test_equals_brute_force(spark, rows, more):
    out, centroids = clustering.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), **more)
    expected, means = brute(rows, more.get("clusters", 8), more.get("rounds", 10))
    assert [list(c) for c in centroids] == means
    assert got(out) == expected


def test_sums_and_digests(spark, rows):
    out = clustering.clustered(spark.createDataFrame(rows, VECTORS)).toPandas()
    expected, means = brute(rows)
    assert out.inertia.unique().tolist() == [sum(d for _, _, d in expected)]
    for c, own in out.groupby("cluster"):
        assert own.cluster_inertia.unique().tolist() == [own.distance.sum()]
        assert own.centroid_sha256.unique().tolist() == [hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()]


def test_few_or_no_vectors_and_clashing_columns(spark, clashing):
    few = [(5, [0.5] * 64), (6, [0.25] * 64), (5, [0.5] * 64)]
    df = clashing(spark.createDataFrame(few, VECTORS))
    assert got(clustering.cluster(df)[0]) == brute(few)[0]
    assert clustering.clustered(spark.createDataFrame([(1, None)], VECTORS)).count() == 0
    assert clustering.clustered(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components_are_exact_and_the_largest_give_null(spark):
    large = [(k, [(-1.0) ** k * 2.0**20 * (k % 5)] + [float(k)] * 63) for k in range(40)]
    assert got(clustering.cluster(spark.createDataFrame(large, VECTORS))[0]) == brute(large)[0]
    out = clustering.clustered(spark.createDataFrame([*large, *((50 + k, [1e300] * 64) for k in range(9)), (70, [-1e300] * 64)], VECTORS), clusters=1).collect()
    assert len(out) == 50 and any(r["distance"] is None for r in out)


def test_bounds_certify_or_look_again():
    """Whatever way the centroids move, settling with bounds gives what a scan gives, and looks at fewer."""
    draw = np.random.default_rng(5)
    x = draw.integers(-300, 300, (3000, 16))
    centroids = [tuple(map(int, c)) for c in draw.integers(-200, 200, (20, 16))]
    b, needs = clustering.Bounds.none(len(x), 5), []
    for step in range(12):
        needs.append(b.settle(x, centroids))
        squares = np.stack([clustering.distances(x, c) for c in centroids], axis=1)
        assert (b.cluster == squares.argmin(1)).all()
        roots = np.sqrt(squares.astype(float))
        assert (b.upper >= roots[np.arange(len(x)), b.cluster]).all()
        assert (b.lower <= np.take_along_axis(roots, b.near, 1)).all()
        others = np.ones(squares.shape, bool)
        np.put_along_axis(others, b.near, False, 1)
        others[np.arange(len(x)), b.cluster] = False
        assert (b.rest <= np.where(others, roots, np.inf).min(1)).all()
        new = [tuple(int(v) + int(draw.integers(-2, 3)) * (step % 3 == 0) for v in c) for c in centroids]
        b.loosen(np.array(clustering._moves(centroids, new)))
        centroids = new
        if step == 6:
            b.track(3)
    assert needs[0] == 6 and needs[2] == 0
