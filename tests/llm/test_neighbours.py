import math

import numpy as np
import pytest
from loomwright.llm import additive, neighbours

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for a in np.flatnonzero(ids % every == 0):
        s = x @ x[a]
        s[a] = -np.inf
        out[int(ids[a])] = [int(ids[b]) for b in np.lexsort((ids, -s))[:k] if s[b] > -np.inf]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall_on_many(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32)) * rng.uniform(0.5, 2, (4000, 1))
    rows = [(k, v.astype(float).tolist()) for k, v in enumerate(x)]
    got, want = found(neighbours.search(spark.createDataFrame(rows, SCHEMA))), exact(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.97


def test_recall_where_few_of_the_vectors_are_scored_exactly(spark):
    """RERANK is less than a twentieth of the table here: the codes decide what is found."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(11_000, 16)) * rng.uniform(0.5, 2, (11_000, 1))
    assert neighbours.RERANK < len(x) / 20
    rows = [(k, v.astype(float).tolist()) for k, v in enumerate(x)]
    got, want = found(neighbours.search(spark.createDataFrame(rows, SCHEMA), query_every=100)), exact(rows, 20, 100)
    assert got.keys() == want.keys() and np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.95


def test_nothing_is_lost_to_the_codes_of_long_vectors(spark, monkeypatch):
    """Codes say little of these: their errors are larger than what sets the nearest apart."""
    monkeypatch.setattr(neighbours, "CODEBOOKS", 3)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 256)) * np.exp(rng.normal(size=(3000, 1)) / 4)
    rows = [(k, v.astype(float).tolist()) for k, v in enumerate(x)]
    got, want = found(neighbours.search(spark.createDataFrame(rows, SCHEMA), query_every=50)), exact(rows, 20, 50)
    assert got == want


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e150])
def test_nothing_is_lost_in_a_block(scale):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 24)) * np.exp(2 * rng.normal(size=(2500, 1))) * scale
    norm = neighbours._lengths(x)
    unit = x / norm[:, None]
    books = additive.train(unit[:300], 2, 16)
    codes = additive.encode(unit, books, 2)
    error = np.linalg.norm(unit - additive.decode(codes, books), axis=1) * norm
    for (rows, scores), q in zip(neighbours.nearest_in(x, codes, norm, error, x[:100], books, 11, 30), x, strict=False):
        s = np.cumsum(x * q, axis=1)[:, -1]
        want = np.lexsort((np.arange(len(x)), -s))[:11]
        assert rows.tolist() == want.tolist() and scores.tolist() == s[want].tolist()


def test_very_long_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(60, 3000)))]
    got, want = found(neighbours.search(spark.createDataFrame(rows, SCHEMA), k=5)), exact(rows, 5, 20)
    assert got == want


def test_ties_copies_and_few_rows(spark):
    rows = [(k, [1.0, 0.0]) for k in range(60)] + [(60, [0.0, 1.0]), (61, [2.0, 1.0])]
    got = found(neighbours.search(spark.createDataFrame(rows, SCHEMA), k=5))
    assert got[0] == [61, 1, 2, 3, 4] and got[20] == [61, 0, 1, 2, 3] and got[60] == [61, 0, 1, 2, 3]
    few = found(neighbours.search(spark.createDataFrame(rows[:3], SCHEMA)))
    assert few == {0: [1, 2]}


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ENTRY_BLOCK", 100)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(900, 16)))]
    got, want = found(neighbours.search(spark.createDataFrame(rows, SCHEMA))), exact(rows, 20, 20)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.95


def test_hard_rows(spark, clashing):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [math.inf, 1.0]), (100, [None, 1.0]), (120, [1.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [-1.0, 0.0]), (None, [9.0, 9.0])]
    got = neighbours.search(clashing(spark.createDataFrame(rows, SCHEMA)))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 5.0), (0, 2, 2, -1.0)]
    assert neighbours.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_additive_codes_reconstruct():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    books = additive.train(x, m=8, k=64)
    codes = additive.encode(x, books, beam=4)
    error = ((x - additive.decode(codes, books)) ** 2).sum(1).mean() / (x**2).sum(1).mean()
    assert error < 0.15
    q = rng.normal(size=(5, 16))
    s = additive.scores(additive.tables(q, books).astype(np.float32), codes, np.ones(len(codes), np.float32))
    assert s == pytest.approx(q @ additive.decode(codes, books).T, abs=1e-3)
