"""Centroid clustering in exact integers, with Drake's adaptive bounds.

Components become integers, so that distances, means and ties are the same on any machine
and in any order. Each vector keeps its centroid, an upper bound of the distance to it, lower
bounds for the several next centroids, in order, and one lower bound for all the others.
Centroids that move loosen the bounds by as much; a vector is looked at again only if they
no longer certify that its centroid is strictly the nearest:

1. some bound is not above the upper one: the own distance is computed exactly, which tightens it;
2. the remainder is above it, a tracked one is not: own and tracked centroids are ordered anew;
3. the remainder is not above it: all centroids are.

The number of tracked bounds shrinks to what the last round needed (``LEAST_BOUNDS`` at
least). A round is one map over the written state, vectors and bounds side by side, so that
nothing is joined or shuffled but one partial sum for each task, centroid and component;
512 sums reach the driver for 8 centroids of 64 components. State is written to the shared
folder each round, which cuts the lineage: a lost executor costs its tasks of one round.

Defined results: vectors that are null, of another length, or hold a null or a component that
isn't finite are left out; rows that repeat an id are vectors of their own; a null id comes
last among the seeds, and equal seeds follow the order of their components; with fewer
vectors than centroids there are as many centroids as vectors, with none no rows; extra
columns are not read. A component beyond 2**62 in size counts as 2**62; a distance or sum
that a long can't hold is null (components up to 2**27 never give such a distance).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, quoted

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3:"
BOUNDS, LEAST_BOUNDS = 3, 2
#: Components up to here have squared distances over 64 of them that fit 63 bits; larger ones take Python's integers.
PLAIN, MOST = 1 << 27, 1 << 62
#: What rounding may add to a bound, relative to its size.
SLACK = 1e-12

STATE = "vec_id long, x binary, cluster int, upper double, lower binary, near binary, rest double, used int, n long, sums array<decimal(38,0)>"
RESULT = "vec_id long, cluster int, distance decimal(38,0)"


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, as 64-bit integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -float(MOST), float(MOST)).astype(np.int64)


def distances(x: np.ndarray, centroid: tuple[int, ...]) -> np.ndarray:
    """Exact squared distances; Python's integers where 64 bits may not hold them."""
    if max(map(abs, centroid), default=0) > PLAIN or (len(x) and np.abs(x).max() > PLAIN):
        return ((x.astype(object) - np.array(centroid, dtype=object)) ** 2).sum(1)
    apart = x - np.array(centroid, dtype=np.int64)
    return np.einsum("ij,ij->i", apart, apart)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _below(bound: np.ndarray, by: np.ndarray | float) -> np.ndarray:
    """A lower bound less so much; an infinite one stays."""
    some = np.where(np.isinf(bound), 0.0, bound)
    return np.where(np.isinf(bound), bound, some - by - SLACK * (np.abs(some) + by))


class Bounds:
    """A batch's centroids and bounds: cluster, upper, lower (rows x tracked), near (which those are), rest."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, near: np.ndarray, rest: np.ndarray):
        self.cluster, self.upper, self.lower, self.near, self.rest = cluster, upper, lower, near, rest

    @classmethod
    def none(cls, rows: int, tracked: int) -> Bounds:
        return cls(np.zeros(rows, np.int32), np.full(rows, np.inf), np.full((rows, tracked), -np.inf), np.zeros((rows, tracked), np.int32), np.full(rows, -np.inf))

    def loosen(self, moved: np.ndarray) -> None:
        """Centroids have moved so far: bounds give way by as much, and by what rounding may cost."""
        own, far = moved[self.cluster], moved.max(initial=0.0)
        self.upper = self.upper + own + SLACK * (self.upper + own)
        self.lower, self.rest = _below(self.lower, moved[self.near]), _below(self.rest, far)

    def track(self, tracked: int) -> None:
        """Fewer bounds: the last ones pass into the remainder."""
        if tracked < self.lower.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, tracked:].min(1))
            self.lower, self.near = self.lower[:, :tracked], self.near[:, :tracked]

    def settle(self, x: np.ndarray, centroids: list[tuple[int, ...]]) -> int:
        """The nearest centroid of each row, ties to the smaller number. Returns how many bounds were needed, at most, and one more if all were."""
        k, tracked = len(centroids), self.lower.shape[1]
        doubtful = np.flatnonzero(np.minimum(self.lower.min(1, initial=np.inf), self.rest) <= self.upper)
        if not len(doubtful):
            return 0
        known = doubtful[np.isfinite(self.upper[doubtful])]
        for c in np.unique(self.cluster[known]):
            rows = known[self.cluster[known] == c]
            self.upper[rows] = _root(distances(x[rows], centroids[c])) * (1 + SLACK)
        again = self.rest[doubtful] <= self.upper[doubtful]
        scan, some = doubtful[again], doubtful[~again]
        below = self.lower[some] <= self.upper[some, None]
        some, below = some[below.any(1)], below[below.any(1)]
        used = int((np.arange(1, tracked + 1) * below).max(initial=0))
        if len(some):
            # Candidates in ascending number, so that a stable order breaks ties as asked.
            which = np.sort(np.concatenate([self.cluster[some, None], self.near[some]], axis=1), axis=1)
            self._order(some, which, self._exact(x[some], centroids, which), k)
        if len(scan):
            used = tracked + 1
            which = np.broadcast_to(np.arange(k, dtype=np.int32), (len(scan), k))
            self._order(scan, which, self._exact(x[scan], centroids, which), k)
        return used

    @staticmethod
    def _exact(x: np.ndarray, centroids: list[tuple[int, ...]], which: np.ndarray) -> np.ndarray:
        each = [distances(x, c) for c in centroids] if which.shape[1] == len(centroids) else None
        if each is not None:
            return np.stack(each, axis=1)
        out = np.zeros(which.shape, dtype=object if max(abs(v) for c in centroids for v in c) > PLAIN or (len(x) and np.abs(x).max() > PLAIN) else np.int64)
        for c in np.unique(which):
            rows, at = np.nonzero(which == c)
            out[rows, at] = distances(x[rows], centroids[c])
        return out

    def _order(self, rows: np.ndarray, which: np.ndarray, squares: np.ndarray, k: int) -> None:
        """Own, tracked and perhaps remainder from exact distances, nearest first."""
        tracked = self.lower.shape[1]
        order = np.argsort(squares, axis=1, kind="stable")
        which, roots = np.take_along_axis(which, order, 1), _root(np.take_along_axis(squares, order, 1))
        self.cluster[rows], self.upper[rows] = which[:, 0], roots[:, 0] * (1 + SLACK)
        n = min(tracked, which.shape[1] - 1)
        self.near[rows, :n], self.lower[rows, :n] = which[:, 1 : 1 + n], roots[:, 1 : 1 + n] * (1 - SLACK)
        if which.shape[1] == k:
            self.lower[rows, n:] = np.inf
            self.rest[rows] = roots[:, 1 + n] * (1 - SLACK) if k > 1 + n else np.inf


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def _bounds(t: pa.RecordBatch, moved: np.ndarray, tracked: int) -> Bounds:
    rows, floats = t.num_rows, lambda c: t[c].to_numpy(zero_copy_only=False).copy()
    matrix = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(rows, -1).copy()
    b = Bounds(floats("cluster"), floats("upper"), matrix("lower", np.float64), matrix("near", np.int32), floats("rest"))
    b.loosen(moved)
    b.track(tracked)
    return b


def _binary(a: np.ndarray) -> pa.Array:
    wide = np.ascontiguousarray(a)
    return pa.array([r.tobytes() for r in wide], pa.binary())


def _round(centroids: list[tuple[int, ...]], moved: list[float] | None, tracked: int):
    """One round over state rows (or, first, over vectors): new state, and at a task's end its sums by centroid."""
    k, shape = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, used = [0] * k, [[0] * shape for _ in range(k)], 0
        for t in batches:
            if not t.num_rows:
                continue
            x = _vectors(t["x"])
            b = Bounds.none(len(x), tracked) if moved is None else _bounds(t, np.array(moved), tracked)
            used = max(used, b.settle(x, centroids))
            for c in np.unique(b.cluster).tolist():
                own = x[b.cluster == c]
                counts[c] += len(own)
                # Sums of 2**62 by 512 rows pass 64 bits.
                total = own.sum(0) if np.abs(own).max() <= PLAIN else own.astype(object).sum(0)
                sums[c] = [s + int(v) for s, v in zip(sums[c], total, strict=True)]
            none = lambda kind: pa.nulls(len(x), kind)
            yield pa.RecordBatch.from_arrays(
                [t["vec_id"], t["x"], pa.array(b.cluster, pa.int32()), pa.array(b.upper), _binary(b.lower), _binary(b.near), pa.array(b.rest), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.decimal128(38, 0)))],
                names=_NAMES,
            )
        some = [c for c in range(k) if counts[c]]
        if some:
            none = lambda kind: pa.nulls(len(some), kind)
            yield pa.RecordBatch.from_arrays(
                [none(pa.int64()), none(pa.binary()), pa.array(some, pa.int32()), none(pa.float64()), none(pa.binary()), none(pa.binary()), none(pa.float64()), pa.array([used] * len(some), pa.int32()), pa.array([counts[c] for c in some], pa.int64()),
                 pa.array([[Decimal(v) for v in sums[c]] for c in some], pa.list_(pa.decimal128(38, 0)))],
                names=_NAMES,
            )

    return run


_NAMES = [x.split()[0] for x in STATE.replace("decimal(38,0)", "decimal").split(", ")]


def _last(centroids: list[tuple[int, ...]], moved: list[float], tracked: int):
    """The assignment to the final centroids, with its exact squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            x = _vectors(t["x"])
            b = _bounds(t, np.array(moved), tracked)
            b.settle(x, centroids)
            far = [0] * len(x)
            for c in np.unique(b.cluster).tolist():
                rows = np.flatnonzero(b.cluster == c)
                for r, d in zip(rows.tolist(), distances(x[rows], centroids[c]).tolist(), strict=True):
                    far[r] = d
            yield pa.RecordBatch.from_arrays([t["vec_id"], pa.array(b.cluster, pa.int32()), pa.array([Decimal(d) if d < 10**38 else None for d in far], pa.decimal128(38, 0))], names=["vec_id", "cluster", "distance"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        v = np.asarray(t["v"].flatten(), dtype=np.float64).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays([t["vec_id"], _binary(whole(v))], names=["vec_id", "x"])


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """(vec_id, x): the vectors that take part, as 64-bit integers one after the other."""
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    fits = F.col("v").isNotNull() & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(fits, F.lit(False))).mapInArrow(_whole, "vec_id long, x binary")


def _seeds(vectors: DataFrame, clusters: int, seed: str) -> list[tuple[int, ...]]:
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = vectors.select("vec_id", "x", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    return [tuple(np.frombuffer(r["x"], np.int64).tolist()) for r in first]


def _moves(old: list[tuple[int, ...]], new: list[tuple[int, ...]]) -> list[float]:
    """How far each centroid has moved, rounded up."""
    return [math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) * (1 + SLACK) for p, q in zip(old, new, strict=True)]


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, bounds: int = BOUNDS, seed: str = SEED) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(vec_id, cluster, distance) of each vector after so many rounds, and the final centroids."""
    spark = df.sparkSession
    work = Workspace(spark, "clustering")
    vectors = kept_vectors(df, id_col, vector_col, dimensions)
    centroids = _seeds(vectors, clusters, seed)
    if not centroids:
        return spark.createDataFrame([], RESULT), []
    tracked, moved, state = min(bounds, len(centroids) - 1), None, vectors
    for k in range(rounds):
        whole_state = work.keep(state.mapInArrow(_round(centroids, moved, tracked), STATE), f"round-{k}")
        if k:
            work.drop(f"round-{k - 1}")
        state = whole_state.filter("n IS NULL")
        sums = whole_state.filter("n IS NOT NULL").select("cluster", "n", "used", F.posexplode("sums").alias("at", "s"))
        got = sums.groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("used").alias("used")).collect()
        means = {(r["cluster"], r["at"]): int(r["s"]) // r["n"] for r in got}
        new = [tuple(means.get((c, i), v) for i, v in enumerate(old)) for c, old in enumerate(centroids)]
        moved, centroids = _moves(centroids, new), new
        tracked = min(tracked, max(LEAST_BOUNDS, max((r["used"] for r in got), default=0)))
        if not any(moved):
            break
    out = work.keep(state.mapInArrow(_last(centroids, moved, tracked), RESULT), "result")
    work.drop(f"round-{k}")
    return out, centroids


def digest(centroid: tuple[int, ...]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(df: DataFrame, **more) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    rows, centroids = cluster(df, **more)
    sums = {r["cluster"]: int(r["s"]) if r["s"] is not None else None for r in rows.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), F.try_sum("distance")).alias("s")).collect()}
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    total = fits(sum(sums.values())) if None not in sums.values() else None
    own, name = F.lit(None).cast("long"), F.lit(None).cast("string")
    for c, centroid in enumerate(centroids):  # a branch for each centroid
        own = F.when(F.col("cluster") == c, F.lit(fits(sums.get(c))).cast("long")).otherwise(own)
        name = F.when(F.col("cluster") == c, F.lit(digest(centroid))).otherwise(name)
    long = F.when(F.col("distance") <= F.lit((1 << 63) - 1), F.col("distance")).cast("long")
    return rows.select("vec_id", "cluster", long.alias("distance"), own.alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), name.alias("centroid_sha256"))
