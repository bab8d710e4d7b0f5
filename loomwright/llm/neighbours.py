"""Approximate nearest neighbours by largest inner product over additively quantised vectors.

Equal vectors are one entry with its least ids (one more than the neighbours asked for, as a
query's own id may be among them), so that thousands of copies neither crowd the candidates
nor meet in one task. Directions are encoded with additive codebooks fitted on a bounded
sample (SAMPLE); norms are stored, and how far each vector lies from its code. Every query
meets every entry's code in blocks: a group is one block of entries and one of queries, scored
by lookup tables. The RERANK best estimates of a query, shared out over the blocks, are scored
exactly, in double precision on the original vectors, and so is every other entry whose distance
from its code leaves room for a larger product than the nearest found so far: whatever
the rows are like, none of the nearest is lost to its code. Work grows with queries times entries,
and entries are shuffled once for each block of queries, queries once for each block of entries.

Defined results: vectors that are null, zero, hold a null or a number that isn't finite, or
have another length than most, take no part, nor do rows without an id; where rows repeat an
id, the greatest of its vectors (as arrays) stands for it; ties go to the smaller id; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import additive
from .common import Workspace, quoted, shuffle_width

SAMPLE = 16384  # vectors that the codebooks are fitted on
CODEBOOKS, WORDS, BEAM = 24, 256, 4
RERANK = 512  # candidates of a query that are scored exactly
#: Entries and queries of a group at most, and components that either's vectors have; queries fill the tasks there are before their blocks are larger than FEW_QUERIES.
ENTRY_BLOCK, QUERY_BLOCK, COMPONENTS, FEW_QUERIES = 65536, 32768, 1 << 22, 512
SCORED_AT_ONCE = 64  # queries whose lookup tables are held at a time

NEAR = T.StructType([T.StructField("query", T.LongType()), T.StructField("entry", T.LongType()), T.StructField("score", T.DoubleType())])


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, one for each id."""
    ok = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).alias("vector")).filter(F.col("id").isNotNull() & ok)
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    d = lengths[0]["n"] if lengths else 0
    return rows.filter(F.size("vector") == d).groupBy("id").agg(F.max("vector").alias("vector"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors that aren't zero, without squares that overflow."""
    most = np.abs(x).max(1)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def _blocks(entries: int, queries: int, components: int, tasks: int) -> tuple[int, int]:
    """How many blocks of entries and of queries there are. Each block of entries gives rows for every query, so that these are as few as memory lets them be."""
    most = max(1, COMPONENTS // max(1, components))
    b = -(-entries // min(ENTRY_BLOCK, most))
    return b, max(1, -(-queries // min(QUERY_BLOCK, most)), min(-(-queries // FEW_QUERIES), -(-tasks // b)))


def _least(scores: np.ndarray, k: int) -> float:
    """The k-th largest; no bar where there are fewer."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf


def nearest_in(x: np.ndarray, codes: np.ndarray, norm: np.ndarray, error: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, rerank: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its k nearest rows of x, ties to the first, and their products.

    error is how far a row may lie from its code. A row is passed over only where its estimate and
    |query| * error together stay below k products that were computed; a bar that isn't a number passes none over.
    """
    n, d = x.shape
    # Lookup tables hold 32-bit floats: each of the sums has this error at most, in terms of the query's length and the row's.
    rounding = (len(books) + 8) * 2.0**-22 * (1 + np.linalg.norm(books, axis=2).max(1).sum())
    exactness = (d + 4) * 2.0**-52
    largest = norm.max()
    relative, room = (norm / largest).astype(np.float32), ((error + rounding * norm) / largest).astype(np.float32)
    keep, out = min(rerank, n), []
    for at in range(0, len(queries), SCORED_AT_ONCE):
        some = queries[at : at + SCORED_AT_ONCE]
        length = _lengths(some)
        s = additive.scores(additive.tables(some / length[:, None], books).astype(np.float32), codes, relative)
        if keep < n:
            first = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            bars = [_least(x[f] @ v - exactness * m * norm[f], k) / m / largest for f, v, m in zip(first, some, length, strict=True)]
            s += room
            near = [np.flatnonzero(~(row < np.nextafter(np.float32(bar), np.float32(-np.inf)))) for row, bar in zip(s, bars, strict=True)]
        else:
            near = [np.arange(n)] * len(some)
        # Where many rows are left it is faster to multiply all than to pick them.
        every = some @ x.T if sum(map(len, near)) > len(some) * n // 8 else None
        for i, (v, m, rows) in enumerate(zip(some, length, near, strict=True)):
            product = x[rows] @ v if every is None else every[i][rows]
            slack = exactness * m * norm[rows]
            rows = rows[~(product + slack < _least(product - slack, k))]
            exact = np.cumsum(x[rows] * v, axis=1)[:, -1] + 0.0  # in the order of the components
            best = np.lexsort((rows, -exact, ~np.isnan(exact)))[:k]
            out.append((rows[best], exact[best]))
    return out


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by query_every, its k nearest other rows: query_id, rank, id, score."""
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "neighbours")
    rows = work.keep(valid(vectors, id_col, vector_col), "rows")
    # row_number() <= n limits each map task's rows of a vector before they are shuffled.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    least = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    entries = least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("entry", F.element_at("ids", 1))
    entries = work.keep(entries, "entries")
    n = entries.count()
    sample = entries.select("vector").orderBy(F.xxhash64("vector", F.lit("sample")), "vector").limit(SAMPLE).toPandas()
    if not n:
        empty = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())])
        return spark.createDataFrame([], empty)
    unit = _matrix(sample["vector"])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    books = additive.train(unit, CODEBOOKS, WORDS)
    shared = spark.sparkContext.broadcast(books)  # CODEBOOKS * WORDS vectors at most

    def encoded(batches):
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["vector"])
                norm = _lengths(x)
                unit = x / norm[:, None]
                codes = additive.encode(unit, shared.value, BEAM)
                error = np.linalg.norm(unit - additive.decode(codes, shared.value), axis=1) * norm
                yield pdf.assign(codes=[c.tobytes() for c in codes], norm=norm, error=error)

    more = [T.StructField("codes", T.BinaryType()), T.StructField("norm", T.DoubleType()), T.StructField("error", T.DoubleType())]
    coded = work.keep(entries.mapInPandas(encoded, T.StructType([*entries.schema.fields, *more])), "coded")
    work.drop("entries")
    queries = rows.filter(F.col("id") % query_every == 0)
    asked = queries.join(coded.select("vector", F.col("entry").alias("query")), "vector").select("id", "query", "vector")
    asked = work.keep(asked, "asked")
    work.drop("rows")
    kinds = work.keep(asked.groupBy("query").agg(F.first("vector").alias("vector")), "kinds")
    blocks, query_blocks = _blocks(n, kinds.count(), unit.shape[1], shuffle_width(spark))

    # Entries are dealt to blocks by hash: of a query's RERANK best this many at most are in one block, but for six standard deviations.
    in_block = min(RERANK, math.ceil(RERANK / blocks + 6 * math.sqrt(RERANK / blocks)) + 8)

    def nearest(key, some, asking):
        if not len(some) or not len(asking):
            return pd.DataFrame({"query": [], "entry": [], "score": []}).astype({"query": "int64", "entry": "int64", "score": "float64"})
        some = some.sort_values("entry")
        codes = np.frombuffer(b"".join(some["codes"]), np.uint8).reshape(len(some), -1)
        norm, error = some["norm"].to_numpy(np.float64), some["error"].to_numpy(np.float64)
        got = nearest_in(_matrix(some["vector"]), codes, norm, error, _matrix(asking["vector"]), shared.value, k + 1, in_block)
        entry, sizes = some["entry"].to_numpy(), [len(rows) for rows, _ in got]
        return pd.DataFrame({"query": np.repeat(asking["query"].to_numpy(), sizes), "entry": entry[np.concatenate([r for r, _ in got])], "score": np.concatenate([p for _, p in got])})

    left = coded.drop("ids").withColumn("b", F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = kinds.withColumn("q", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(nearest, NEAR)
    top = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    near = near.withColumn("at", top).filter(F.col("at") <= k + 1).drop("at")

    exact = near.join(coded.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("found"))
    by_score = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found"))
    exact = exact.withColumn("at", by_score).filter(F.col("at") <= k + 1).drop("at")
    # A query's own id is one of k + 1 at most.
    out = asked.select(F.col("id").alias("query_id"), "query").join(exact, "query").filter(F.col("found") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "found"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(id_col), "score")
