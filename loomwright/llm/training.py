"""What the text classifiers share: the fold rule, bounded samples and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str | Column) -> Column:
    """Whether a row's label may not be learnt: crc32 of its id as text, mod 4, is 2. A row without an id isn't held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sampled_ids(rows: DataFrame, id_col: str, n: int, *more: str) -> DataFrame:
    """n different ids (all, if fewer) with the least of each further column, by hash of the id: only ids are sorted, never texts.

    Rows of one id are counted together before they are shuffled, so that an id of many rows is one.
    """
    ids = rows.select(F.col(id_col).alias("_key"), *more).filter(F.col("_key").isNotNull()).groupBy("_key").agg(*([F.min(c).alias(c) for c in more] or [F.count("*").alias("_n")]))
    return ids.select("_key", *more).orderBy(F.xxhash64("_key", F.lit("sample")), "_key").limit(n)


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_key, _text and what more ids holds): one text for each id of a bounded sample, found by a broadcast of the ids alone.

    Of the texts under one id the one with the least hash stands for it; each task keeps one of
    an id before anything is shuffled, so that no more rows come out than there are ids.
    """
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids.select("_key")), F.col("_id") == F.col("_key"))
    one = found.groupBy("_key").agg(F.min(F.struct(F.xxhash64("_text"), "_text")).alias("_t")).select("_key", "_t._text")
    return one.join(F.broadcast(ids), "_key")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50, around: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton's method.

    The last weight is for the constant, which is added, unless ``around`` is given: weights,
    one for each column of x, that the ridge draws towards. weight: how much each row counts.
    """
    if around is None:
        x = np.column_stack([x, np.ones(len(x))])
        w, centre, penalty = np.zeros(x.shape[1]), 0.0, np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
    else:
        w, centre, penalty = around.copy(), around, np.full(x.shape[1], ridge)
    counts = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (counts * (p - y)) + penalty * (w - centre)
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step * min(1.0, 5.0 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
