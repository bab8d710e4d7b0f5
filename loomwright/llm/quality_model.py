"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1 that aren't held out; the rest of what it
learns from is unlabelled text. Both are bounded samples (SAMPLE rows each). The class prior
is estimated from the two, and a linear model over counts of a whole text minimises the
non-negative unbiased risk.

Defined results: a null or empty text has all its counts at zero and is scored as such; with
no trusted positives every score is 0; rows without doc_id are scored and not held out;
labels, lang, source and doc_id are no inputs of a score, and extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .positive_unlabelled import class_prior, fit
from .training import held_out, sampled_ids, sigmoid, texts_of

SAMPLE = 20_000  # trusted positives, and unlabelled texts, that are learnt from
THRESHOLD = 0.7
USUAL, CLIP = 4.0, 6.0  # standard deviations within which a feature says nothing, and beyond which no more

NAMES = ("symbols", "pipes", "capitals", "digits", "marks", "bangs", "word_length", "long_words", "kinds", "commonest", "pairs", "same_lines", "short_lines", "odd_ends", "short")
_SYMBOLS, _MARKS = np.zeros(256), np.zeros(256)
_SYMBOLS[list(b"#*$%&|<>{}[]\\^~=_@+")] = 1
_MARKS[list(b".,;:?!")] = 1
_PER_BYTE = np.stack([_SYMBOLS, np.eye(256)[ord("|")], _MARKS, np.eye(256)[ord("!")], np.isin(np.arange(256), list(b"0123456789")), (np.arange(256) & 0xC0) != 0x80], axis=1).astype(np.float64)


def features(text: str | None) -> list[float]:
    """Counts of a whole text, as shares of its characters, words or lines."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    symbols, pipes, marks, bangs, digits, chars = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256) @ _PER_BYTE
    n = len(words)
    kinds = Counter(words)
    pairs = n - 1 - len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, chars - n)
    capitals = sum(map(str.isupper, words))
    enough, some = min(1.0, n / 100), min(1.0, n / 40)  # repeats, and a few numbers, say little in a short text
    odd = sum(not (w[-1].isalnum() or w[-1] in ".,;:?!'\")") for w in words)
    return [
        symbols / letters, pipes / n, capitals / n, some * digits / letters, some * marks / n, bangs / n,
        letters / n, sum(len(w) > 18 for w in words) / n, enough * max(0.0, 1 - len(kinds) / n**0.9), enough * max(kinds.values()) / n, enough * pairs / n,
        enough * (1 - len(set(lines)) / len(lines)), some * sum(len(x) < 30 for x in lines) / len(lines), odd / n, 1.0 if n < 12 else 0.0,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts], dtype=object)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    trusted = sampled_ids(labels.filter((F.col(label_col) == 1) & ~held_out(id_col)), id_col, SAMPLE)
    any_ids = sampled_ids(docs.select(F.col(id_col).alias("_id")).join(F.broadcast(trusted), F.col("_id") == F.col("_key"), "left_anti"), "_id", SAMPLE)

    def matrix(ids: DataFrame) -> np.ndarray:
        got = texts_of(docs, ids, id_col, text_col).select(_features("_text").alias("x")).toPandas()["x"]
        return np.array(got.to_list(), dtype=np.float64).reshape(-1, len(NAMES))

    positive, unlabelled = matrix(trusted), matrix(any_ids)
    if not len(positive):
        return docs.select(id_col, held_out(id_col).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    # Rows arrive in any order: sorted, they give the same fit each time.
    positive, unlabelled = (x[np.lexsort(x.T)] for x in (positive, unlabelled))
    mean, spread = positive.mean(0), positive.std(0) + 0.02 * (np.abs(positive).mean(0) + 0.05)

    def scaled(x: np.ndarray) -> np.ndarray:
        """How far each feature is above, and below, what is usual among trusted positives."""
        z = (x - mean) / spread
        return np.column_stack([np.clip(z - USUAL, 0, CLIP), np.clip(-z - USUAL, 0, CLIP)])

    rng = np.random.default_rng(3)
    p, u = scaled(positive)[rng.permutation(len(positive))], scaled(unlabelled)[rng.permutation(len(unlabelled))]
    w = fit(p, u, class_prior(p, u)) if len(u) else np.r_[np.zeros(2 * len(NAMES)), 2.0]

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts]).reshape(-1, len(NAMES))
        return pd.Series(sigmoid(scaled(x) @ w[:-1] + w[-1]))

    out = docs.select(F.col(id_col).alias("_id"), scored(text_col).alias("score"))
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
