"""Toxicity of texts whose words may be obfuscated.

1. Letter trigrams are counted over all texts: the character model of the noisy channel.
2. On a bounded sample of labelled rows (SAMPLE ids, none held out, one text of each)
   obfuscated words are restored and counted by label; each gets the lower bound of its log odds as a weight.
   Then beginnings of words are counted and weighted likewise, but for words that have a
   weight of their own, whose beginnings would else speak against harmless words.
3. A logistic fit on a text's strongest weights, each taken from the half of the sample that
   the text is not in, gives the score.
4. Every whole text is restored and scored.

Defined results: a null or empty text has no words and gets the score of a text without
toxic words; without labels of both kinds every score is 0; an id that is labelled twice
counts as clean if either label says so; rows without doc_id are scored and not held out; rows are scored one by one; labels, lang, source and doc_id are no inputs
of a score, and extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import deobfuscate as noisy
from .common import Workspace, small_batches
from .training import held_out, logistic, sampled_ids, sigmoid, texts_of

SAMPLE = 20_000  # labelled rows that weights are learnt from
BUCKETS = 1 << 20  # of hashed words and beginnings
SHORTEST, LONGEST = 3, 8  # letters of a beginning
LEAST_TEXTS = 4  # toxic texts that a word must occur in
CACHE, LONGEST_CACHED = 400_000, 200  # words, and beginnings, whose weight a worker remembers, and words' characters at most
THRESHOLD = 0.3

COUNTED = T.StructType([T.StructField(c, T.LongType()) for c in ("half", "bucket", "toxic", "clean")])
TRIGRAMS = T.StructType([T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])


def _count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(noisy.SIZE**3, np.int64)
    for pdf in batches:
        at, n = noisy.trigrams([t for t in pdf.iloc[:, 0] if t])
        total[at] += n
    at = np.flatnonzero(total)
    yield pd.DataFrame({"at": at, "n": total[at]})


def character_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """Costs of letters after two others, from the trigrams of all texts. At most SIZE ** 3 counts reach the driver."""
    got = docs.select(text_col).mapInPandas(_count_trigrams, TRIGRAMS).groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(noisy.SIZE**3, np.int64)
    counts[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return noisy.model(counts)


class Reader:
    """From a text to the buckets of its restored words, or to its strongest weights."""

    def __init__(self, costs: np.ndarray, words: dict[int, float] | None = None, starts: dict[int, float] | None = None):
        self.costs, self.by_word, self.by_start, self.known = costs.tolist(), words or {}, starts or {}, {}
        self.hashed: dict[str, int] = {}  # buckets of beginnings
        self.best: dict[str, float] = {}  # greatest weights of beginnings and their own beginnings

    def restored(self, token: str) -> list[str]:
        """The words behind a token that have SHORTEST letters or more."""
        return [w for w in noisy.readings(token, self.costs) if len(w) >= SHORTEST]

    def whole(self, word: str) -> int:
        return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass") + b"$") % BUCKETS

    def start(self, text: str) -> int:
        """The bucket of a beginning, hashed once for all words that have it."""
        if (got := self.hashed.get(text)) is None:
            got = xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) % BUCKETS
            _remember(self.hashed, text, got)
        return got

    def starts(self, word: str) -> list[int]:
        """Buckets of a word's beginnings, none if the word has a weight of its own."""
        if self.whole(word) in self.by_word:
            return []
        known = self.hashed.get
        return [b if (b := known(word[:n])) is not None else self.start(word[:n]) for n in range(SHORTEST, min(LONGEST, len(word)) + 1)]

    def best_start(self, text: str) -> float:
        """The greatest weight of the beginnings of LONGEST letters or fewer, found once for all words that have them."""
        if (got := self.best.get(text)) is None:
            got = self.by_start.get(xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) % BUCKETS, 0.0)
            if len(text) > SHORTEST:
                got = max(got, self.best_start(text[:-1]))
            _remember(self.best, text, got)
        return got

    def _of(self, token: str, make) -> object:
        if (got := self.known.get(token)) is None:
            got = make(token)
            if len(token) <= LONGEST_CACHED:
                _remember(self.known, token, got)
        return got

    def seen_words(self, text: str | None) -> set[int]:
        own = lambda token: tuple([self.whole(w) for w in self.restored(token)])
        return self._buckets(text, own)

    def seen_starts(self, text: str | None) -> set[int]:
        own = lambda token: tuple([b for w in self.restored(token) for b in self.starts(w)])
        return self._buckets(text, own)

    def _buckets(self, text: str | None, own) -> set[int]:
        """What own gives for each token: tuples, since the collector walks remembered lists again and again."""
        known = self.known.get
        return set().union(*(got if (got := known(t)) is not None else self._of(t, own) for t in noisy.tokens(text or "")))

    def weight(self, token: str) -> float:
        most = 0.0
        for w in self.restored(token):
            if (own := self.by_word.get(self.whole(w))) is None and (own := self.best.get(w[:LONGEST])) is None:
                own = self.best_start(w[:LONGEST])
            if own > most:
                most = own
        return most

    def strongest(self, text: str | None) -> tuple[float, float, float, float]:
        """The greatest weight of a word, the sum of the three greatest, how many have one, and how many words there are."""
        words, known, weight = noisy.tokens(text or ""), self.known.get, self.weight
        top = sorted((x for w in words if (x := known(w)) or x is None and (x := self._of(w, weight))), reverse=True)
        return (top[0] if top else 0.0), sum(top[:3]), len(top), len(words)


def _remember(known: dict, key: str, value: object) -> None:
    if len(known) > CACHE:
        known.clear()
    known[key] = value


def weights_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[int, float]:
    """Buckets whose log odds are above 1 even at their lower bound (two standard errors)."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    low = odds - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5) * (clean > 0))
    at = np.flatnonzero((toxic >= LEAST_TEXTS) & (low > 1.0))
    return dict(zip(at.tolist(), low[at].tolist(), strict=True))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    costs = character_model(docs, text_col)
    shared = spark.sparkContext.broadcast(costs)
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(id_col, F.col(label_col).cast("int").alias("_label"))
    ids = sampled_ids(known, id_col, SAMPLE, "_label")
    half = F.pmod(F.xxhash64("_key", F.lit("half")), F.lit(2)).cast("long")
    work = Workspace(spark, "toxicity")
    sample = work.keep(texts_of(docs, ids, id_col, text_col).select("_text", "_label", half.alias("_half")), "sample")

    def counts(which: str, words: dict[int, float]) -> np.ndarray:
        """Texts of each half and label that have each bucket; the last place holds all texts."""
        strong = spark.sparkContext.broadcast(words)

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader, total = Reader(shared.value, strong.value), np.zeros((2, BUCKETS + 1, 2), np.int32)
            for pdf in batches:
                for text, label, h in zip(pdf["_text"], pdf["_label"], pdf["_half"], strict=True):
                    total[h, np.fromiter(getattr(reader, which)(text), np.int64), label] += 1
                    total[h, BUCKETS, label] += 1
            for h in range(2):
                at = np.flatnonzero(total[h].any(1))
                yield pd.DataFrame({"half": h, "bucket": at, "toxic": total[h, at, 1], "clean": total[h, at, 0]})

        per = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in range(2) for c in ("clean", "toxic")]
        got = sample.mapInPandas(counted, COUNTED).groupBy("bucket").agg(*per)
        # A word in fewer toxic texts of both halves together has no weight in either.
        got = got.filter((F.col("toxic0") + F.col("toxic1") >= LEAST_TEXTS) | (F.col("bucket") == BUCKETS)).toPandas()
        out = np.zeros((2, BUCKETS + 1, 2), np.int64)
        for h in range(2):
            for label, c in enumerate(("clean", "toxic")):
                out[h, got["bucket"], label] = got[f"{c}{h}"]
        return out

    def learnt(t: np.ndarray) -> dict[int, float]:
        return weights_of(t[:BUCKETS, 1], t[:BUCKETS, 0], int(t[BUCKETS, 1]), int(t[BUCKETS, 0]))

    by_word = counts("seen_words", {})
    if not by_word[:, BUCKETS].sum(0).all():
        work.drop("sample")
        return docs.select(id_col, held_out(id_col).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    strong = learnt(by_word.sum(0))
    by_start = counts("seen_starts", strong)
    halves = spark.sparkContext.broadcast([(learnt(by_word[1 - h]), learnt(by_start[1 - h])) for h in range(2)])
    whole = spark.sparkContext.broadcast((strong, learnt(by_start.sum(0))))

    def strongest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [Reader(shared.value, *w) for w in halves.value]
        for pdf in batches:
            top = [readers[h].strongest(text) for text, h in zip(pdf["_text"], pdf["_half"], strict=True)]
            yield pd.DataFrame(top, columns=["a", "b", "c", "d"]).assign(y=pdf["_label"].to_numpy())

    fit = sample.mapInPandas(strongest, "a double, b double, c double, d double, y int").toPandas()
    work.drop("sample")
    fit = fit.sort_values(list(fit.columns))  # rows arrive in any order: sorted, they give the same fit each time
    w = logistic(_inputs(fit[["a", "b", "c", "d"]].to_numpy()), fit["y"].to_numpy(np.float64))

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value, *whole.value)
        for texts in batches:
            top = np.array([reader.strongest(t) for t in texts]).reshape(-1, 4)
            yield pd.Series(sigmoid(_inputs(top) @ w[:-1] + w[-1]))

    out = docs.select(F.col(id_col).alias("_id"), scored(text_col).alias("score"))
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _inputs(top: np.ndarray) -> np.ndarray:
    any_, size = top[:, 0] > 0, np.log1p(top[:, 3])
    return np.column_stack([top[:, :2], np.log1p(top[:, 2]), any_, any_ * size, size])
