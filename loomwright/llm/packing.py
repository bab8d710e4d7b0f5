"""Packing sequences of near lengths: optimal length buckets, then batches by token budget.

A text longer than the longest sequence is cut into pieces of that length and a rest: no
token is dropped. The histogram of piece lengths over all texts (at most ``longest`` rows)
goes to the driver, where dynamic programming picks the bucket boundaries with the least
padding. In a bucket with boundary B a batch holds budget // B sequences padded to B;
sequences are shuffled by hash, and positions run over the whole bucket, so that only its
last batch may be short.

Defined results: null and wordless texts have no tokens and give one row with no bucket, no
batch and length 0; rows that repeat an id are pieces of their own; extra columns are not
read. Positions follow (hash, id, piece, length), so that rows alike in these may only change
places with each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, quoted, words
from .prefix import place_of, running_start, slice_of, slices_for

LONGEST, BUCKETS, BUDGET = 2048, 16, 65536


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The bucket boundaries, ascending, that give the least padding; the last is the greatest length."""
    lengths = np.array(sorted(k for k, v in histogram.items() if k > 0 and v > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.float64)
    n = len(lengths)
    rows, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    # cost[j] after k buckets: least padding of the j shortest lengths.
    cost = np.r_[0.0, np.full(n, np.inf)]
    back = []
    for _ in range(min(buckets, n)):
        new, came = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            pad = cost[:j] + (rows[j] - rows[:j]) * lengths[j - 1] - (tokens[j] - tokens[:j])
            came[j] = int(np.argmin(pad))
            new[j] = pad[came[j]]
        back.append(came)
        cost = new
    out, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(came[j])
    return out[::-1]


def pieces(docs: DataFrame, id_col: str, length: Column, longest: int) -> DataFrame:
    df = docs.select(F.col(quoted(id_col)).alias("_id"), length.cast("long").alias("_all"))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_all") / longest) - 1, F.lit(0).cast("long"))))
    return df.select("_id", "_all", cut.alias("piece")).select("_id", "piece", F.least(F.lit(longest).cast("long"), F.col("_all") - F.col("piece") * longest).alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row for each piece: id, piece, n_tokens, bucket (its boundary), batch, slot (place in the batch)."""
    work = Workspace(docs.sparkSession, "packing")
    length = F.size(words(F.col(quoted(text_col)))) if length is None else length
    rows = work.keep(pieces(docs, id_col, length, longest), "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    edges = boundaries(histogram, buckets)
    empty = rows.filter("n_tokens = 0").select("_id", "piece", "n_tokens", *(F.lit(None).cast("long").alias(c) for c in ("bucket", "batch", "slot")))
    out = empty
    if edges:
        some = rows.filter("n_tokens > 0").withColumn("bucket", F.expr(f"element_at(filter(array({','.join(f'{e}L' for e in edges)}), e -> e >= n_tokens), 1)"))
        some = some.withColumn("_place", place_of(F.col("_id"), F.concat(F.lit(":pack:"), F.col("piece").cast("string"))))
        some = running_start(some, ["bucket"], ["_place", "_id", "piece", "n_tokens"], slice_of("_place", slices_for(sum(histogram.values()))), F.lit(1), "_rank")
        hold = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")))
        some = some.withColumn("_hold", hold)
        out = some.select("_id", "piece", "n_tokens", "bucket", F.floor(F.col("_rank") / F.col("_hold")).alias("batch"), (F.col("_rank") % F.col("_hold")).alias("slot")).unionByName(empty)
    return out.select(F.col("_id").alias(id_col), "piece", "n_tokens", "bucket", "batch", "slot")
