"""A blocked Bloom filter over 64-bit hashes, built by all tasks and of bounded size.

A key sets one bit in each of eight 32-bit words of one 256-bit block, so that a probe
touches one cache line. The filter never exceeds MOST_BLOCKS blocks (16 MB): more keys only
raise the share of false hits, which an exact join behind the filter removes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BLOCKS = 1 << 19
KEYS_IN_BLOCK = 16
#: Odd multipliers, one for each word of a block.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)

WORDS = [f"w{k}" for k in range(8)]
BLOCK = T.StructType([T.StructField("block", T.LongType())] + [T.StructField(w, T.LongType()) for w in WORDS])


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's block, and its bit in each word of the block."""
    h = hashes if hashes.dtype == np.uint64 else hashes.astype(np.int64).view(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    low = h & np.uint64(0xFFFFFFFF)
    return block, np.uint64(1) << (((low[:, None] * SALTS) & np.uint64(0xFFFFFFFF)) >> np.uint64(27))


def hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, bit = places(hashes, len(bits))
    return ((bits[block] & bit) == bit).all(1)


def _filler(blocks: int) -> Callable:
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None
        for pdf in batches:
            if len(pdf):
                bits = np.zeros((blocks, 8), np.uint64) if bits is None else bits
                block, bit = places(pdf["h"].to_numpy(), blocks)
                for k in range(8):
                    np.bitwise_or.at(bits[:, k], block, bit[:, k])
        if bits is not None:
            full = np.flatnonzero(bits.any(1))
            yield pd.DataFrame({"block": full} | {w: bits[full, k].view(np.int64) for k, w in enumerate(WORDS)})

    return fill


def build(keys: DataFrame, key: str, count: int | None = None, hashed: bool = False) -> np.ndarray:
    """The filter of a column's distinct values, or of hashes as they are: an array of blocks, eight words each."""
    n = keys.count() if count is None else count
    blocks = 1 << max(3, min(MOST_BLOCKS, -(-max(n, 1) // KEYS_IN_BLOCK)).bit_length())
    blocks = min(blocks, MOST_BLOCKS)
    part = keys.select((F.col(key) if hashed else F.xxhash64(key)).alias("h")).mapInPandas(_filler(blocks), BLOCK)
    out = np.zeros((blocks, 8), np.uint64)
    got = part.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in WORDS)).toPandas()
    if len(got):
        out[got["block"].to_numpy()] = got[WORDS].to_numpy(np.int64).view(np.uint64)
    return out


def possible(spark, bits: np.ndarray) -> Callable[[Column], Column]:
    """From a column to a Boolean column: false where the value is certainly not in the filter."""
    shared = spark.sparkContext.broadcast(bits.astype(np.uint32))

    @F.pandas_udf(T.BooleanType())
    def hit(h: pd.Series) -> pd.Series:
        return pd.Series(hits(shared.value, h.to_numpy(np.int64)))

    return lambda c: hit(F.xxhash64(c))
