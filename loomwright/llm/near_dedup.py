"""Near-duplicate detection: MinHash bands propose, odd sketches judge, full sets confirm.

1. Every text becomes its set of hashed five-word shingles; equal word sequences share a
   128-bit fingerprint and are one node from here on, so that thousands of exact copies
   cost one.
2. 120 MinHash values a node give 24 bands of five. The same values, each with its number,
   are folded into a 512-bit parity bitmap, the odd sketch: the population count of two
   sketches' XOR estimates how many values differ. A second bitmap, sized by the set, holds
   the parity of all shingles: its XOR count never exceeds the number of shingles that
   differ, so that it proves pairs to be below the threshold.
3. Within a band's bucket, cut into blocks of bounded size, a forest of the pairs that the
   sketches find most similar is proposed, not all pairs; each row is in one block of a
   bucket. Proposed pairs are confirmed on full shingle sets, and components are built.
4. Blocks are joined through representatives: of each component in a bucket that still holds
   several, REPRESENTATIVES rows meet, and a forest between components is proposed.
5. What is left are pairs in a bucket whose ends are in different components. Rows outside a
   bucket's largest component meet all others, tile by tile: sketches first, then, for rows
   that these leave, parities, then, for rows that these leave, full sets. A tile gives out
   rows, then links that join components, never pairs: all links count and none is lost.

Misses: two texts at exactly 0.85 share no band with probability below 1e-6, two at exactly
0.80 with probability 7.3e-5; their sketches rule them out with probability below 1e-4 (MARGIN
standard deviations of the estimate at the threshold).

Defined results: null, empty and wordless texts have no shingles and are linked with
nothing; rows that share a doc_id share a component; a row without doc_id is linked with
nothing, has a null component_id and is kept; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import LOWER_AZ, Workspace, quoted, shuffle_width, small_batches
from .components import components

SHINGLE, BANDS, ROWS, SKETCH_BITS = 5, 24, 5, 512
PERCENT = 85  # op5's threshold: link where 100 * intersection >= percent * union
MOST_PARITY_BITS = 16384
BLOCK, BLOCK_SHINGLES = 512, 1 << 21  # nodes, and their shingles, in a block of a bucket
COMPARED_BYTES = 1 << 22  # of parities that are compared at once
REPRESENTATIVES = 4  # of a component in a bucket
HOT_BUCKET = 1024  # nodes from which a bucket's rows are dealt to many tasks
MARGIN = 4.0  # standard deviations by which an estimate may fall short of the threshold


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def text_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted set of 64-bit hashes of five-word shingles; a shorter text is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, np.uint64(min(len(h), SHINGLE)))
    for k, c in enumerate(_odd(SHINGLE, 1)[: len(h)]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * c
        out ^= out >> np.uint64(32)
    return np.unique(out)


def minhashes(x: np.ndarray) -> np.ndarray:
    """BANDS * ROWS values of a non-empty set."""
    a, b = _odd(BANDS * ROWS, 2)[:, None], _odd(BANDS * ROWS, 3)[:, None]
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 2048):
        np.minimum(out, ((x[None, at : at + 2048] ^ b) * a).min(1), out=out)
    return out


def odd_sketch(values: np.ndarray) -> bytes:
    """Parity of the (number, value) pairs that fall on each bit."""
    k = np.arange(len(values), dtype=np.uint64)
    h = (values ^ (k * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xA0761D6478BD642F)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return np.packbits(np.bincount((h >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def parity(x: np.ndarray) -> bytes:
    """Parity of all members of a set on 512 to MOST_PARITY_BITS bits, a power of two near twice the set's size."""
    bits = min(MOST_PARITY_BITS, max(SKETCH_BITS, 1 << (2 * len(x) - 1).bit_length()))
    at = (x >> np.uint64(20)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def fewest_differing(parities: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A lower bound of how many members differ between the sets of each pair, from their parities.

    The longer bitmap is folded onto the shorter one: XOR of its parts.
    """
    size = np.array([len(p) for p in parities])
    common = np.minimum(size[i], size[j])
    out = np.zeros(len(i), np.int64)
    for width in np.unique(common):
        rows = np.flatnonzero(size >= width)
        place = np.full(len(size), -1)
        place[rows] = np.arange(len(rows))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(parities[r], np.uint64).reshape(-1, width // 8), axis=0) for r in rows])
        mine = np.flatnonzero(common == width)
        step = max(1, COMPARED_BYTES // int(width))
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            out[some] = np.bitwise_count(folded[place[i[some]]] ^ folded[place[j[some]]]).sum(1)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
    for k in range(ROWS):
        out = (out ^ v[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
    return out.view(np.int64)


def fewest_agreeing(values: int = BANDS * ROWS, bits: int = SKETCH_BITS, percent: int = PERCENT, margin: float = MARGIN) -> float:
    """The most differing bits that two sketches at the threshold show, but for so many standard deviations."""
    j = percent / 100
    differing = 2 * values * (1 - j)
    seen = bits / 2 * (1 - (1 - 2 / bits) ** differing)
    by_values = 2 * math.sqrt(values * j * (1 - j)) * (1 - 2 / bits) ** differing
    return seen + margin * math.sqrt(by_values**2 + max(0.0, bits / 4 * (1 - (1 - 2 / bits) ** (2 * differing)) - differing * (1 - 2 / bits) ** (2 * differing)))


SIGNED = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("parity", T.BinaryType())])


def fingerprint(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


@F.pandas_udf(SIGNED)
def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            words = text_words(text or "")
            x = shingles(words)
            if len(x):
                v = minhashes(x)
                rows.append((fingerprint(words), len(x), band_keys(v), odd_sketch(v), parity(x)))
            else:
                rows.append((None, 0, None, None, None))
        yield pd.DataFrame(rows, columns=SIGNED.names)


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets agree in percent of their union."""
    both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(percent: int):
    @F.pandas_udf(T.BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([reaches(shingles(text_words(s)), shingles(text_words(t)), percent) for s, t in zip(a, b, strict=True)], dtype=bool)

    return linked


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits between each sketch of x and each of y, as 64-bit words."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Places of the pairs, taken in order, that form a forest over n nodes."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append(k)
            if len(kept) == n - 1:
                break
    return kept


def _near(t: dict, most: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group that size, sketch, label and, where present, parity don't rule out, as places.

    side is 0 for the group's first block and 1 for its second; with both present only
    pairs between them count, as each block is also a group of its own.
    """
    size, side = t["n_shingles"], t["side"]
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    across = len(x) > 0 and len(y) > 0
    if not across:
        x = y = np.arange(len(size))
    near = _apart(t["sketch"][x], t["sketch"][y]) <= most
    near &= 100 * np.minimum(size[x][:, None], size[y][None]) >= percent * np.maximum(size[x][:, None], size[y][None])
    if not across:
        near &= np.tri(len(x), k=-1, dtype=bool).T
    if "label" in t:
        near &= t["label"][x][:, None] != t["label"][y][None]
    i, j = np.nonzero(near)
    i, j = x[i], y[j]
    if len(i) and "parity" in t:
        # At the threshold t the sets differ in (1 - t) / (1 + t) of their sizes' sum.
        apart = fewest_differing(t["parity"], i, j)
        near = (100 + percent) * apart <= (100 - percent) * (size[i] + size[j])
        order = np.argsort(apart[near], kind="stable")
        i, j = i[near][order], j[near][order]
    return i, j


def _forest_pairs(t: dict, most: float, percent: int) -> list[tuple]:
    """A forest of the most similar pairs of a group, between its rows, or where they have labels between these; its group, and whether it leaves pairs out."""
    i, j = _near(t, most, percent)
    ends = t.get("label", np.arange(len(t["fp"])))
    kept = _forest(ends[i], ends[j], int(ends.max(initial=0)) + 1)
    pairs = {(min(p, q), max(p, q)) for p, q in ((t["fp"][i[k]], t["fp"][j[k]]) for k in kept)}
    return [(p, q, t["group"], int(len(kept) < len(i))) for p, q in sorted(pairs) if p != q]


def _left_open(t: dict, most: float, percent: int) -> list[tuple]:
    """The rows of a group that are in a pair which isn't ruled out."""
    group = t["group"]
    return [(group, t["fp"][k], int(t["side"][k])) for k in np.unique(np.concatenate(_near(t, most, percent)))]


def _links(t: dict, most: float, percent: int) -> list[tuple]:
    """Links of a group that join its labels, confirmed on full sets; pairs whose labels are joined already need no look."""
    root = list(range(int(t["label"].max(initial=0)) + 1))
    sets: dict[int, np.ndarray] = {}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    def members(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(text_words(t["_text"][k]))
        return sets[k]

    out = []
    for i, j in zip(*(x.tolist() for x in _near(t, most, percent)), strict=True):
        p, q = find(int(t["label"][i])), find(int(t["label"][j]))
        if p != q and reaches(members(i), members(j), percent):
            root[max(p, q)] = min(p, q)
            out.append((min(t["fp"][i], t["fp"][j]), max(t["fp"][i], t["fp"][j])))
    return out


PAIRS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
PROPOSED = T.StructType([*PAIRS.fields, T.StructField("group", T.LongType()), T.StructField("more", T.IntegerType())])
OPEN = T.StructType([T.StructField("group", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("side", T.IntegerType())])


def _by_group(rows: DataFrame, judge, schema: T.StructType, percent: int) -> DataFrame:
    """judge's rows for each group of rows (group, side, fp, n_shingles, sketch; perhaps label, parity, _text).

    A group has two blocks at most; it is gathered over Arrow batches, one group at a time.
    """
    most = fewest_agreeing(percent=percent)
    names, types = schema.names, [pa.int64() if f.dataType == T.LongType() else pa.int32() if f.dataType == T.IntegerType() else pa.binary() for f in schema.fields]

    def judged(tables: list[pa.Table]) -> pa.RecordBatch | None:
        t = pa.concat_tables(tables)
        fp, group = t["fp"].to_pylist(), t["group"].to_numpy()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(fp), -1)
        size, side = t["n_shingles"].to_numpy(), t["side"].to_numpy()
        more = {c: t[c].to_pylist() for c in ("label", "parity", "_text") if c in t.column_names}
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        out = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if e - s > 1:
                one = {"group": int(group[s]), "fp": fp[s:e], "sketch": sketch[s:e], "n_shingles": size[s:e], "side": side[s:e]} | {c: v[s:e] for c, v in more.items()}
                if "label" in one:
                    one["label"] = np.unique(np.array(one["label"], dtype="V16"), return_inverse=True)[1]
                out += judge(one, most, percent)
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            group = t["group"].to_numpy()
            # Rows of the last group may go on in the next batch.
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                if (out := judged([*rest, t.slice(0, cut)])) is not None:
                    yield out
                rest = []
            elif rest and rest[-1]["group"][-1].as_py() != group[0]:
                if (out := judged(rest)) is not None:
                    yield out
                rest = []
            rest.append(t.slice(cut))
        if rest and (out := judged(rest)) is not None:
            yield out
        rest.clear()
        pa.default_memory_pool().release_unused()  # workers wait for their next task with what they hold

    spread = rows.repartition(2 * shuffle_width(rows.sparkSession), "group").sortWithinPartitions("group")
    return spread.mapInArrow(run, schema)


def _salted(df: DataFrame, salts: str = "salts") -> DataFrame:
    """df with a row for each salt of its key."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(salts) - 1)))


def _buckets(nodes: DataFrame, work: Workspace) -> DataFrame:
    """(key, salt, salts, fp, blocks) of the buckets with more than one node.

    Counts are partial before they are shuffled. Rows of a large bucket have one of many
    salts, and its count has a row for each: their join is spread over tasks. Which keys are
    salted a Bloom filter tells, alike on both sides; a false hit costs no more than a spread.
    """
    spark = nodes.sparkSession
    keys = nodes.select(F.explode("bands").alias("key"), "fp", "n_shingles")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).filter(F.col("n") > 1)
    sizes = work.keep(sizes, "sizes")
    hot = sizes.filter(F.col("n") >= HOT_BUCKET).select("key")
    n_hot = hot.count()
    salts = F.lit(1)
    if n_hot:
        salts = F.when(bloom.possible(spark, bloom.build(hot, "key", n_hot))(F.col("key")), 2 * shuffle_width(spark)).otherwise(1)
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = _salted(sizes.select("key", F.least(blocks, F.col("n").cast("int")).alias("blocks"), salts.cast("int").alias("salts")))
    keys = keys.select("key", "fp").withColumn("salts", salts.cast("int")).withColumn("salt", F.pmod(F.xxhash64("fp", "key"), F.col("salts")).cast("int"))
    return keys.join(sizes.drop("salts"), ["key", "salt"])


def _block(blocks: Column) -> Column:
    """The block that a row of a bucket is in."""
    return F.pmod(F.xxhash64("fp", "key", F.lit("block")), F.greatest(blocks, F.lit(1))).cast("int")


_SHAPE = ("fp", "n_shingles", "sketch", "parity")


def _first_group() -> Column:
    return F.xxhash64("key", _block(F.col("blocks")))


def _first_pairs(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """A forest of likely pairs in each block of each bucket."""
    rows = buckets.select("fp", _first_group().alias("group"), F.lit(0).alias("side")).join(nodes.select(*_SHAPE), "fp")
    return _by_group(rows, _forest_pairs, PROPOSED, percent)


def _unsettled(buckets: DataFrame, proposed: DataFrame) -> DataFrame:
    """The buckets of several blocks, or with likely pairs that were not proposed: in all others every pair is ruled out or proposed."""
    more = proposed.filter("more = 1").select("group").distinct()
    one = buckets.filter("blocks = 1").withColumn("group", _first_group()).join(more, "group", "left_semi").drop("group")
    return buckets.filter("blocks > 1").unionByName(one)


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with their label and the bucket's counts: of labels, of rows of the largest and of the others."""
    named = buckets.join(labels, buckets["fp"] == labels["node"], "left").withColumn("label", F.coalesce("root", "fp")).drop("node", "root")
    each = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.max("salts").alias("salts"))
    stats = each.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("largest"), F.max("salts").alias("salts")).filter(F.col("labels") > 1)
    stats = stats.select("key", "labels", F.col("largest.label").alias("largest"), F.col("largest.n").alias("n_largest"), (F.col("all") - F.col("largest.n")).alias("n_others"), F.col("salts").alias("_salts"))
    return named.join(_salted(stats, "_salts").drop("_salts"), ["key", "salt"])


def _representative_pairs(mixed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """A forest of likely pairs between the components of each bucket, by a few rows of each."""
    place = F.row_number().over(Window.partitionBy("key", "label").orderBy(F.xxhash64("fp"), "fp"))
    few = mixed.withColumn("_k", place).filter(F.col("_k") <= REPRESENTATIVES)
    # Of one label all representatives are in one block.
    blocks = F.ceil(F.col("labels") * REPRESENTATIVES / BLOCK).cast("int")
    group = F.xxhash64("key", F.pmod(F.xxhash64("label", "key"), F.greatest(blocks, F.lit(1))))
    rows = few.select("fp", "label", group.alias("group"), F.lit(0).alias("side")).join(nodes.select(*_SHAPE), "fp")
    return _by_group(rows, _forest_pairs, PROPOSED, percent).select("a", "b").distinct()


def _last_links(mixed: DataFrame, nodes: DataFrame, docs: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """Confirmed links between the components that buckets still hold: none is missed.

    Rows of a bucket's largest component meet the others only, in tiles of one block of each.
    """
    # A block of a bucket has fewer shingles where texts are long: by the share that its rows are of the bucket's.
    share = F.col("blocks") / (F.col("n_largest") + F.col("n_others"))
    cut = lambda n: F.greatest(F.ceil(F.col(n) * share), F.lit(1)).cast("int")
    rows = mixed.withColumn("own", F.col("label") == F.col("largest")).withColumn("b_largest", cut("n_largest")).withColumn("b_others", cut("n_others"))
    rows = rows.withColumn("block", _block(F.when(F.col("own"), F.col("b_largest")).otherwise(F.col("b_others"))))
    one = lambda i, j, kind, side: F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("group"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_others = F.transform(upto("b_others"), lambda k: one(F.least(F.col("block"), k), F.greatest(F.col("block"), k), "others", F.when(F.col("block") > k, 1).otherwise(0)))
    with_largest = F.transform(upto("b_largest"), lambda k: one(k, F.col("block"), "largest", F.lit(1)))
    largest = F.transform(upto("b_others"), lambda k: one(F.col("block"), k, "largest", F.lit(0)))
    tiles = rows.select("fp", "label", F.explode(F.when(F.col("own"), largest).otherwise(F.concat(with_others, with_largest))).alias("x")).select("fp", "label", "x.group", "x.side")
    names = work.keep(mixed.select("fp", "label").distinct().join(nodes.select(*_SHAPE), "fp"), "names")
    open_ = work.keep(_by_group(tiles.join(names.select("fp", "n_shingles", "sketch"), "fp"), _left_open, OPEN, percent), "open")
    open_ = work.keep(_by_group(open_.join(names, "fp"), _left_open, OPEN, percent), "open-by-parity")
    texts = _texts(open_.select("fp").distinct(), nodes, docs)
    return _by_group(open_.join(names, "fp").join(texts, "fp"), _links, PAIRS, percent).distinct()


def _texts(fps: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, _text) of these nodes. Of the texts only theirs are shuffled, but for false hits of a Bloom filter."""
    ids = nodes.select("fp", "rep").join(fps, "fp", "left_semi")
    may = bloom.possible(docs.sparkSession, bloom.build(ids, "rep"))
    texts = docs.filter(may("_id")).join(ids.select("fp", F.col("rep").alias("_id")), "_id").select("fp", "_text")
    return texts.filter(_signed_fp("_text") == F.col("fp")).dropDuplicates(["fp"])


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    if pairs.isEmpty():
        return pairs
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), nodes, docs)
    out = pairs.join(texts.select(F.col("fp").alias("a"), F.col("_text").alias("_s")), "a").join(texts.select(F.col("fp").alias("b"), F.col("_text").alias("_t")), "b")
    return out.filter(_linked(percent)("_s", "_t")).select("a", "b")


@F.pandas_udf(T.BinaryType())
def _signed_fp(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: fingerprint(text_words(t)))


def _stars(labels: DataFrame) -> DataFrame:
    """Components as links, one a node: what joins them further needs no other link of those that made them."""
    return labels.select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: its id, n_shingles, component_id (the least id that links reach) and kept.

    Texts are linked whose shingle sets agree in percent of their union or more.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "near-dedup")
    docs = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"))
    signed = docs.select("_id", _signed("_text").alias("s")).select("_id", "s.*")
    signed = work.keep(signed, "signed")
    named = signed.filter(F.col("_id").isNotNull() & F.col("fp").isNotNull())
    nodes = named.groupBy("fp").agg(F.min("_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    nodes = work.keep(nodes, "nodes")
    # Two texts under one id are one document: link them.
    shared = named.select("_id", "fp").distinct().groupBy("_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter(F.col("a") != F.col("b"))
    shared = named.select("_id", "fp").distinct().join(shared.select("_id", "a"), "_id").filter(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    texts = docs.filter(F.col("_id").isNotNull() & F.col("_text").isNotNull())

    buckets = work.keep(_buckets(nodes, work), "buckets")
    # Nodes that share a bucket are few, and all that is looked at from here on.
    members = work.keep(nodes.select(*_SHAPE, "rep").join(buckets.select("fp").distinct(), "fp", "left_semi"), "members")
    proposed = work.keep(_first_pairs(buckets, members, percent), "proposed")
    pairs = work.keep(proposed.select("a", "b").distinct(), "pairs")
    links = work.keep(_confirmed(pairs, members, texts, percent).unionByName(shared), "links")
    labels = work.keep(components(links, work, "first"), "labels")
    unsettled = work.keep(_unsettled(buckets, proposed), "unsettled")
    mixed = work.keep(_mixed(unsettled, labels), "mixed")
    if not mixed.isEmpty():
        more = work.keep(_representative_pairs(mixed, members, percent).join(pairs, ["a", "b"], "left_anti"), "pairs-2")
        more = work.keep(_confirmed(more, members, texts, percent), "links-2")
        if not more.isEmpty():
            labels = work.keep(components(_stars(labels).unionByName(more), work, "second"), "labels-2")
            mixed = work.keep(_mixed(unsettled, labels), "mixed-2")
        last = work.keep(_last_links(mixed, members, texts, work, percent), "links-3")
        if not last.isEmpty():
            labels = work.keep(components(_stars(labels).unionByName(last), work, "third"), "labels-3")

    roots = nodes.select("fp", "rep").join(labels, nodes["fp"] == labels["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = work.keep(roots.join(least, "root").select("fp", "component_id"), "moved")
    work.drop("nodes", "sizes", "buckets", "members", "proposed", "unsettled", "pairs", "links", "labels", "mixed", "pairs-2", "links-2", "labels-2", "mixed-2", "open", "names", "open-by-parity", "links-3", "labels-3")
    out = signed.select("_id", "fp", "n_shingles").join(moved, "fp", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without near-duplicates but the one with the least id; columns as they were. Rows that repeat that id stay."""
    gone = near_duplicates(docs, id_col, text_col, percent).filter(~F.col("kept")).select(F.col(quoted(id_col)).alias("_gone")).distinct()
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row"), F.col(quoted(id_col)).alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
