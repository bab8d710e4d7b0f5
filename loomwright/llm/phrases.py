"""Phrase mining by pivot partitioning, as in MG-FSM: each n-gram is counted where its rarest word is.

1. Words are counted in each language. A table of fixed size holds the sums of counts by hash
   of (language, word); it goes to all tasks. A sum is never less than a word's count: a word
   whose sum is below the threshold is in no frequent phrase.
2. Words are ordered by that sum, then by hash: the last in this order is the rarest. Around each
   occurrence of a word, the pivot, as many words as a phrase may hold are kept to the left and to
   the right, up to the first rarer word, infrequent word or end of the piece. An n-gram's owner is the
   leftmost occurrence of its rarest word: so left of a pivot it stands itself for a rarer word.
3. These fragments, equal ones counted once, go to their pivot's bucket, many in one row. There
   phrases grow from the pivot, to the left and then to the right, as long as they are frequent:
   n-grams that another word owns are never made.
4. A pivot with many occurrences has one of several salts for each fragment; its phrases are
   summed over salts and only then held against the threshold.
5. Counts of a phrase's parts, which are frequent too, are joined to it; scores are decimals
   of 38 digits.

Every phrase is counted exactly: hashes only decide where, and where they agree the owner is
the leftmost word all the same.

Defined results: null and empty texts have no words; a null language is ``und``; rows that
repeat an id count as texts of their own; an empty table gives no rows; ids and extra columns
are not read. A product of 1000, a count and a total must fit 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, Workspace, quoted, shuffle_width, small_batches

LONGEST, LEAST, TOP = 5, 100, 2000
#: The word table has 2**TABLE_BITS sums.
TABLE_BITS = 22
#: Bytes of text whose fragments are made together, and of fragments that are mined together.
CHUNK_BYTES, MINE_BYTES = 2 << 20, 4 << 20
#: Bytes of fragments in a row at most, bytes that a task holds before it gives rows out, and buckets of pivots for each partition.
ROW_BYTES, HELD_BYTES, BUCKETS = 1 << 16, 16 << 20, 4
#: Distinct words that a task counts before it gives them out.
MOST_COUNTED = 400_000
#: Occurrences of a pivot for each of its salts.
HOT_PIVOT = 200_000
#: Languages up to this number are broadcast with their totals.
MOST_LANGUAGES = 10_000
#: Slices of a language's phrases whose best are ranked together.
SLICES = 64
#: A-Z become a-z, ends of pieces become line feeds and tabs become spaces: no byte of another character is one of these.
PLAIN = bytes(10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else LOWER_AZ[b] for b in range(256))
#: floor(1000 a n / (l r)) for counts whose products pass 64 bits.
SCORE = "(CAST(1000 AS DECIMAL(38,0)) * a * n) DIV (CAST(l AS DECIMAL(38,0)) * r)"
#: Marks the pivot of a fragment; no word holds it.
MARK = b"\x0b"


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\n" + word)


def _count(bits: int):
    """(lang, text) to (lang, word, slot, n), counted within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                words, n, name = list(own), list(own.values()), lang.encode()
                for at in range(0, len(words), 1 << 15):
                    some = words[at : at + (1 << 15)]
                    slots = [word_hash(name, w) & ((1 << bits) - 1) for w in some]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array(slots, pa.int32()), pa.array(n[at : at + (1 << 15)], pa.int64())], names=["lang", "word", "slot", "n"])
            counts.clear()

        for t in batches:
            for lang, text in zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.translate(PLAIN).split())
            if sum(map(len, counts.values())) > MOST_COUNTED:
                yield from given()
        yield from given()

    return run


def fragments(lang: bytes, texts: list[bytes], table: np.ndarray, least: int, longest: int, hot: int, buckets: int) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """The fragments in these texts: their pivots' buckets, whether these are salted, and the fragments, one a line, each after its count."""
    tokens: list[bytes] = []
    ends: list[int] = []
    for text in texts:
        for piece in text.translate(PLAIN).split(b"\n"):
            tokens += piece.split()
            ends.append(len(tokens))
    if not tokens:
        return None
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words = coded.dictionary
    hashes = np.array([word_hash(lang, w) for w in words.to_pylist()], np.uint64)
    sums = table[(hashes & np.uint64(len(table) - 1)).astype(np.int64)].astype(np.int64)
    blank = len(words)
    rarity = np.empty(len(words), np.int64)
    rarity[np.lexsort((hashes, -sums))] = np.arange(len(words))
    rarity[sums < least] = blank
    # Words in their order, a blank after each piece and some at both ends.
    reach = longest - 1
    index = coded.indices.to_numpy().astype(np.int64)
    lengths = np.diff(np.r_[0, ends])
    at = np.arange(len(index)) + np.repeat(np.arange(len(ends)), lengths) + reach
    of = np.full(len(index) + len(ends) + 2 * reach, blank, np.int64)
    rank = np.full(len(of), blank, np.int64)
    of[at], rank[at] = index, rarity[index]
    pivots = np.flatnonzero(rank < blank)
    own = rank[pivots]
    left, right = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    for j in range(1, longest):
        left += (left == j - 1) & (rank[pivots - j] < own)
        right += (right == j - 1) & (rank[pivots + j] <= own)
    some = left + right > 0
    pivots, left, right = pivots[some], left[some], right[some]
    if not len(pivots):
        return None
    length = left + right + 1
    starts = np.r_[0, np.cumsum(length)]
    place = np.arange(starts[-1]) + np.repeat(pivots - left - starts[:-1], length)
    chosen = of[place]
    chosen[starts[:-1] + left] += blank
    marked = pa.concat_arrays([words, pa.array([MARK + w for w in words.to_pylist()], pa.binary())])
    texts_ = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), marked.take(pa.array(chosen))), b" ").dictionary_encode()
    codes = texts_.indices.to_numpy()
    first = np.empty(len(texts_.dictionary), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    lines = pc.binary_join_element_wise(pa.array(np.bincount(codes)).cast(pa.string()).cast(pa.binary()), texts_.dictionary, b" ")
    pivot = of[pivots[first]]
    salts = np.maximum(1, -(-sums[pivot] // hot)).astype(np.uint64)
    salt = np.arange(len(pivot), dtype=np.uint64) % salts
    bucket = ((hashes[pivot] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
    salted = salts > 1
    order = np.lexsort((bucket, salted))
    bucket, salted, lines = bucket[order], salted[order], lines.take(pa.array(order))
    row = np.cumsum(pc.binary_length(lines).to_numpy().astype(np.int64) + 1) // ROW_BYTES
    cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (salted[1:] != salted[:-1]) | (row[1:] != row[:-1]), True])
    return bucket[cuts[:-1]], salted[cuts[:-1]], pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), lines), b"\n")


ROUTED = "bucket long, lang string, salted boolean, lines binary"


def _route(table, least: int, longest: int, hot: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        rows: dict[tuple[str, int, bool], list[bytes]] = {}
        size = held = 0

        def gather() -> int:
            """Adds the waiting texts' fragments to what is held of their buckets."""
            more = 0
            for lang, texts in waiting.items():
                if (out := fragments(lang.encode(), texts, table.value, least, longest, hot, buckets)) is not None:
                    for bucket, salted, lines in zip(out[0].tolist(), out[1].tolist(), out[2].to_pylist(), strict=True):
                        own = rows.setdefault((lang, bucket, salted), [b""])
                        if len(own[-1]) + len(lines) <= ROW_BYTES:
                            own[-1] = own[-1] + b"\n" + lines if own[-1] else lines
                        else:
                            own.append(lines)
                        more += len(lines)
            waiting.clear()
            return more

        def given() -> Iterator[pa.RecordBatch]:
            flat = [(bucket, lang, salted, lines) for (lang, bucket, salted), own in rows.items() for lines in own if lines]
            for at in range(0, len(flat), 256):
                columns = zip(*flat[at : at + 256], strict=True)
                kinds = (pa.int64(), pa.string(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "lang", "salted", "lines"])
            rows.clear()

        for t in batches:
            for lang, text in zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    held, size = held + gather(), 0
                if held >= HELD_BYTES:
                    yield from given()
                    held = 0
        gather()
        yield from given()

    return run


def grown(lines: pa.Array, least: int, longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases of two words and more that the fragments' pivots own, with their counts: those with so many at least."""
    fragment = pc.list_flatten(pc.split_pattern(lines, b"\n"))
    split = pc.split_pattern(fragment, b" ")
    starts = split.offsets.to_numpy().astype(np.int64)
    flat = pc.list_flatten(split)
    starts -= starts[0]
    weight = flat.take(pa.array(starts[:-1])).cast(pa.string()).cast(pa.int64()).to_numpy()
    coded = flat.dictionary_encode()
    spelt = coded.dictionary.to_pylist()
    plain: dict[bytes, int] = {}
    number = np.array([plain.setdefault(w.removeprefix(MARK), len(plain)) for w in spelt], np.int64)
    marked = np.array([w.startswith(MARK) for w in spelt], bool)
    index = coded.indices.to_numpy()
    pivot, word = np.flatnonzero(marked[index]), number[index]
    left, right = pivot - starts[:-1] - 1, starts[1:] - 1 - pivot
    words, kinds = pa.array(list(plain), pa.binary()), len(plain)
    found: list[tuple[pa.Array, np.ndarray]] = []

    def grow(rows: np.ndarray, node: np.ndarray, s: int, e: int, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """From the phrases ``node`` of these fragments, those with one more word: s words left of the pivot and e right of it."""
        fits = (left[rows] >= s) if to_left else (right[rows] >= e)
        rows, node = rows[fits], node[fits]
        key = node * kinds + word[pivot[rows] + (-s if to_left else e)]
        _, at, code = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(code, weights=weight[rows], minlength=len(at)).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        good = n >= least
        if good.any():
            p, m = pivot[rows[at[good]]] - s, s + e + 1
            phrase = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.arange(len(p) + 1) * m), words.take(pa.array(word[(p[:, None] + np.arange(m)).ravel()]))), b" ")
            found.append((phrase, n[good]))
        stay = good[code] if len(rows) else np.zeros(0, bool)
        return rows[stay], code[stay].astype(np.int64)

    rows, node = np.arange(len(pivot)), word[pivot]
    for s in range(longest):
        if s:
            rows, node = grow(rows, node, s, 0, True)
        more = rows, node
        for e in range(1, longest - s):
            if not len(more[0]):
                break
            more = grow(*more, s, e, False)
        if not len(rows):
            break
    yield from found


def _mine(least: int, longest: int):
    """Rows of whole buckets in order to (lang, phrase, n). Salted ones give all that they count."""

    def mined(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables)
        for lang in pc.unique(t["lang"]).to_pylist():
            for salted in (False, True):
                own = t.filter(pc.and_(pc.equal(t["lang"], lang), pc.equal(t["salted"], salted)))
                if own.num_rows:
                    for phrase, n in grown(own["lines"].combine_chunks(), 1 if salted else least, longest):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), phrase.cast(pa.binary()), pa.array(n)], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            rest.append(t)
            size += t.nbytes
            if size < MINE_BYTES:
                continue
            # The last bucket may go on in the next batch.
            t = pa.concat_tables(rest)
            bucket = t["bucket"].to_numpy()
            cut = len(bucket) - int(np.argmax(bucket[::-1] != bucket[-1])) if bucket[0] != bucket[-1] else 0
            if cut:
                yield from mined([t.slice(0, cut)])
            rest = [t.slice(cut)]
            size = rest[0].nbytes
        if rest:
            yield from mined(rest)

    return run


def counts(docs: DataFrame, work: Workspace, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = TABLE_BITS, hot: int = HOT_PIVOT) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of all words, and (lang, phrase, n) of all phrases of 2 to longest words with n >= least."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(quoted(lang_col)), F.lit("und")).alias("lang"), F.col(quoted(text_col)).cast("binary").alias("text")).filter("length(text) > 0")
    words = texts.mapInArrow(_count(bits), "lang string, word binary, slot int, n long")
    words = work.keep(words.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.first("slot").alias("slot"), F.sum("n").alias("n")), "words")
    sums = words.groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()
    table = np.zeros(1 << bits, np.uint32)
    table[sums["slot"].to_numpy(np.int64)] = np.minimum(sums["n"].to_numpy(np.int64), (1 << 32) - 1)
    width = 2 * shuffle_width(spark)
    routed = texts.mapInArrow(_route(spark.sparkContext.broadcast(table), least, longest, hot, BUCKETS * width), ROUTED)
    routed = routed.repartition(width, "bucket").sortWithinPartitions("bucket")
    phrases = routed.mapInArrow(_mine(least, longest), "lang string, phrase binary, n long")
    return words.drop("slot"), work.keep(phrases.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = TABLE_BITS, hot: int = HOT_PIVOT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases that no longer one stands for."""
    work = Workspace(docs.sparkSession, "phrases")
    words, phrases = counts(docs, work, text_col, lang_col, least, longest, bits, hot)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    if totals.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES:
        totals = F.broadcast(totals)
    split = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    # Counts fall from part to whole: a longer phrase as frequent has one in between that is, too, if it is longer by several words.
    inner = split.filter(F.size("w") > 2).select("lang", F.explode(F.array(part(1, F.size("w") - 1), part(2, F.size("w") - 1))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("whole"))
    left = split.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(F.col("whole") < F.col("a"), F.lit(True))).drop("whole")
    cut = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("x"), part(F.col("k") + 1, F.size("w")).alias("y"))
    known = phrases.unionByName(words.filter(F.col("n") >= least).withColumnRenamed("word", "phrase"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("x"), F.col("n").alias("l")), ["lang", "x"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("y"), F.col("n").alias("r")), ["lang", "y"]).join(totals, "lang")
    best = cut.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slice_ = F.pmod(F.xxhash64("phrase"), F.lit(SLICES))
    few = best.withColumn("_slice", slice_).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("_k") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
