"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, ...; they share all words
by weight, none more than EPOCHS times its own, the excess going to the others by weight.
Schedule: each source's words, shuffled by hash, are cut into equal blocks of its own, about
SLOTS of them or one a word, and its quota is as many slots as its target has blocks, where a
pass over the source is its number of blocks, so that a last, partial block counts by its
words. Slot i of the mix goes to the source whose stretch of the cumulative quotas holds the
i-th golden-ratio point; a source's slots are ranked, and slot r takes block r (mod the
number of its blocks). Golden-ratio points spread so evenly that at any time each source's
slots are within a few of its share: whatever the input's size, what is taken of a source is
within a few blocks of its target, and a block is one word or little more than 1 / SLOTS of
the source.

Sources are a table from first to last: the driver sees sums over them only, so that there
may be as many as there are documents. A source of a large share of all rows is broadcast
to them, and no more sources than that have such a share.

Defined results: null and wordless texts have size 0 and take 0; a source of size 0 gets
target 0; null is a source of its own; an empty table gives an empty result. Rows are placed
by (hash of id, id, size), so repeated rows may change places with each other only, and
reruns agree. Extra columns are not read, and come back unchanged in ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, quoted, shuffle_width, words
from .prefix import place_of, running_start, slice_of, slices_for

WEIGHTS = (1, 2, 3)
EPOCHS = 3
#: Words in a source's block: the source's words over SLOTS, MOST_BLOCK at most.
SLOTS, MOST_BLOCK = 1 << 14, 1 << 20
SLOT_CHUNK = 4096
#: Quotas are counted in such parts of a slot.
PARTS = 1024
#: Up to so many sources, one short row each, are broadcast whole.
MOST_BROADCAST_SOURCES = 50_000
GOLDEN = int((math.sqrt(5) - 1) / 2 * 2**62)  # the step of the point sequence, as a 62-bit fraction
POINT_BITS = 62


def block_words(size: int) -> int:
    return max(1, min(MOST_BLOCK, -(-size // SLOTS)))


def numbered(per: DataFrame, work: Workspace) -> DataFrame:
    """per, one row a source, with ``src``, its number in code point order, null last.

    Sorted in ranges; the driver sees how many rows each range has.
    """
    order = [F.col("_source").isNull(), F.col("_source")]
    ranges = per.repartitionByRange(shuffle_width(per.sparkSession), *order).sortWithinPartitions(*order)
    ranges = ranges.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranges = work.keep(ranges, "ranges")
    return ranges.withColumn("src", _before(ranges, F.count("*")) + F.col("_at"))


def _before(ranges: DataFrame, amount: Column) -> Column:
    """The sum of amount over all ranges before a row's own."""
    run, pairs = 0, []
    for r in sorted(ranges.groupBy("_range").agg(amount.alias("n")).collect(), key=lambda r: r["_range"]):
        pairs += [F.lit(r["_range"]), F.lit(run)]
        run += r["n"]
    return F.element_at(F.create_map(*pairs), F.col("_range")).cast("long") if pairs else F.lit(0).cast("long")


def with_targets(per: DataFrame) -> DataFrame:
    """per (src, size) with each source's words in the mix: its share of all by weight, cut at EPOCHS times its size, the excess reshared.

    The share of one unit of weight rises as sources reach their limit; each round is a sum over
    the sources.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("src") % len(WEIGHTS)).cast("int") + 1)
    per = per.withColumn("_weight", weight)
    total = per.agg(F.sum("size")).first()[0] or 0
    share, full = 0.0, -1
    while total:
        over = F.lit(share) * F.col("_weight") > EPOCHS * F.col("size")
        got = per.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, EPOCHS * F.col("size")).otherwise(0)).alias("taken"), F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))).alias("weight")).first()
        if got["n"] == full:
            break
        full, share = got["n"], (total - got["taken"]) / got["weight"]
    return per.withColumn("target", F.least(F.lit(share) * F.col("_weight"), (EPOCHS * F.col("size")).cast("double"))).drop("_weight")


def with_blocks(per: DataFrame) -> DataFrame:
    """per (size, target) with its block's words, its blocks, and its quota in PARTS of a slot."""
    size = F.col("size")
    block = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK), F.expr(f"(size + {SLOTS - 1}) div {SLOTS}"))).cast("long")
    per = per.withColumn("block", block).withColumn("blocks", F.expr("(size + block - 1) div block"))
    slots = F.col("target") * F.col("blocks") / size  # a partial block counts by its words
    return per.withColumn("quota", F.when((size > 0) & (F.col("target") > 0), F.round(slots * PARTS).cast("long")).otherwise(0).cast("long"))


def schedule(per: DataFrame) -> DataFrame:
    """The mix, slot by slot: (slot, src, rank, block_no, epoch). per: src, size, target, and _range, _at as numbered gives them.

    A source never takes more than EPOCHS passes over its blocks: a slot beyond is left out.
    """
    spark = per.sparkSession
    live = with_blocks(per).filter("quota > 0")
    got = live.agg(F.count("*").alias("n"), F.sum("quota").alias("quota")).first()
    n_live, total = got["n"], got["quota"] or 0
    slots = spark.range(-(-total // PARTS)).withColumnRenamed("id", "slot")
    # The i-th point, i * GOLDEN mod 2**62, computed in parts that stay within 64 bits.
    half = POINT_BITS // 2
    mask = (1 << half) - 1
    hi, lo = GOLDEN >> half, GOLDEN & mask
    i_hi, i_lo = F.shiftright("slot", half), F.col("slot").bitwiseAND(mask)
    point = (F.shiftleft((i_lo * hi + i_hi * lo).bitwiseAND(mask), half) + i_lo * lo).bitwiseAND((1 << POINT_BITS) - 1)
    # Each source's stretch of the points, from the running sum of quotas in order.
    within = F.sum("quota").over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    live = live.withColumn("_end", _before(live, F.sum("quota")) + within)
    edge = lambda c: F.floor(c / F.lit(float(max(total, 1))) * float(1 << POINT_BITS)).cast("long")
    live = live.select("src", "blocks", edge(F.col("_end") - F.col("quota")).alias("lo"), F.when(F.col("_end") == total, F.lit(1 << POINT_BITS)).otherwise(edge(F.col("_end"))).alias("hi")).filter("hi > lo")
    # Points and stretches meet in cells of equal width, about as many as there are sources: a slot meets a few.
    width = POINT_BITS - min(24, max(4, n_live.bit_length() + 1))
    cells = live.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", width), F.shiftright(F.col("hi") - 1, width))))
    cells = F.broadcast(cells) if n_live <= MOST_BROADCAST_SOURCES else cells
    slots = slots.withColumn("point", point).withColumn("cell", F.shiftright("point", width))
    slots = slots.join(cells, "cell").filter("lo <= point AND point < hi").select("slot", "src", "blocks")
    ranked = running_start(slots, ["src"], ["slot"], F.floor(F.col("slot") / SLOT_CHUNK), F.lit(1), "rank").filter(F.col("rank") < EPOCHS * F.col("blocks"))
    return ranked.select("slot", "src", "rank", (F.col("rank") % F.col("blocks")).alias("block_no"), F.expr("rank div blocks").alias("epoch"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    size = F.size(words(F.col(quoted(text_col)))).cast("long")
    return docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(source_col)).cast("string").alias("_source"), size.alias("_size"))


def _beside_sources(rows: DataFrame, per: DataFrame, n_sources: int, n_rows: int) -> DataFrame:
    """rows with their source's columns: (_s, ...) of per, whose n is its rows."""
    on = F.col("_source").eqNullSafe(F.col("_s"))
    if n_sources <= MOST_BROADCAST_SOURCES:
        return rows.join(F.broadcast(per), on)
    # Sources with so large a share of the rows that they would fill a task are no more than this: they are broadcast, and the others joined by a shuffle that none of them skews.
    most = 8 * shuffle_width(rows.sparkSession)
    hot = F.col("n") * most >= n_rows
    few = F.broadcast(per.filter(hot))
    return rows.join(few, on).unionByName(rows.join(F.broadcast(per.filter(hot).select("_s")), on, "left_anti").join(per.filter(~hot), on))


def taken_words(rows: DataFrame, work: Workspace) -> DataFrame:
    """From (_id, _source, _size) to the same rows with _source_size, _target and _taken."""
    rows = work.keep(rows, "sized")
    per = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
    per = work.keep(with_targets(numbered(per, work)), "sources")
    got = per.agg(F.count("*").alias("sources"), F.sum("n").alias("rows")).first()
    mine = with_blocks(per).select(F.col("_source").alias("_s"), "src", F.col("size").alias("_source_size"), F.col("target").alias("_target"), F.col("block").alias("_block"), "n")
    rows = _beside_sources(rows, mine, got["sources"], got["rows"] or 0).drop("_s", "n").withColumn("_place", place_of(F.col("_id"), F.lit(":mix")))
    rows = running_start(rows, ["src"], ["_place", "_id", "_size"], slice_of("_place", slices_for(got["rows"] or 0)), F.col("_size"), "_start")
    rows = work.keep(rows.drop("_place"), "placed")

    times = schedule(per).groupBy("src", "block_no").agg(F.count("*").alias("times"))
    end, block = F.col("_start") + F.col("_size"), F.col("_block")
    pieces = rows.filter("_size > 0").select(
        "src", "_start", "_size", "_block", F.explode(F.sequence(F.expr("_start div _block"), F.expr("(_start + _size - 1) div _block"))).alias("block_no")
    )
    overlap = F.least(end, (F.col("block_no") + 1) * block) - F.greatest(F.col("_start"), F.col("block_no") * block)
    # A row is known by its source and start: stretches of one source don't overlap.
    taken = pieces.join(times, ["src", "block_no"]).groupBy("src", "_start").agg(F.sum(overlap * F.col("times")).alias("_taken"))
    some = rows.filter("_size > 0").join(taken, ["src", "_start"], "left").withColumn("_taken", F.coalesce("_taken", F.lit(0).cast("long")))
    none = rows.filter("_size = 0").withColumn("_taken", F.lit(0).cast("long"))
    return some.unionByName(none).drop("src", "_start", "_block")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: its id, size, source_size, target and the words that the mix takes of it."""
    work = Workspace(docs.sparkSession, "mixing")
    out = taken_words(sized(docs, id_col, text_col, source_col), work)
    work.drop("sized", "ranges")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix has them: each row as many times as the words taken of it come to, to the nearest whole copy.

    Columns as they were. Rows that share an id, a source and a size share their copies
    evenly rounded; rows without words are not part of a mix.
    """
    work = Workspace(docs.sparkSession, "mix")
    taken = taken_words(sized(docs, id_col, text_col, source_col), work)
    # Rows alike in id, source and size are interchangeable: the mean of what they take.
    each = taken.filter("_size > 0").groupBy("_id", "_source", "_size").agg((F.sum("_taken") / F.sum("_size")).alias("_ratio"))
    each = work.keep(each.select(F.col("_id").alias("_key"), F.col("_source").alias("_s"), F.col("_size").alias("_n"), F.floor(F.col("_ratio") + 0.5).cast("int").alias("_copies")).filter("_copies > 0"), "copies")
    work.drop("sized", "ranges", "sources", "placed")
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row")
    out = docs.select(row, F.col(quoted(id_col)).alias("_id"), F.col(quoted(source_col)).cast("string").alias("_source"), F.size(words(F.col(quoted(text_col)))).cast("long").alias("_size"))
    # A merge join at any size: a broadcast that only small inputs get would say nothing of large ones.
    out = out.join(each.hint("merge"), F.col("_id").eqNullSafe(F.col("_key")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n")))
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
