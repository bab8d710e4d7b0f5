"""Features that are put together from partial sums, where a plain aggregate would hold a base row's values or look at each row once for each variant.

* ``quantiles``: exact percentiles by rank. Values are counted, counts summed over stretches of the
  number line, and only the stretches that hold a wanted rank are sorted.
* ``windows``: functions over the rows within windows of time. Rows are summed by the cells between
  all windows' ends, and each window is put together from its cells.

Both give one row for each base row: its keys, its target where there is one, and a column for each
feature. Numbers that are null count nowhere; NaN is the largest number, as in Spark's own percentiles.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import Binding, Quantile, Within

#: Stretches of the number line for each doubling of a number.
STRETCHES = 64
NO_VALUE = float("-inf")


def _target(b: Binding) -> list[Column]:
    return [F.first(F.col(b.target)).alias(b.target)] if b.target else []


def quantiles(df: DataFrame, b: Binding, parts: list[tuple[str, Quantile]]) -> DataFrame:
    """Percentiles of one column, interpolated between the two ranks around each.

    A stretch depends on the value alone, and grows with it: one base row's stretches are at most some
    ten thousands, whatever its rows are. The window that sorts within a stretch spills.
    """
    v = F.col("_v")
    stretch = F.coalesce(F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * STRETCHES), F.lit(NO_VALUE))
    counts = df.select(*b.base, F.expr(parts[0][1].column).alias("_v")).groupBy(*b.part, "_v").agg(*_target(b), F.count("_v").alias("_n"))
    counts = counts.withColumn("_s", stretch)
    sums = counts.groupBy(*b.part, "_s").agg(F.sum("_n").alias("_n"))
    of_base = Window.partitionBy(*b.part)
    upto = Window.unboundedPreceding, Window.currentRow
    sums = sums.select(*b.part, "_s", F.sum("_n").over(of_base).alias("_all"), (F.sum("_n").over(of_base.orderBy("_s").rowsBetween(*upto)) - F.col("_n")).alias("_before"), F.col("_n").alias("_in"))
    places = [(F.col("_all") - 1) * F.lit(float(p.share)) for _, p in parts]
    ranks = [(F.floor(at), F.ceil(at)) for at in places]
    holds = lambda rank, start, n: (start <= rank) & (rank < start + n)
    wanted = reduce(or_, (holds(r, F.col("_before"), F.col("_in")) for two in ranks for r in two)) | (F.col("_all") == 0)
    # Stretches are doubles with a place for null, so that a join on them loses none.
    rows = counts.join(sums.filter(wanted).drop("_in"), [*b.part, "_s"])
    within = Window.partitionBy(*b.part, "_s").orderBy("_v").rowsBetween(*upto)
    rows = rows.withColumn("_from", F.col("_before") + F.sum("_n").over(within) - F.col("_n"))
    at_rank = lambda r: F.max(F.when(holds(r, F.col("_from"), F.col("_n")), v))
    found = rows.groupBy(*b.part).agg(*_target(b), F.first("_all").alias("_all"), *(at_rank(r).alias(f"_{side}_{k}") for k, two in enumerate(ranks) for side, r in zip(("low", "high"), two, strict=True)))
    values = []
    for k, ((name, _), at, (low, high)) in enumerate(zip(parts, places, ranks, strict=True)):
        a, z = F.col(f"_low_{k}"), F.col(f"_high_{k}")
        values.append(F.when(a == z, a).otherwise(a * (high - at) + z * (at - low)).alias(name))
    return found.select(*b.base, *values)


def windows(df: DataFrame, b: Binding, parts: list[tuple[str, Within]], inside: str | None = None) -> DataFrame:
    """Windows over one number and one measure of time, their ends left out. ``inside`` names a column that says whether the first window has rows.

    Cells between ends are even, ends themselves odd: a row is looked at once, however many windows there are.
    Spreads are merged cell by cell from counts, means and squared deviations, so that large numbers lose
    no digits: a base row's cells, at most two for each end and two more, are one short array for that.
    """
    first = parts[0][1]
    ends = sorted({x for _, p in parts for x in (p.low, p.high)})
    at = F.col("_t")
    cell = reduce(add, ((at > F.lit(x)).cast("int") + (at >= F.lit(x)).cast("int") for x in ends))
    rows = df.select(*b.base, F.expr(first.column).alias("_x"), F.expr(first.at).alias("_t"))
    cells = rows.withColumn("_c", F.coalesce(cell, F.lit(-1))).groupBy(*b.part, "_c").agg(
        *_target(b), F.count("*").alias("_rows"), F.count("_x").alias("_n"), F.sum("_x").alias("_sum"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        F.avg("_x").alias("_avg"), (F.var_pop("_x") * F.count("_x")).alias("_m2"),
    )
    def over(p: Within, f, column: Column | str) -> Column:
        low, high = 2 * ends.index(p.low) + 2, 2 * ends.index(p.high)
        return f(F.when(F.col("_c").between(low, high), F.col(column) if isinstance(column, str) else column))

    def value(p: Within) -> Column:
        if p.f == "avg":
            return over(p, F.sum, "_sum") / F.nullif(over(p, F.sum, "_n"), F.lit(0))
        if p.f == "stddev_samp":
            return _spread(F.col("_cells"), 2 * ends.index(p.low) + 2, 2 * ends.index(p.high))
        return over(p, {"sum": F.sum, "min": F.min, "max": F.max}[p.f], f"_{p.f}")

    more = [(F.coalesce(over(first, F.sum, "_rows"), F.lit(0)) > 0).alias(inside)] if inside else []
    spreads = [(n, p) for n, p in parts if p.f == "stddev_samp"]
    if spreads:
        more.append(F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.struct("_c", F.col("_n").cast("double").alias("n"), F.col("_avg").alias("mean"), F.col("_m2").alias("m2"))))).alias("_cells"))
    out = cells.groupBy(*b.part).agg(*_target(b), *(value(p).alias(n) for n, p in parts if p.f != "stddev_samp"), *more)
    return out.select(*b.base, *((value(p) if p.f == "stddev_samp" else F.col(n)).alias(n) for n, p in parts), *([inside] if inside else []))


def _spread(cells: Column, low: int, high: int) -> Column:
    """Sample deviation over an array of cells with count, mean and squared deviation, those numbered low to high."""

    def merged(a: Column, c: Column) -> Column:
        n, d = a["n"] + c["n"], c["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * c["n"] / n).alias("mean"), (a["m2"] + c["m2"] + d * d * a["n"] * c["n"] / n).alias("m2"))

    nothing = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.filter(cells, lambda c: c["_c"].between(low, high)), nothing, merged, lambda a: F.when(a["n"] > 1, F.sqrt(a["m2"] / (a["n"] - 1))))
