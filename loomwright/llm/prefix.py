"""Running positions over a whole group, however large, without one task per group.

Rows are dealt by a hash to slices; a slice's rows are numbered or summed alone and the
slices' own totals, few rows, give each its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 8192


def slices_for(rows: int) -> int:
    """Slices of some SLICE_ROWS rows, a power of two, so that a group of all rows is still many tasks."""
    return 1 << max(6, (max(rows, 1) // SLICE_ROWS).bit_length())


def place_of(id_: Column, what: Column) -> Column:
    """A pseudo-random place, 0 to 2**60: the first 15 hexadecimal digits of a digest, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), what)), 1, 15), 16, 10).cast("long")


def slice_of(place: str, slices: int) -> Column:
    """The stretch of places, of so many, a power of two, that a place is in: slices follow each other in the order of places."""
    return F.shiftright(place, 60 - (slices.bit_length() - 1)).cast("int")


def running_start(df: DataFrame, group: list[str], order: list[str], slice_of: Column, amount: Column, name: str) -> DataFrame:
    """Adds the sum of amount over the rows of a group that come before, by slice and then by order.

    Two rows of one group that agree in slice and order must be alike in all that matters.
    """
    df = df.withColumn("_slice", slice_of).withColumn("_amount", amount.cast("long"))
    totals = df.groupBy(*group, "_slice").agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long"))).drop("_total")
    within = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum("_amount").over(within), F.lit(0).cast("long")))
    keys = [df[k].eqNullSafe(offsets[k]) for k in [*group, "_slice"]]
    out = df.join(offsets, keys[0] if len(keys) == 1 else _all(keys), "inner")
    for k in [*group, "_slice"]:
        out = out.drop(offsets[k])
    return out.withColumn(name, F.col("_offset") + F.col("_within")).drop("_offset", "_within", "_amount", "_slice")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
