"""Patterns over the single row of a base row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import Binding, Sweep, epoch, frame, row

# Accented letters and what each is without its accent.
ACCENTED = "áàâãäåāăąèééêëēĕėęěìíîïìĩīĭḩóôõöōŏőùúûüũūŭůäàáâãåæçćĉčöòóôõøüùúûßéèêëýñîìíïşěščřžýáíéůúťňďÁČĎÉĚÍŇÓŘŠŤÚŮŽÝŽ"
PLAIN = "aaaaaaaaaeeeeeeeeeeiiiiiiiihooooooouuuuuuuuaaaaaaeccccoooooouuuuseeeeyniiiisescrzyaieuutndACDEEINORSTUUZYZ"

row("Accented", ("character",), f"CASE WHEN translate({{character}}, '{ACCENTED}', '{PLAIN}') = {{character}} THEN 0 ELSE 1 END", where="{character} IS NOT NULL")
#: Digits after the point in a number's shortest text; numbers whose text has an exponent have those of their mantissa.
row("Decimals", ("decimal",), "char_length(regexp_extract(regexp_replace(CAST({decimal_raw} AS STRING), '\\\\.0(E.*)?$', ''), '\\\\.([0-9]+)', 1))", where="{decimal_raw} IS NOT NULL")
row("Direct field", ("any",), "{any}")
row("Direct field nominal", ("counted",), "concat('_', coalesce(CAST({counted} AS STRING), ''))")
row("Email domain", ("character",), "nullif(regexp_extract({character}, '(?s)@.*', 0), '')")
row("Ip local", ("character",), "CASE WHEN {character} LIKE '10.%' OR {character} LIKE '192.168.%' OR {character} LIKE '172.%' THEN 1 ELSE 0 END")
row("Is null", ("any",), "CASE WHEN {any} IS NULL THEN 1 ELSE 0 END")
row("Prefix", ("character",), "left({character}, {length})", sweeps={"length": Sweep(1, 10, 10, True)})
row("Suffix", ("character",), "right({character}, {length})", sweeps={"length": Sweep(1, 10, 10, True)})
row("Ratio", ("numerical1", "numerical2"), "100 * {numerical1} / nullif({numerical2}, 0)")
row("Text length", ("character",), "char_length({character})")
row("Time date diff", ("date1", "date2"), "({date1} - {date2}) / 86400")
row("Time date part", ("date",), "concat('_', CAST({field} AS STRING))", params={"field": ("day({date_raw})", "dayofweek({date_raw}) - 1", "month({date_raw})")})
row("Time date since", ("date",), "({base_date} - {date}) / 86400", needs_date=True)
row(
    "Time day part", ("time",),
    "CASE WHEN {time_raw} IS NULL THEN NULL WHEN hour({time_raw}) < 5 THEN 'night' WHEN hour({time_raw}) < 9 THEN 'morning' WHEN hour({time_raw}) < 18 THEN 'working' WHEN hour({time_raw}) < 21 THEN 'evening' ELSE 'night' END",
)
#: Times of day are held as seconds of the day, from times as well as from timestamps.
row("Time diff", ("time1", "time2"), "pmod({time1}, 86400) - pmod({time2}, 86400)")
row("Time since", ("time",), "pmod({base_date}, 86400) - pmod({time}, 86400)", needs_date=True)
row("Time is weekend", ("date",), "CASE WHEN weekday({date_raw}) >= 5 THEN 1 ELSE 0 END", where="{date_raw} IS NOT NULL")
row("Time month part", ("date",), "CAST(ceil(day({date_raw}) * 3.0D / day(last_day({date_raw}))) AS INT)")
row("Time part", ("time",), "{field}({time_raw})", params={"field": ("hour", "minute")})
#: A word starts after anything that is no letter or digit; its first letter is upper case, the others lower.
row("Title case", ("character",), "CASE WHEN {character} RLIKE '(^|[^\\\\p{{L}}\\\\p{{N}}])\\\\p{{Ll}}' OR {character} RLIKE '[\\\\p{{L}}\\\\p{{N}}]\\\\p{{Lu}}' THEN 0 WHEN {character} IS NULL THEN NULL ELSE 1 END")
row("Zeros", ("numerical",), "CASE WHEN {numerical} = 0 THEN 0 WHEN {numerical} % 1000 = 0 THEN 3 WHEN {numerical} % 100 = 0 THEN 2 WHEN {numerical} % 10 = 0 THEN 1 ELSE 0 END", where="{numerical} IS NOT NULL")
row("Time ksp", ("temporal",), "year({temporal_raw}) + (dayofyear({temporal_raw}) - 0.5D) / dayofyear(make_date(year({temporal_raw}), 12, 31))")


#: Seconds of a stretch of time within which rows are summed by one task.
STRETCH = 3600


def _running(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, _d, _to): the sum of _n over a group's times up to _d.

    Within a stretch of time by a window, between stretches over their totals: a task sorts the times
    of one group in one stretch, or a group's stretches, which the calendar bounds.
    """
    counts = counts.withColumn("_h", F.floor(F.expr(epoch("_d")) / STRETCH))
    totals = counts.groupBy(*group, "_h").agg(F.sum("_n").alias("_t"))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    before = totals.select(*group, "_h", (F.sum("_t").over(upto(*group).orderBy("_h")) - F.col("_t")).alias("_before"))
    within = counts.withColumn("_within", F.sum("_n").over(upto(*group, "_h").orderBy("_d")))
    return within.join(before, [*group, "_h"]).select(*group, "_d", (F.col("_before") + F.col("_within")).alias("_to"))


def _frequency(df: DataFrame, b: Binding) -> DataFrame:
    """Share of rows up to the base date that have the row's value; rows of one date count together.

    Counts of (value, date) and of dates are few: the running sums are over these, never over all rows.
    """
    v, d = F.col(b.columns["nominal"]), F.col(b.date)
    rows = df.filter(v.isNotNull()).select(*b.base, v.alias("_v"), d.alias("_d"))
    pairs = rows.groupBy("_v", "_d").agg(F.count("*").alias("_n"))
    own = _running(pairs, ["_v"]).withColumnRenamed("_to", "_own")
    all_ = _running(pairs.groupBy("_d").agg(F.sum("_n").alias("_n")), []).withColumnRenamed("_to", "_all")
    share = own.join(all_, "_d").select("_v", "_d", (F.col("_own") / F.col("_all")).alias("value"))
    return rows.join(share, ["_v", "_d"]).select(*b.base, "value")


frame("Frequency", "1", ("nominal",), _frequency, needs_date=True)


def _segment(df: DataFrame, b: Binding) -> DataFrame:
    """A number against the mean of the others in its segment. Sums by segment are joined back, so that a large segment is no one task."""
    v = F.col(b.columns["nominal"])
    rows = df.select(*b.base, v.alias("_v"), F.expr(b.number("numerical")).alias("_x"))
    sums = rows.filter("_v IS NOT NULL").groupBy("_v").agg(F.sum("_x").alias("_s"), F.count("*").alias("_c"))
    value = F.when((F.col("_c") > 1) & (F.col("_s") - F.col("_x") != 0), F.col("_x") / ((F.col("_s") - F.col("_x")) / (F.col("_c") - 1)))
    return rows.join(sums, "_v", "left").select(*b.base, value.alias("value"))


frame("Segment comparison", "1", ("nominal", "numerical"), _segment)
