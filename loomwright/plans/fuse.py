"""Fusion: many features of one table in as few passes as their kinds allow.

All Agg and Lag features of a table share one grouping by base row: lagged columns are
windows over the same keys, so that window and grouping use one shuffle. Features with
DISTINCT aggregates go into groupings of their own, one for each input, and so do ordered-set
aggregates. Counts features share
one two-level aggregation for each column, quantiles one plan for each column, and windows of time one
set of partial sums for each column and time. Row features are one projection. Frame features
each bring their own plan.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import Agg, Binding, Counts, Frame, Lag, Part, Quantile, Row, Within
from .partials import quantiles, windows

DISTINCT = re.compile(r"\bDISTINCT\s+", re.I)
ORDERED_SET = re.compile(r"\bWITHIN GROUP\b", re.I)


def apart(value: str) -> str | None:
    """What an aggregate must be grouped apart by, or None.

    Spark plans one distinct input of a grouping with two aggregations, but several with a copy
    of each row for each: a grouping has aggregates over one distinct input. Ordered-set
    aggregates hold a group's values.
    """
    if m := DISTINCT.search(value):
        depth, at = 0, m.end()
        while at < len(value) and (depth or value[at] not in ",)"):
            depth += {"(": 1, ")": -1}.get(value[at], 0)
            at += 1
        return "distinct " + value[m.end() : at]
    return "ordered" if ORDERED_SET.search(value) else None


def _value(part: Agg) -> Column:
    value = F.expr(part.value)
    return F.when(F.expr(part.having), value) if part.having else value


def _lagged(df: DataFrame, b: Binding, parts: list[Lag], tie: list[str]) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """df with a column for each distinct (input, order): the input of the row before."""
    names: dict[tuple[str, str], str] = {}
    columns: dict[str, Column] = {}
    for part in parts:
        w = Window.partitionBy(*b.part).orderBy(F.expr(part.order), *tie)
        for i in part.inputs:
            if (i, part.order) not in names:
                name = f"_lag_{len(names)}"
                names[i, part.order] = name
                columns[name] = F.lag(F.expr(i)).over(w)
    return df.withColumns(columns), names


def _lag_value(part: Lag, names: dict[tuple[str, str], str]) -> Column:
    value = part.value
    for k, i in enumerate(part.inputs):
        value = value.replace(f"{{prev_{k}}}", names[i, part.order])
    return F.expr(value)


def single(df: DataFrame, b: Binding, part: Part, tie: list[str] | None = None) -> DataFrame:
    """One feature: the base columns and ``value``, only the rows that the pattern gives."""
    if isinstance(part, Row):
        return (df.filter(F.expr(part.where)) if part.where else df).select(*b.base, F.expr(part.value).alias("value"))
    if isinstance(part, Agg):
        if not part.having:
            return df.groupBy(*b.base).agg(F.expr(part.value).alias("value"))
        out = df.groupBy(*b.base).agg(F.expr(part.value).alias("value"), F.expr(part.having).alias("_keep"))
        return out.filter("_keep").drop("_keep")
    if isinstance(part, Lag):
        rows, names = _lagged(df, b, [part], tie or [])
        return rows.groupBy(*b.base).agg(_lag_value(part, names).alias("value"))
    if isinstance(part, Counts):
        counts = df.select(*b.base, F.expr(part.column).alias("v")).groupBy(*b.base, "v").agg(F.count("*").alias("n"))
        return counts.groupBy(*b.base).agg(F.expr(part.value).alias("value"))
    if isinstance(part, Quantile):
        return quantiles(df, b, [("value", part)])
    if isinstance(part, Within):
        return windows(df, b, [("value", part)], "_keep").filter("_keep").drop("_keep")
    return part.make(df)


def fused(df: DataFrame, b: Binding, features: list[tuple[str, Part]], tie: list[str] | None = None, width: int = 120) -> DataFrame:
    """All features of a table: the base columns and one column for each, null where a pattern gives no row.

    Groups are keyed by id and date alone, on which the target depends: groupings and the joins
    between their results then agree on one partitioning. Where the target is wanted it's a key, too: to
    carry a text as an aggregate, all rows would have to be sorted.
    """
    rows = [(n, p) for n, p in features if isinstance(p, Row)]
    keys = lambda: b.part if rows or tables else b.base
    groups: list[list[tuple[str, Part]]] = [[]]
    own: dict[str, list[tuple[str, Part]]] = defaultdict(list)
    for n, p in features:
        if isinstance(p, Agg) and (kind := apart(p.value)):
            own[kind].append((n, p))
        elif isinstance(p, Agg | Lag):
            if len(groups[-1]) >= width:
                groups.append([])
            groups[-1].append((n, p))
    tables: list[DataFrame] = []  # of all base rows
    for group in [*groups, *own.values()]:
        if not group:
            continue
        lags = [p for _, p in group if isinstance(p, Lag)]
        source, names = _lagged(df, b, lags, tie or []) if lags else (df, {})
        values = ((_value(p) if isinstance(p, Agg) else _lag_value(p, names)).alias(n) for n, p in group)
        tables.append(source.groupBy(*keys()).agg(*values))
    by_column: dict[str, list[tuple[str, Counts]]] = defaultdict(list)
    for n, p in features:
        if isinstance(p, Counts):
            by_column[p.column].append((n, p))
    for column, parts in by_column.items():
        counts = df.select(*b.base, F.expr(column).alias("v")).groupBy(*keys(), "v").agg(F.count("*").alias("n"))
        tables.append(counts.groupBy(*keys()).agg(*(F.expr(p.value).alias(n) for n, p in parts)))
    shared: dict[tuple, list[tuple[str, Part]]] = defaultdict(list)
    for n, p in features:
        if isinstance(p, Quantile):
            shared[quantiles, p.column].append((n, p))
        elif isinstance(p, Within):
            shared[windows, p.column, p.at].append((n, p))
    tables += [plan(df, b, parts) for (plan, *_), parts in shared.items()]
    if rows:
        columns = [F.when(F.expr(p.where), F.expr(p.value)).alias(n) if p.where else F.expr(p.value).alias(n) for n, p in rows]
        wide = df.select(*b.base, *columns)
    else:
        wide = tables.pop(0) if tables else df.select(*b.base).distinct()
    tables += [p.make(df).withColumnRenamed("value", n) for n, p in features if isinstance(p, Frame)]
    more = [t.drop(b.target) if b.target else t for t in tables]
    names = [n for n, _ in features]
    return reduce(lambda left, right: join_base(left, right, b.part), more, wide).select(*b.base, *names)


def join_base(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns where the keys agree. A null key agrees with none."""
    return left.join(right, keys, "left")
