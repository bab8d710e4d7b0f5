"""Which time column of a table bounds its rows to what was known at the base date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import epoch, quoted
from ..settings import Settings
from ..sources.catalog import Catalog
from .base import DATE

_INTERVAL = {"year": "make_interval({n}, 0, 0, 0, 0, 0, 0)", "month": "make_interval(0, {n}, 0, 0, 0, 0, 0)", "day": "make_interval(0, 0, 0, {n}, 0, 0, 0)",
             "hour": "make_interval(0, 0, 0, 0, {n}, 0, 0)", "minute": "make_interval(0, 0, 0, 0, 0, {n}, 0)", "second": "make_interval(0, 0, 0, 0, 0, 0, {n})"}


def moved(column: str, n: int, unit: str) -> str:
    """A time moved by n units, as SQL."""
    return f"(CAST({column} AS TIMESTAMP_NTZ) {'+' if n >= 0 else '-'} {_INTERVAL[unit].format(n=abs(n))})"


def window(column: str, s: Settings) -> Column:
    """Within [base date - lead - lag, base date - lead], both ends included."""
    c = f"CAST({quoted(column)} AS TIMESTAMP_NTZ)"
    return F.expr(f"{c} <= {moved(DATE, -s.lead, s.unit)} AND {c} >= {moved(DATE, -(s.lead + s.lag), s.unit)}")


def literal(t: datetime) -> str:
    return f"TIMESTAMP_NTZ'{t}'"


def bounds(column: str, data_type: T.DataType, span: tuple[datetime, datetime], s: Settings) -> Column:
    """What any base date between the two of span lets in, on the column as it is: filters that a scan understands.

    Rows outside are in no window. A date is held against the days of the ends; a time with a
    zone against the ends and a day more, whatever the session's zone does.
    """
    c, low, high = quoted(column), moved(literal(span[0]), -(s.lead + s.lag), s.unit), moved(literal(span[1]), -s.lead, s.unit)
    if isinstance(data_type, T.DateType):
        low, high = f"CAST({low} AS DATE)", f"CAST({high} AS DATE)"
    elif isinstance(data_type, T.TimestampType):
        low, high = f"CAST({low} - INTERVAL 1 DAY AS TIMESTAMP)", f"CAST({high} + INTERVAL 1 DAY AS TIMESTAMP)"
    return F.expr(f"{c} >= {low} AND {c} <= {high}")


def usable_rows(df: DataFrame, columns: list[str], low: str, high: str, s: Settings) -> dict[str, int]:
    """For each time column, how many rows some base date between low and high would see; one scan for all."""
    got = df.agg(*(
        F.sum(F.expr(f"{moved(quoted(c), s.lead, s.unit)} <= {high} AND {moved(quoted(c), s.lead + s.lag, s.unit)} >= {low}").cast("long")).alias(f"c{k}") for k, c in enumerate(columns)
    )).first()
    return {c: got[f"c{k}"] or 0 for k, c in enumerate(columns)}


def span_of(base: DataFrame) -> tuple[datetime, datetime] | None:
    """The base dates' extremes, without a zone; None where there are none."""
    low, high = base.agg(F.min(F.col(DATE).cast("timestamp_ntz")), F.max(F.col(DATE).cast("timestamp_ntz"))).first()
    return None if low is None else (low, high)


def date_range(base: DataFrame) -> tuple[datetime, datetime]:
    return tuple(base.agg(F.min(DATE), F.max(DATE)).first())


def find_constraint(catalog: Catalog, name: str, base: DataFrame, is_id_unique: bool, now: datetime | None = None, span: tuple[datetime, datetime] | None = None) -> str | None:
    """The time column that bounds a table, or None.

    None without a base date, without time columns and for tables with one row for each id
    (they hold standing facts). Columns with nulls or future dates can't bound. A single
    column declared not null is taken; else the one with most usable rows, of equals the
    last in order; none where no row is usable.
    """
    s = catalog.settings
    if not s.target_date or is_id_unique:
        return None
    table = catalog.tables[name]
    if not table.of_kind("temporal"):
        return None
    catalog.profile(name, now)
    left = [c for c in sorted(table.of_kind("temporal")) if not table.columns[c].has_null and not table.columns[c].has_future]
    if not left:
        return None
    declared = [c for c in left if not table.columns[c].nullable]
    if len(declared) == 1:
        return declared[0]
    span = span or span_of(base)
    if span is None:
        return None
    usable = usable_rows(table.df, left, literal(span[0]), literal(span[1]), s)
    best = max(left, key=lambda c: (usable[c], c))
    return best if usable[best] else None
