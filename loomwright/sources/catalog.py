"""What a run knows of its tables: kinds of columns, keys, and facts that take one scan a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import epoch, quoted
from ..settings import CLASSIFICATION, Settings
from .keys import ForeignKey
from .lists import by_table, chosen, resolved

_SMALL_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kinds(data_type: T.DataType, is_id: bool = False) -> set[str]:
    """The slots that a column of that type fits: kinds are not exclusive. Unknown and nested types fit none.

    counted: integers but the largest, and decimals; numbers that may stand for kinds of things.
    """
    if isinstance(data_type, T.StringType):
        return {"any", "character", "nominal"}
    if isinstance(data_type, T.BooleanType):
        return {"any", "nominal", "numerical"}
    if isinstance(data_type, _INTEGERS):
        return {"any", "nominal", "numerical", "number"} | ({"counted"} if isinstance(data_type, _SMALL_INTEGERS) else set())
    if isinstance(data_type, T.DecimalType):
        return {"any", "numerical", "number", "decimal", "counted"} | ({"nominal"} if data_type.scale == 0 or is_id else set())
    if isinstance(data_type, T.FloatType | T.DoubleType):
        return {"any", "numerical", "number", "decimal"}
    if isinstance(data_type, T.DateType):
        return {"any", "temporal", "date"}
    if isinstance(data_type, _DATES):
        return {"any", "temporal", "date", "time"}
    if isinstance(data_type, T.DayTimeIntervalType | T.YearMonthIntervalType):
        return {"any"}
    return set()


@dataclass
class Column:
    name: str
    data_type: T.DataType
    nullable: bool
    kinds: set[str]
    is_id: bool = False
    is_target: bool = False
    #: Facts; None until profiled.
    has_null: bool | None = None
    has_future: bool | None = None
    low: float | None = None
    high: float | None = None


@dataclass
class Table:
    name: str
    df: DataFrame
    columns: dict[str, Column]
    rows: int | None = None
    keys: list[ForeignKey] = field(default_factory=list)

    def of_kind(self, kind: str) -> list[str]:
        return [c.name for c in self.columns.values() if kind in c.kinds]


def _qualified(k: ForeignKey, tables: Mapping[str, DataFrame]) -> ForeignKey:
    """The key with its tables named as they are known: with their schemas, where tables are known by these."""
    full = lambda schema, table: f"{schema}.{table}" if schema and f"{schema}.{table}" in tables else table
    return replace(k, table=full(k.schema, k.table), f_table=full(k.f_schema, k.f_table))


class Catalog:
    """Tables of a run with their columns and foreign keys, black and white lists applied."""

    def __init__(self, tables: Mapping[str, DataFrame], keys: Iterable[ForeignKey], settings: Settings, primary: Mapping[str, str] | None = None, not_null: Iterable[str] = ()):
        self.settings, self.keys = settings, list(keys)
        self._unique: dict[tuple[str, tuple[str, ...]], bool] = {}
        primary = primary or {}
        declared = by_table(not_null, tables)
        white, black = by_table(settings.column_white, tables), by_table(settings.column_black, tables)
        every = lambda names: [t for n in names for t in resolved(n, tables)]
        # A white list that names no table lets none in but the target's.
        names = (set(chosen(tables, every(settings.table_white), every(settings.table_black))) if every(settings.table_white) or not settings.table_white else set()) | {settings.target_table}
        self.keys = [_qualified(k, tables) for k in self.keys]
        self.keys = [k for k in self.keys if k.table in names and k.f_table in names]
        self.tables: dict[str, Table] = {}
        for name in chosen(names):
            df = tables[name]
            # A key marks ids on the side that holds the columns, never by name alone.
            ids = {c for k in self.keys for t, cols in ((k.table, k.columns), (k.f_table, k.f_columns)) if t == name for c in cols}
            if name in primary:
                ids.add(primary[name])
            columns = {}
            for f in df.schema.fields:
                is_id = f.name in ids
                is_target = name == settings.target_table and f.name in settings.targets
                found = kinds(f.dataType, is_id) | ({"id"} if is_id else set())
                if is_target and settings.task == CLASSIFICATION:
                    found = (found | {"nominal"}) - {"numerical", "number", "decimal"}
                if is_target and not settings.target_date:
                    found = set()  # in static data a target explains itself
                if is_id and not settings.use_ids and not is_target:
                    found &= {"id"}
                if f.name in black.get(name, ()) or (white.get(name) and f.name not in white[name] and not is_id and not is_target):
                    found = set()
                columns[f.name] = Column(f.name, f.dataType, f.nullable and f.name not in declared.get(name, ()), found, is_id, is_target)
            self.tables[name] = Table(name, df, columns, keys=[k for k in self.keys if k.table == name or k.f_table == name])

    def profile(self, name: str, now: datetime | None = None) -> Table:
        """Counts rows, nulls, future and extreme dates of a table in one aggregation, once."""
        table = self.tables[name]
        if table.rows is not None:
            return table
        now_sql = epoch(f"TIMESTAMP_NTZ'{(now or datetime.now()).isoformat(sep=' ')}'")
        exprs = [F.count("*").alias("rows")]
        for k, c in enumerate(table.columns.values()):
            exprs.append(F.sum(F.col(quoted(c.name)).isNull().cast("long")).alias(f"null_{k}"))
            if "temporal" in c.kinds or isinstance(c.data_type, _DATES):
                t = epoch(quoted(c.name))
                exprs += [F.expr(f"max({t})").alias(f"high_{k}"), F.expr(f"min({t})").alias(f"low_{k}"), F.expr(f"max({t}) > {now_sql}").alias(f"future_{k}")]
        got = table.df.agg(*exprs).first().asDict()
        table.rows = got["rows"]
        for k, c in enumerate(table.columns.values()):
            c.has_null = bool(got[f"null_{k}"])
            c.high, c.low, c.has_future = got.get(f"high_{k}"), got.get(f"low_{k}"), bool(got.get(f"future_{k}"))
        return table

    def is_unique(self, name: str, columns: Iterable[str]) -> bool:
        """Whether no two rows of a table agree in the columns; looked at once, however many keys lead there."""
        at = (name, tuple(columns))
        if at not in self._unique:
            rows = self.tables[name].df.groupBy(*(quoted(c) for c in at[1])).agg(F.count("*").alias("n"))
            self._unique[at] = rows.filter("n > 1").isEmpty()
        return self._unique[at]

    def top_values(self, name: str, column: str, n: int | None = None) -> list[tuple[Any, int]]:
        """A column's most frequent values that aren't null, with how often they occur; ties by value."""
        return top_values(self.tables[name].df, column, n or self.settings.value_count)


def top_values(df: DataFrame, column: str, n: int) -> list[tuple[Any, int]]:
    c = F.col(quoted(column))
    rows = df.select(c.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    return [(r["v"], r["n"]) for r in rows.orderBy(F.desc("n"), "v").limit(n).collect()]


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(quoted(column)).alias("value")).distinct()


def is_symmetric(df: DataFrame, a: str, b: str) -> bool:
    """Whether each pair (a, b) occurs as (b, a) too."""
    return df.select(a, b).subtract(df.select(F.col(b).alias(a), F.col(a).alias(b))).isEmpty()


def from_schemas(spark: SparkSession, schemas: Iterable[str]) -> dict[str, DataFrame]:
    """All tables of several databases of the session's catalog, by schema.table: one name may stand in each."""
    return {f"{schema}.{name}": df for schema in schemas for name, df in from_spark(spark, schema).items()}


def from_spark(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """All tables of a database of the session's catalog."""
    return {t.name: spark.table(f"{database}.{t.name}" if database else t.name) for t in spark.catalog.listTables(database)}


def from_parquet(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
