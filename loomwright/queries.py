"""Every operator as a query over the test tables, with SQL that gives the same rows.

Numbers are given as 32-bit floats: sums of doubles differ in their last digits between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import PATTERNS, Binding
from .functions.rows import ACCENTED, PLAIN
from .operators import base as base_ops
from .operators import propagate as propagate_ops
from .operators import temporal as temporal_ops
from .plans import expand, fuse, score
from .plans import run as run_ops
from .settings import REGRESSION, Settings
from .sources.catalog import Catalog, from_parquet, is_symmetric, top_values, unique_values
from .sources.keys import key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
KEYS = [
    key("nation", "n_regionkey", "region", "r_regionkey"),
    key("customer", "c_nationkey", "nation", "n_nationkey"),
    key("supplier", "s_nationkey", "nation", "n_nationkey"),
    key("orders", "o_custkey", "customer", "c_custkey"),
    key("lineitem", "l_orderkey", "orders", "o_orderkey"),
    key("lineitem", "l_partkey", "part", "p_partkey"),
    key("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    key("labels", "doc_id", "documents", "doc_id"),
]
STATIC = Settings("customer", ["c_custkey"], ["c_mktsegment"])
TEMPORAL = Settings("orders", ["o_custkey"], ["o_orderstatus"], "o_orderdate", unit="day", lead=1, lag=3650)
ORDERS = Settings("orders", ["o_orderkey"], ["o_orderstatus"], "o_orderdate", unit="day")
TEXTS = Settings("labels", ["doc_id"], ["quality"])
NUMERIC = Settings("customer", ["c_custkey"], ["c_acctbal"], task=REGRESSION)

ID, TARGET, DATE = "propagated_id1", "propagated_target1", "propagated_date"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return from_parquet(spark, sf_dir, names or TABLES)


@dataclass(frozen=True)
class Source:
    """A propagated table: how to make it, and the same as SQL named p."""

    settings: Settings
    make: Callable[[dict[str, DataFrame]], DataFrame]
    names: tuple[str, ...]
    sql: str

    @property
    def dated(self) -> bool:
        return self.settings.target_date is not None

    @property
    def base(self) -> str:
        return f"{ID}, {DATE}, {TARGET}" if self.dated else f"{ID}, {TARGET}"


def _static(t: dict[str, DataFrame]) -> DataFrame:
    base = base_ops.build_base(t["customer"], STATIC, warn=False)
    return propagate_ops.join_on(propagate_ops.first_table(base, Catalog(t, KEYS, STATIC)).df, t["orders"], ["c_custkey"], ["o_custkey"], STATIC, None)


def _temporal(t: dict[str, DataFrame]) -> DataFrame:
    base = base_ops.build_base(t["orders"], TEMPORAL, warn=False)
    return propagate_ops.join_on(base, t["orders"], [ID], ["o_custkey"], TEMPORAL, "o_orderdate", temporal_ops.span_of(base))


def _own(settings: Settings) -> Callable[[dict[str, DataFrame]], DataFrame]:
    def make(t: dict[str, DataFrame]) -> DataFrame:
        base = base_ops.build_base(t[settings.target_table], settings, warn=False)
        return propagate_ops.first_table(base, Catalog(t, KEYS, settings)).df

    return make


def _texts(t: dict[str, DataFrame]) -> DataFrame:
    base = base_ops.build_base(t["labels"], TEXTS, warn=False)
    return propagate_ops.join_on(propagate_ops.first_table(base, Catalog(t, KEYS, TEXTS)).df, t["documents"], ["doc_id"], ["doc_id"], TEXTS, None)


_BASE_TEMPORAL = f"SELECT o_custkey AS {ID}, o_orderdate AS {DATE}, o_orderstatus AS {TARGET} FROM orders WHERE o_orderdate IS NOT NULL QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1"
ORDERS_OF_CUSTOMERS = Source(STATIC, _static, ("customer", "orders"), f"SELECT c_custkey AS {ID}, c_mktsegment AS {TARGET}, o.* FROM customer JOIN orders o ON o_custkey = c_custkey")
HISTORY = Source(
    TEMPORAL, _temporal, ("orders",),
    f"SELECT b.*, o.* FROM ({_BASE_TEMPORAL}) b JOIN orders o ON o.o_custkey = b.{ID} AND o.o_orderdate <= b.{DATE} - INTERVAL 1 DAY AND o.o_orderdate >= b.{DATE} - INTERVAL 3651 DAY",
)
CUSTOMERS = Source(STATIC, _own(STATIC), ("customer",), f"SELECT c_custkey AS {ID}, c_mktsegment AS {TARGET}, customer.* FROM customer")
SINGLE_ORDERS = Source(ORDERS, _own(ORDERS), ("orders",), f"SELECT o_orderkey AS {ID}, o_orderdate AS {DATE}, o_orderstatus AS {TARGET}, orders.* FROM orders")
TEXT_ROWS = Source(TEXTS, _texts, ("labels", "documents"), f"SELECT l.doc_id AS {ID}, l.quality AS {TARGET}, d.* FROM labels l JOIN documents d ON d.doc_id = l.doc_id")


def as_float(df: DataFrame, digits: int | None = None) -> DataFrame:
    """All numbers but the base columns as 32-bit floats, rounded first where halves of a float's last digit are likely."""
    keep = {ID, DATE, TARGET}
    number = lambda c: F.col(c) if digits is None else F.round(c, digits)
    return df.select(*(number(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.NumericType) and f.name not in keep else F.col(f.name) for f in df.schema.fields))


def binding(source: Source, **more: Any) -> Binding:
    return Binding((ID,), date=DATE if source.dated else None, target=TARGET, fold=base_ops.FOLD, **more)


def pattern(name: str, source: Source, columns: dict[str, str], variants: dict[str, dict[str, Any]], sql: str | None, before: Callable[[DataFrame], DataFrame] | None = None, only: str | None = None, digits: int | None = None, **more: Any) -> None:
    """Registers a pattern's query: one column for each variant of its parameters, all fused.

    sql: a select list over p with the base grouped or not, or a whole SELECT, {p} being the
    table and {base} its base columns.
    """
    p = PATTERNS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source.make(tables(spark, sf_dir, *source.names))
        df = before(df) if before else df
        b = binding(source, columns=columns, **more)
        parts = [(variant, p.build(replace(b, params=params))) for variant, params in variants.items()]
        tie = ["o_orderkey"] if "o_orderkey" in df.columns else []
        if only:  # a pattern that leaves rows out, by itself
            return as_float(fuse.single(df, b, parts[0][1], tie).withColumnRenamed("value", parts[0][0]))
        return as_float(fuse.fused(df, b, parts, tie), digits)

    QUERIES[name] = query
    if sql:
        body = sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT {{base}}, {sql} FROM {{p}}" + (f" GROUP BY {{base}}" if p.cardinality == "n" else "")
        ORACLE_SQL[name] = body.replace("{p}", f"({source.sql}) p").replace("{base}", source.base)


def fl(sql: str, name: str) -> str:
    return f"CAST({sql} AS FLOAT) AS {name}"


FUNCTIONS = ("stddev_samp", "avg", "min", "max", "sum")
X, D = "o_totalprice", "o_orderdate"
_n, _d, _c, _nt = {"numerical": X}, {"temporal": D}, {"nominal": "o_orderpriority"}, {"numerical": X, "temporal": D}
_one = {"value": {}}


def by_function(sql: str, functions: tuple[str, ...] = FUNCTIONS) -> str:
    return ", ".join(fl(sql.replace("{f}", f), f) for f in functions)


def with_f(functions: tuple[str, ...] = FUNCTIONS, **more: Any) -> dict[str, dict[str, Any]]:
    return {f: {"f": f, **more} for f in functions}


# Aggregates.
pattern("aggregate", ORDERS_OF_CUSTOMERS, _n, with_f(), by_function(f"{{f}}({X})"))
pattern("aggregate_distinct", ORDERS_OF_CUSTOMERS, {"numerical": "o_orderkey"}, with_f(("stddev_samp", "avg", "sum")), by_function("{f}(DISTINCT CAST(o_orderkey AS DOUBLE))", ("stddev_samp", "avg", "sum")))
pattern("aggregate_range", ORDERS_OF_CUSTOMERS, _n, _one, fl(f"max({X}) - min({X})", "value"))
_AGE = f"((epoch({DATE}) - epoch({D})) / 86400)"
pattern(
    "aggregate_frame", HISTORY, {"numerical": X, "date": D}, {f"{f}_{lag}_{int(lead * 10)}": {"f": f, "lag": lag, "lead_fraction": lead} for f in ("avg", "sum") for lag in (100, 240) for lead in (0.2, 0.8)},
    ", ".join(fl(f"{f}(CASE WHEN {_AGE} > {lead} * {lag} AND {_AGE} < {lag} THEN {X} END)", f"{f}_{lag}_{int(lead * 10)}") for f in ("avg", "sum") for lag in (100, 240) for lead in (0.2, 0.8)),
)
pattern(
    "aggregate_robust", ORDERS_OF_CUSTOMERS, _n, {f"{o.lower()}_{n}": {"order": o, "nth": n} for o in ("ASC", "DESC") for n in (2, 3)},
    ", ".join(fl(f"list_sort(list({X}), '{o}')[least({n}, count({X}))]", f"{o.lower()}_{n}") for o in ("ASC", "DESC") for n in (2, 3)),
)
pattern("aggregate_subgroup", ORDERS_OF_CUSTOMERS, {**_c, **_n}, with_f(value="1-URGENT"), by_function(f"{{f}}(CASE WHEN o_orderpriority = '1-URGENT' THEN {X} END)"))
pattern("aggregate_text_length", ORDERS_OF_CUSTOMERS, {"character": "o_orderpriority"}, with_f(FUNCTIONS[:4]), by_function("{f}(CAST(length(o_orderpriority) AS DOUBLE))", FUNCTIONS[:4]))
pattern("coefficient_of_variation", ORDERS_OF_CUSTOMERS, _n, _one, fl(f"stddev_samp({X}) / nullif(avg({X}), 0)", "value"))
_T = f"epoch({D})"
_SLOPE = f"covar_pop({X}, {_T}) / nullif(var_pop({_T}), 0)"
pattern("correlation", ORDERS_OF_CUSTOMERS, _nt, _one, fl(f"covar_pop({X}, {_T}) / nullif(stddev_pop({X}) * stddev_pop({_T}), 0)", "value"))
pattern("slope", ORDERS_OF_CUSTOMERS, _nt, _one, fl(_SLOPE, "value"))
pattern("intercept", ORDERS_OF_CUSTOMERS, _nt, _one, fl(f"avg({X}) - {_SLOPE} * avg({_T})", "value"))
pattern("count", ORDERS_OF_CUSTOMERS, {}, _one, fl("count(*)", "value"))
pattern("distinct_count", ORDERS_OF_CUSTOMERS, _c, _one, fl("count(DISTINCT o_orderpriority)", "value"))
pattern("entropy_continuous", ORDERS_OF_CUSTOMERS, _n, _one, fl("ln(sum({x})) - sum({x} * ln({x})) / sum({x})".replace("{x}", f"(CASE WHEN {X} > 0 THEN {X} END)"), "value"))
pattern("existential_count", ORDERS_OF_CUSTOMERS, _c, {"urgent": {"value": "1-URGENT"}, "low": {"value": "5-LOW"}}, ", ".join(fl(f"count(*) FILTER (WHERE o_orderpriority = '{v}')", n) for n, v in (("urgent", "1-URGENT"), ("low", "5-LOW"))))
pattern("geometric_mean", ORDERS_OF_CUSTOMERS, {"number": X}, _one, fl(f"exp(avg(ln(CASE WHEN {X} > 0 THEN {X} END)))", "value"))
pattern("harmonic_mean", ORDERS_OF_CUSTOMERS, _n, _one, fl(f"count(nullif({X}, 0)) / nullif(sum(1 / nullif({X}, 0)), 0)", "value"))
pattern("log_product", ORDERS_OF_CUSTOMERS, _n, _one, fl(f"sum(ln(CASE WHEN {X} > -1 THEN {X} + 1 END))", "value"))
pattern("mean_absolute_difference", ORDERS_OF_CUSTOMERS, _n, _one, f"SELECT {{base}}, {fl('round(avg(abs(x - m)), 5)', 'value')} FROM (SELECT {{base}}, {X} AS x, avg({X}) OVER (PARTITION BY {{base}}) AS m FROM {{p}}) GROUP BY {{base}}", digits=5)
pattern("null_ratio", ORDERS_OF_CUSTOMERS, {"any": "o_orderdate"}, _one, fl("avg(CASE WHEN o_orderdate IS NULL THEN 1.0 ELSE 0.0 END)", "value"))
pattern("percentile", ORDERS_OF_CUSTOMERS, _n, {f"p{int(p * 100)}": {"p": p} for p in (0.05, 0.5, 0.95)}, ", ".join(fl(f"quantile_cont({X}, {p})", f"p{int(p * 100)}") for p in (0.05, 0.5, 0.95)))
pattern(
    "skewness", ORDERS_OF_CUSTOMERS, _n, _one,
    f"SELECT {{base}}, {fl('CASE WHEN min(s) > 0 AND count(x) = 2 THEN 0 WHEN min(s) > 0 THEN avg(power((x - m) / s, 3)) END', 'value')} FROM (SELECT {{base}}, {X} AS x, avg({X}) OVER (PARTITION BY {{base}}) AS m, nullif(stddev_samp({X}) OVER (PARTITION BY {{base}}), 0) AS s FROM {{p}}) GROUP BY {{base}}",
)
pattern("time_aggregate", ORDERS_OF_CUSTOMERS, _d, with_f(), by_function(f"{{f}}({_T})"))
pattern("time_aggregate_since", HISTORY, _d, with_f(("min", "max", "avg", "stddev_samp")), by_function(f"{{f}}({_AGE})", ("min", "max", "avg", "stddev_samp")))
pattern("time_aggregate_since_event", HISTORY, {**_c, **_d}, with_f(("min", "max", "avg"), value="5-LOW"), by_function(f"{{f}}(CASE WHEN o_orderpriority = '5-LOW' THEN {_AGE} END)", ("min", "max", "avg")))
pattern("time_frequency", ORDERS_OF_CUSTOMERS, _d, _one, fl(f"count(*) / (max({_T}) - min({_T}) + 1)", "value"))
pattern("time_range", ORDERS_OF_CUSTOMERS, _d, _one, fl(f"(max({_T}) - min({_T})) / 86400", "value"))
_peaks = {"highest": {"order": "DESC"}, "lowest": {"order": "ASC"}}
_PEAK = f"SELECT {{base}}, {{list}} FROM (SELECT *, rank() OVER (PARTITION BY {{base}} ORDER BY {X} DESC) AS hi, rank() OVER (PARTITION BY {{base}} ORDER BY {X}) AS lo FROM {{p}}) GROUP BY {{base}}"
pattern("time_of_peak", ORDERS_OF_CUSTOMERS, _nt, _peaks, _PEAK.replace("{list}", ", ".join(fl(f"max({_T}) FILTER (WHERE {k} = 1)", n) for n, k in (("highest", "hi"), ("lowest", "lo")))))
pattern("time_from_peak", HISTORY, _nt, _peaks, _PEAK.replace("{list}", ", ".join(fl(f"(epoch({DATE}) - max({_T}) FILTER (WHERE {k} = 1)) / 86400", n) for n, k in (("highest", "hi"), ("lowest", "lo")))))

# With the row before, by time and order key.
_LAG = f"SELECT {{base}}, {{list}} FROM (SELECT *, epoch({D}) AS t, lag({{col}}) OVER w AS before, lag(epoch({D})) OVER w AS t_before FROM {{p}} WINDOW w AS (PARTITION BY {{base}} ORDER BY {D}, o_orderkey)) GROUP BY {{base}}"


def lag_sql(column: str, sql: str) -> str:
    return _LAG.replace("{list}", fl(sql, "value")).replace("{col}", column)


pattern("change_count", ORDERS_OF_CUSTOMERS, {**_c, **_d}, _one, lag_sql("o_orderpriority", "count(*) FILTER (WHERE before <> o_orderpriority)"))
pattern("change_ratio", ORDERS_OF_CUSTOMERS, {"nominal": X, **_d}, _one, lag_sql(X, f"(count(*) FILTER (WHERE before < {X}) + 1) / CAST(count(*) FILTER (WHERE before > {X}) + 1 AS DOUBLE)"))
pattern("integral", ORDERS_OF_CUSTOMERS, _nt, _one, lag_sql(X, f"sum(({X} + before) * (t - t_before) / 2)"))
_centred = lambda df: df.withColumn(X, F.col(X) - 150000.0)  # noqa: E731  prices are positive: crossings of a level
pattern("zero_crossing", ORDERS_OF_CUSTOMERS, _nt, _one, lag_sql(X, f"count(*) FILTER (WHERE sign({X} - 150000) <> sign(before - 150000))"), before=_centred)

# Over values and how often they occur.
_COUNTS = "SELECT {base}, {list} FROM (SELECT {base}, o_orderpriority AS v, CAST(count(*) AS DOUBLE) AS n FROM {p} GROUP BY {base}, o_orderpriority) GROUP BY {base}"
pattern("concentration", ORDERS_OF_CUSTOMERS, _c, _one, _COUNTS.replace("{list}", fl("100 * max(n) FILTER (WHERE v IS NOT NULL) / sum(n) FILTER (WHERE v IS NOT NULL)", "value")))
pattern("duplicate_ratio", ORDERS_OF_CUSTOMERS, _c, _one, _COUNTS.replace("{list}", fl("coalesce(sum(n) FILTER (WHERE n >= 2), 0) / sum(n)", "value")))
pattern("entropy", ORDERS_OF_CUSTOMERS, _c, _one, _COUNTS.replace("{list}", fl("ln(sum(n)) - sum(n * ln(n)) / sum(n)", "value")))
pattern(
    "mode", ORDERS_OF_CUSTOMERS, _c, _one,
    "SELECT {base}, min(v) FILTER (WHERE k = 1) AS value FROM (SELECT *, row_number() OVER (PARTITION BY {base} ORDER BY n DESC, v) AS k FROM (SELECT {base}, o_orderpriority AS v, count(*) AS n FROM {p} WHERE o_orderpriority IS NOT NULL GROUP BY {base}, o_orderpriority)) GROUP BY {base}",
)

# One row for each base row.
_FOLDED = f"translate(text, '{ACCENTED}', '{PLAIN}')"
pattern("accented", TEXT_ROWS, {"character": "text"}, _one, f"SELECT {{base}}, {fl(f'CASE WHEN {_FOLDED} = text THEN 0 ELSE 1 END', 'value')} FROM {{p}} WHERE text IS NOT NULL", only="value")
pattern("decimals", CUSTOMERS, {"decimal": "c_acctbal"}, _one, f"SELECT {{base}}, {fl('''length(regexp_extract(regexp_replace(CAST(c_acctbal AS VARCHAR), '[.]0$', ''), '[.]([0-9]+)', 1))''', 'value')} FROM {{p}} WHERE c_acctbal IS NOT NULL", only="value")
pattern("direct_field", CUSTOMERS, {"any": "c_name"}, _one, "c_name AS value")
pattern("direct_field_nominal", CUSTOMERS, {"counted": "c_nationkey"}, _one, "concat('_', coalesce(CAST(c_nationkey AS VARCHAR), '')) AS value")
_mail = lambda df: df.withColumn("c_name", F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat(c_name, '@', c_mktsegment, '.com') END"))
pattern("email_domain", CUSTOMERS, {"character": "c_name"}, _one, "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('@', c_mktsegment, '.com') END AS value", before=_mail)
_ip = lambda df: df.withColumn("c_name", F.expr("concat(element_at(array('10', '192', '172', '8'), CAST(c_custkey % 4 + 1 AS INT)), '.168.', c_custkey % 7, '.1')"))
pattern("ip_local", CUSTOMERS, {"character": "c_name"}, _one, fl("CASE WHEN c_custkey % 4 < 3 THEN 1 ELSE 0 END", "value"), before=_ip)
pattern("is_null", CUSTOMERS, {"any": "c_acctbal"}, _one, fl("CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END", "value"))
pattern("prefix", CUSTOMERS, {"character": "c_name"}, {f"l{n}": {"length": n} for n in (1, 5, 10)}, ", ".join(f"left(c_name, {n}) AS l{n}" for n in (1, 5, 10)))
pattern("suffix", CUSTOMERS, {"character": "c_name"}, {f"l{n}": {"length": n} for n in (1, 5, 10)}, ", ".join(f"right(c_name, {n}) AS l{n}" for n in (1, 5, 10)))
pattern("ratio", CUSTOMERS, {"numerical1": "c_acctbal", "numerical2": "c_nationkey"}, _one, fl("100 * c_acctbal / nullif(CAST(c_nationkey AS DOUBLE), 0)", "value"))
pattern("text_length", TEXT_ROWS, {"character": "text"}, _one, fl("length(text)", "value"))
_two = lambda df: df.withColumn("later", F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 90 AS INT))"))
pattern("time_date_diff", SINGLE_ORDERS, {"date1": "later", "date2": D}, _one, fl("o_orderkey % 90", "value"), before=_two)
_PARTS = {"day": f"day({D})", "dow": f"dayofweek({D})", "month": f"month({D})"}
pattern("time_date_part", SINGLE_ORDERS, {"date": D}, {"day": {"field": f"day(`{D}`)"}, "dow": {"field": f"dayofweek(`{D}`) - 1"}, "month": {"field": f"month(`{D}`)"}}, ", ".join(f"concat('_', CAST({v} AS VARCHAR)) AS {k}" for k, v in _PARTS.items()))
_event = lambda df: df.withColumn("seen", F.expr(f"{D} - make_dt_interval(CAST(o_orderkey % 90 AS INT))"))
pattern("time_date_since", SINGLE_ORDERS, {"date": "seen"}, _one, fl("o_orderkey % 90", "value"), before=_event)
_clock = lambda df: df.withColumn("at", F.expr(f"{D} + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), CAST(o_orderkey % 60 AS INT))"))
_AT = f"({D} + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)))"
pattern(
    "time_day_part", SINGLE_ORDERS, {"time": "at"}, _one,
    f"CASE WHEN hour({_AT}) < 5 OR hour({_AT}) >= 21 THEN 'night' WHEN hour({_AT}) < 9 THEN 'morning' WHEN hour({_AT}) < 18 THEN 'working' ELSE 'evening' END AS value", before=_clock,
)
pattern("time_part", SINGLE_ORDERS, {"time": "at"}, {"hour": {"field": "hour"}, "minute": {"field": "minute"}}, f"{fl(f'hour({_AT})', 'hour')}, {fl(f'minute({_AT})', 'minute')}", before=_clock)
_SECONDS = "(hour({t}) * 3600 + minute({t}) * 60 + second({t}))"
pattern("time_diff", SINGLE_ORDERS, {"time1": "at", "time2": D}, _one, fl(f"{_SECONDS.replace('{t}', _AT)} - {_SECONDS.replace('{t}', D)}", "value"), before=_clock)
pattern("time_since", SINGLE_ORDERS, {"time": "at"}, _one, fl(f"{_SECONDS.replace('{t}', D)} - {_SECONDS.replace('{t}', _AT)}", "value"), before=_clock)
pattern("time_is_weekend", SINGLE_ORDERS, {"date": D}, _one, f"SELECT {{base}}, {fl(f'CASE WHEN isodow({D}) >= 6 THEN 1 ELSE 0 END', 'value')} FROM {{p}} WHERE {D} IS NOT NULL", only="value")
pattern("time_month_part", SINGLE_ORDERS, {"date": D}, _one, fl(f"ceil(day({D}) * 3.0 / day(last_day({D})))", "value"))
pattern("time_ksp", SINGLE_ORDERS, {"temporal": D}, _one, fl(f"year({D}) + (dayofyear({D}) - 0.5) / dayofyear(make_date(year({D}), 12, 31))", "value"))
pattern("title_case", TEXT_ROWS, {"character": "text"}, _one, fl("CASE WHEN regexp_matches(text, '(^|[^\\p{L}\\p{N}])\\p{Ll}') OR regexp_matches(text, '[\\p{L}\\p{N}]\\p{Lu}') THEN 0 ELSE 1 END", "value"))
_round = lambda df: df.withColumn(X, F.expr(f"floor({X} / 10) * 10"))
pattern("zeros", SINGLE_ORDERS, {"numerical": X}, _one, fl(f"CASE WHEN floor({X} / 10) = 0 THEN 0 WHEN floor({X} / 10) % 100 = 0 THEN 3 WHEN floor({X} / 10) % 10 = 0 THEN 2 ELSE 1 END", "value"), before=_round)
pattern(
    "frequency", SINGLE_ORDERS, {"nominal": "o_orderpriority"}, _one,
    f"SELECT {{base}}, {fl(f'count(*) OVER (PARTITION BY o_orderpriority ORDER BY {DATE}) / CAST(count(*) OVER (ORDER BY {DATE}) AS DOUBLE)', 'value')} FROM {{p}} WHERE o_orderpriority IS NOT NULL",
)
_SEG = "SELECT {base}, {v} FROM (SELECT *, sum(c_acctbal) OVER w AS s, count(*) OVER w AS c FROM {p} WINDOW w AS (PARTITION BY c_nationkey))"
pattern("segment_comparison", CUSTOMERS, {"nominal": "c_nationkey", "numerical": "c_acctbal"}, _one, _SEG.replace("{v}", fl("CASE WHEN c > 1 THEN c_acctbal / nullif((s - c_acctbal) / (c - 1), 0) END", "value")))

# Encodings by the target. Classes: orders with status F, customers of one segment.
_POS, _NEG = "CASE WHEN propagated_target1 = '{t}' THEN 1 ELSE 0 END", "CASE WHEN propagated_target1 <> '{t}' THEN 1 ELSE 0 END"


def labelled(column: str, target: str, *more: str) -> str:
    """p with the value, its class flags, their sums by value and over all rows."""
    pos, neg = _POS.replace("{t}", target), _NEG.replace("{t}", target)
    extra = "".join(f", {m}" for m in more)
    return (
        f"(SELECT *, sum(pos) OVER (PARTITION BY v) AS p_i, sum(neg) OVER (PARTITION BY v) AS q_i, count(*) OVER (PARTITION BY v) AS n_i, sum(pos) OVER () AS p_all, sum(neg) OVER () AS q_all{extra} "
        f"FROM (SELECT *, {column} AS v, CAST({pos} AS DOUBLE) AS pos, CAST({neg} AS DOUBLE) AS neg FROM {{p}}) WHERE v IS NOT NULL)"
    )


_b = {"target_value": "BUILDING"}
_nation = {"nominal": "c_nationkey"}
_NATION = labelled("c_nationkey", "BUILDING")
_PRIORITY = labelled("o_orderpriority", "BUILDING")
_WOE = "100 * ln(((p_i + 1 - pos) / (p_all + {k})) / ((q_i + 1 - neg) / (q_all + {k})))"
_PLAIN_WOE = "100 * ln(((p_i + 1) / (p_all + 2)) / ((q_i + 1) / (q_all + 2)))"
pattern("woe", CUSTOMERS, _nation, _one, f"SELECT {{base}}, {fl(_WOE.replace('{k}', '2'), 'value')} FROM {_NATION}", **_b)
pattern("woe_mod", CUSTOMERS, _nation, _one, f"SELECT {{base}}, {fl(_WOE.replace('{k}', '(SELECT count(DISTINCT c_nationkey) FROM customer)'), 'value')} FROM {_NATION}", **_b)
pattern("woe_no_loo", CUSTOMERS, _nation, _one, f"SELECT {{base}}, {fl(_PLAIN_WOE, 'value')} FROM {_NATION}", **_b)
pattern("odds_ratio", CUSTOMERS, _nation, _one, f"SELECT {{base}}, {fl('ln((p_i + 1) * (q_all + 2 - q_i - 1) / ((q_i + 1) * (p_all + 2 - p_i - 1)))', 'value')} FROM {_NATION}", **_b)
pattern("affinity", CUSTOMERS, _nation, _one, f"SELECT {{base}}, {fl('(p_i + 1) / (p_i + q_i + 2)', 'value')} FROM {_NATION}", **_b)
pattern("affinity_loo", CUSTOMERS, _nation, _one, f"SELECT {{base}}, {fl('(p_i + 1 - pos) / (p_i + q_i + 1)', 'value')} FROM {_NATION}", **_b)
pattern("affinity_loo_em", CUSTOMERS, _nation, _one, f"SELECT {{base}}, {fl('(p_i + 0.5 - pos) / (p_i + q_i + 1)', 'value')} FROM {_NATION}", prior=0.25, **_b)
_fold = lambda df: df.withColumn(base_ops.FOLD, F.expr(f"CAST({ID} % 10 AS INT)"))
_OTHER = "(SELECT avg({c}) FROM s WHERE s.v = r.v AND s.f <> r.f AND {c} > 0)"
pattern(
    "affinity_cv", CUSTOMERS, _nation, _one,
    f"WITH r AS (SELECT *, {ID} % 10 AS f FROM {_NATION}), s AS (SELECT v, f, sum(pos) AS a, sum(neg) AS b FROM r GROUP BY v, f) "
    f"SELECT {{base}}, {fl('a / (a + b)', 'value')} FROM (SELECT {{base}}, coalesce({_OTHER.replace('{c}', 'a')}, 0) + 1 AS a, coalesce({_OTHER.replace('{c}', 'b')}, 0) + 1 AS b FROM r)", before=_fold, **_b,
)
_RATES = "SELECT {base}, {v} FROM " + _PRIORITY + " GROUP BY {base}"
pattern("affinity2", ORDERS_OF_CUSTOMERS, _c, _one, _RATES.replace("{v}", fl("sum(q_i / n_i + 1) / sum(p_i / n_i + 1)", "value")), **_b)
pattern("affinity_weighted", ORDERS_OF_CUSTOMERS, _c, _one, _RATES.replace("{v}", fl("sum(q_i / n_i + 1) / sum(p_i / n_i + 1) * sqrt(count(*))", "value")), **_b)
pattern("woe_limit", ORDERS_OF_CUSTOMERS, _c, _one, _RATES.replace("{v}", fl("avg(100 * ln((p_i + 0.5) / (p_all + 0.5) / (q_i + 0.5) / (q_all + 0.5))) FILTER (WHERE n_i >= 10)", "value")), **_b)
pattern(
    "aggregate_woe", ORDERS_OF_CUSTOMERS, _c, _one,
    f"SELECT {{base}}, {fl('avg(100 * ln(((p_i + 1 - p_own) / (p_all + 2)) / ((q_i + 1 - q_own) / (q_all + 2))))', 'value')} FROM {labelled('o_orderpriority', 'BUILDING', f'sum(pos) OVER (PARTITION BY {ID}, v) AS p_own', f'sum(neg) OVER (PARTITION BY {ID}, v) AS q_own')} GROUP BY {{base}}", **_b,
)
pattern("time_date_woe", ORDERS_OF_CUSTOMERS, {"date": D}, {f: {"field": f} for f in ("month",)}, f"SELECT {{base}}, {fl(f'avg({_PLAIN_WOE})', 'month')} FROM {labelled(f'month({D})', 'BUILDING')} GROUP BY {{base}}", **_b)
_at = labelled(f"hour({_AT})", "BUILDING")
pattern("time_woe", ORDERS_OF_CUSTOMERS, {"time": "at"}, {"hour": {"field": "hour"}}, f"SELECT {{base}}, {fl(f'avg({_PLAIN_WOE})', 'hour')} FROM {_at} GROUP BY {{base}}", before=_clock, **_b)
pattern(
    "tfidf", ORDERS_OF_CUSTOMERS, _c, {"value": {"value": "5-LOW"}},
    f"WITH p AS (SELECT * FROM {{p}}) SELECT {{base}}, {fl(f'''count(*) * ln((SELECT count(DISTINCT {ID}) FROM p) / CAST((SELECT count(DISTINCT {ID}) FROM p WHERE o_orderpriority = '5-LOW') AS DOUBLE))''', 'value')} FROM p WHERE o_orderpriority = '5-LOW' GROUP BY {{base}}", only="value",
)
_small = lambda df: df.withColumn(X, F.col(X) / 100000 - 1)
_XS = f"({X} / 100000 - 1)"
pattern("product", ORDERS_OF_CUSTOMERS, _n, _one, fl(f"CASE WHEN min(abs({_XS})) = 0 THEN 0 ELSE (CASE WHEN count(*) FILTER (WHERE {_XS} < 0) % 2 = 1 THEN -1 ELSE 1 END) * exp(sum(ln(abs({_XS})))) END", "value"), before=_small)
_RANKED = f"SELECT {{base}}, o_orderpriority AS value FROM (SELECT *, row_number() OVER (PARTITION BY {{base}} ORDER BY {X} {{o}}, o_orderkey) AS k FROM {{p}}) WHERE k = 2"
_snap = {"id": "o_orderkey", **_c, **_n}
pattern("child_snapshot_top", ORDERS_OF_CUSTOMERS, _snap, {"value": {"rank": 2}}, _RANKED.replace("{o}", "DESC"), only="value")
pattern("child_snapshot_bottom", ORDERS_OF_CUSTOMERS, _snap, {"value": {"rank": 2}}, _RANKED.replace("{o}", "ASC"), only="value")
pattern("child_snapshot", ORDERS_OF_CUSTOMERS, {"any": "o_orderpriority", **_n}, _one, f"SELECT {{base}}, min(o_orderpriority) AS value FROM (SELECT *, rank() OVER (PARTITION BY {{base}} ORDER BY {X} DESC) AS k FROM {{p}}) WHERE k = 1 GROUP BY {{base}} HAVING count(*) = 1", only="value")
_NB = (
    "WITH p AS (SELECT * FROM {p}), r AS (SELECT *, {c} AS v FROM p WHERE propagated_target1 IS NOT NULL), "
    "lv AS (SELECT count(*) AS k FROM (SELECT DISTINCT v FROM r)), pr AS (SELECT propagated_target1 AS t, CAST(count(*) AS DOUBLE) AS n, ln({prior}) AS lp FROM r GROUP BY propagated_target1), "
    "jt AS (SELECT v, propagated_target1 AS t, count(*) AS j FROM r GROUP BY v, propagated_target1), "
    "lk AS (SELECT a.v, pr.t, ln((1 + coalesce(j, 0)) / (n + k)) AS l, lp FROM (SELECT DISTINCT v FROM r) a CROSS JOIN pr CROSS JOIN lv LEFT JOIN jt ON jt.v IS NOT DISTINCT FROM a.v AND jt.t = pr.t) "
)
pattern(
    "direct_nb", CUSTOMERS, _nation, _one,
    _NB.replace("{c}", "c_nationkey").replace("{prior}", "count(*) / CAST((SELECT count(*) FROM r) AS DOUBLE)")
    + f"SELECT {{base}}, {fl('e', 'value')} FROM p JOIN (SELECT v, t, exp(l + lp) / sum(exp(l + lp)) OVER (PARTITION BY v) AS e FROM lk) k ON p.c_nationkey IS NOT DISTINCT FROM k.v WHERE t = 'BUILDING'", **_b,
)
pattern(
    "aggregate_nb", ORDERS_OF_CUSTOMERS, _c, _one,
    _NB.replace("{c}", "o_orderpriority").replace("{prior}", f"count(DISTINCT {ID}) / CAST((SELECT count(DISTINCT {ID}) FROM r) AS DOUBLE)")
    + f"SELECT {{base}}, {fl('e', 'value')} FROM (SELECT {{base}}, t, exp(s) / sum(exp(s)) OVER (PARTITION BY {{base}}) AS e FROM (SELECT {{base}}, t, sum(l) + max(lp) AS s FROM p JOIN lk ON p.o_orderpriority IS NOT DISTINCT FROM lk.v GROUP BY {{base}}, t)) WHERE t = 'BUILDING'", **_b,
)
BALANCES = Source(NUMERIC, _own(NUMERIC), ("customer",), f"SELECT c_custkey AS {ID}, c_acctbal AS {TARGET}, customer.* FROM customer")
pattern(
    "direct_affinity_loo", BALANCES, _nation, {"value": {"noise": 0.0}},
    f"SELECT {{base}}, {fl(f'coalesce((sum({TARGET}) OVER (PARTITION BY c_nationkey) - {TARGET}) / (count({TARGET}) OVER (PARTITION BY c_nationkey) - 0.99), 0.5)', 'value')} FROM {{p}} WHERE c_nationkey IS NOT NULL",
)


# Steps around the patterns.
def step(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def one_row(spark: SparkSession, **values: Any) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def _catalog(spark: SparkSession, sf_dir: str, s: Settings, *names: str) -> Catalog:
    return Catalog(tables(spark, sf_dir, *names), KEYS, s)


def base_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_ops.build_base(tables(spark, sf_dir, "orders")["orders"], TEMPORAL, warn=False).drop(base_ops.FOLD)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_ops.build_base(tables(spark, sf_dir, "customer")["customer"], STATIC, warn=False)
    return base_ops.sample_base(base, replace(STATIC, sample_count=50)).groupBy(TARGET).agg(F.count("*").alias("n"), F.countDistinct(ID).alias("ids"))


def regression_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_ops.build_base(tables(spark, sf_dir, "customer")["customer"], NUMERIC, warn=False)
    return base_ops.sample_base(base, replace(NUMERIC, sample_count=50)).agg(F.count("*").alias("n"), F.countDistinct(ID).alias("ids"))


def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether target tuples are unique, and keys of tables, and base ids of a propagated table."""
    t = tables(spark, sf_dir, "orders", "customer")
    return one_row(
        spark,
        target_tuple=base_ops.is_unique(t["orders"], ["o_custkey", "o_orderdate"]),
        order_key=base_ops.is_unique(t["orders"], ["o_orderkey"]),
        customer_key=base_ops.is_unique(t["customer"], ["c_custkey"]),
        base_id=base_ops.is_unique(ORDERS_OF_CUSTOMERS.make(t), [ID]),
    )


def propagate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ORDERS_OF_CUSTOMERS.make(tables(spark, sf_dir, "customer", "orders")).select(ID, TARGET, "o_orderkey", "o_orderstatus")


def propagate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HISTORY.make(tables(spark, sf_dir, "orders")).select(ID, DATE, TARGET, "o_orderkey")


def breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables in reach of customers, how far they are and how many rows they have beside the base."""
    catalog = _catalog(spark, sf_dir, STATIC)
    base = base_ops.build_base(catalog.tables["customer"].df, STATIC, warn=False)
    found = propagate_ops.propagate(base, catalog, persist=False)
    return spark.createDataFrame([(p.table, len(p.path) - 1, p.rows, p.is_target_id_unique) for p in found], "name string, depth int, n long, is_unique boolean")


def usable_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "orders", "lineitem")
    low, high = temporal_ops.date_range(base_ops.build_base(t["orders"], TEMPORAL, warn=False))
    s = replace(TEMPORAL, lag=30)
    n = temporal_ops.usable_rows(t["lineitem"], ["l_shipdate"], f"TIMESTAMP_NTZ'{low}'", f"TIMESTAMP_NTZ'{high}'", s)
    return one_row(spark, low=low, high=high, usable=n["l_shipdate"])


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    t = _catalog(spark, sf_dir, TEMPORAL, "orders").profile("orders", datetime(2000, 1, 1))
    c = t.columns["o_orderdate"]
    return one_row(spark, n=t.rows, has_null=c.has_null, has_future=c.has_future, low=c.low, high=c.high)


def temporal_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir, TEMPORAL, "orders", "lineitem", "customer")
    base = base_ops.build_base(catalog.tables["orders"].df, TEMPORAL, warn=False)
    rows = [(n, temporal_ops.find_constraint(catalog, n, base, unique)) for n, unique in (("lineitem", False), ("customer", True))]
    return spark.createDataFrame(rows, "name string, chosen string")


def pivot_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_ops.build_base(tables(spark, sf_dir, "orders")["orders"], TEMPORAL, warn=False)
    return one_row(spark, pivot=score.pivot_date(base, DATE))


def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top_values(tables(spark, sf_dir, "orders")["orders"], "o_orderpriority", 3)
    return spark.createDataFrame(rows, "value string, n long")


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_values(tables(spark, sf_dir, "customer")["customer"], "c_mktsegment")


def symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "nation")["nation"]
    mirrored = t.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    both = mirrored.unionByName(mirrored.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return one_row(spark, one_way=is_symmetric(mirrored, "a", "b"), both_ways=is_symmetric(both, "a", "b"))


_SCORED = ["o_orderpriority", "o_totalprice", "o_orderdate"]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SINGLE_ORDERS.make(tables(spark, sf_dir, "orders"))


def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_float(score.chi_square(_wide(spark, sf_dir), _SCORED, TARGET))


def r_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_float(score.r_square(BALANCES.make(tables(spark, sf_dir, "customer")), ["c_nationkey", "c_mktsegment"], TARGET))


def concept_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wide(spark, sf_dir)
    return as_float(score.concept_drift(df, _SCORED, TARGET, DATE, score.pivot_date(df, DATE)))


def weighted_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wide(spark, sf_dir)
    drift = score.concept_drift(df, _SCORED, TARGET, DATE, score.pivot_date(df, DATE))
    both = score.chi_square(df, _SCORED, TARGET).join(drift, "feature", "left")
    return as_float(both.select("feature", (F.col("relevance") * F.coalesce("drift", F.lit(1.0))).alias("weighted")))


def filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wide(spark, sf_dir)
    n, filled = score.counts(df, ["o_orderpriority", "o_totalprice"])
    return one_row(spark, n=n, **filled)


_CHOSEN = [
    expand.FeatureSpec("aggregate", "", "orders", (("numerical", X),), (("f", "avg"),), number=1),
    expand.FeatureSpec("distinct_count", "", "orders", (("nominal", "o_orderpriority"),), number=2),
    expand.FeatureSpec("aggregate_range", "", "orders", (("numerical", X),), number=3),
]


def main_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base with three features of its orders; customers without orders stay, with nulls."""
    t = tables(spark, sf_dir, "customer", "orders")
    base = base_ops.build_base(t["customer"], STATIC, warn=False)
    table = propagate_ops.Propagated("orders_of_customers", "orders", ORDERS_OF_CUSTOMERS.make(t), ("customer", "orders"))
    out = run_ops.main_sample(base, [table], [replace(x, table=table.name) for x in _CHOSEN], STATIC).drop(base_ops.FOLD)
    return as_float(out.withColumnsRenamed({x.name: n for x, n in zip(_CHOSEN, ("mean_price", "priorities", "price_range"), strict=True)}))


def _result(spark: SparkSession, sf_dir: str) -> run_ops.Result:
    t = tables(spark, sf_dir, "customer", "orders", "nation")
    library = [PATTERNS[n] for n in ("aggregate", "count", "entropy", "woe", "direct_field", "ratio", "change_count")]
    return run_ops.run(t, KEYS, replace(STATIC, predictor_max=20), library)


def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main sample that a run of seven patterns over three tables builds for the market segment, 20 features at most."""
    return _result(spark, sf_dir).main_sample(TARGET).drop(base_ops.FOLD)


def journal_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.journal import predictor_table

    got = _result(spark, sf_dir)
    return predictor_table(spark, got.journal, got.tables)


def journal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.journal import table_table

    catalog = _catalog(spark, sf_dir, STATIC, "customer", "orders", "nation")
    base = base_ops.build_base(catalog.tables["customer"].df, STATIC, warn=False)
    return table_table(spark, propagate_ops.propagate(base, catalog, persist=False))


def journal_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns of the library that have features in the tables in reach of customers."""
    from .plans.journal import pattern_table

    catalog = _catalog(spark, sf_dir, STATIC, "customer", "orders", "nation")
    base = base_ops.build_base(catalog.tables["customer"].df, STATIC, warn=False)
    specs = expand.expand(propagate_ops.propagate(base, catalog, persist=False), catalog)
    return pattern_table(spark, [PATTERNS[k] for k in sorted({x.pattern for x in specs})])


def journal_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the journal says of each propagated table, but for its clock and its texts."""
    return journal_table(spark, sf_dir).select(
        "original_name", "propagation_depth", "temporal_constraint", "candidate_temporal_count", "qc_row_count", "is_id_unique", "is_target_id_unique", "is_ok",
    )


def journal_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.journal import run_table

    got = _result(spark, sf_dir)
    return run_table(spark, STATIC, len(got.tables), got.journal, got.finish, got.run_time)


_SMALL = replace(STATIC, table_white=["customer", "orders"], column_white=[f"orders.{X}"], least_relevance=0.0)


def _small(spark: SparkSession, sf_dir: str) -> run_ops.Result:
    return run_ops.run(tables(spark, sf_dir, "customer", "orders"), KEYS, _SMALL, [PATTERNS["aggregate"], PATTERNS["count"], PATTERNS["aggregate_range"]])


def small_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of three patterns over one column, none of whose features is left out: its main sample."""
    got = _small(spark, sf_dir)
    names = {x.spec.name: "_".join([x.spec.pattern, *(str(v) for _, v in x.spec.params)]) for x in got.journal.all}
    return as_float(got.main_sample(TARGET).drop(base_ops.FOLD).withColumnsRenamed(names))


def small_run_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that run's journal says of each feature: rows, nulls and relevance."""
    from .plans.journal import predictor_table

    got = _small(spark, sf_dir)
    rows = predictor_table(spark, got.journal, got.tables)
    feature = F.concat_ws("_", "pattern_name", F.get_json_object("parameter_list", "$.f"))
    return rows.select(feature.alias("feature"), "table_name", "propagation_depth", "qc_row_count", "qc_null_count", "is_ok", "is_duplicate", "is_selected", "data_type", F.col(f"relevance_{TARGET}").cast("float").alias("relevance"))


def other_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns whose slot takes further kinds of columns, filled by the expansion: changes and repeats of a price, concentration of dates."""
    t = tables(spark, sf_dir, "customer", "orders")
    s = replace(STATIC, table_white=["customer", "orders"], column_white=[f"orders.{X}", f"orders.{D}"])
    df = ORDERS_OF_CUSTOMERS.make(t)
    table = propagate_ops.Propagated("orders_of_customers", "orders", df, ("customer", "orders"))
    library = [PATTERNS[n] for n in ("change_count", "change_ratio", "duplicate_ratio", "concentration")]
    specs = list(expand.expand([table], Catalog(t, KEYS, s), library))
    names = {x.name: "_".join([x.pattern, dict(x.columns)["nominal"]]) for x in specs}
    # Orders of one time follow each other by key.
    wide = fuse.fused(df, binding(ORDERS_OF_CUSTOMERS), [(x.name, x.part(s)) for x in specs], ["o_orderkey"])
    return as_float(wide.withColumnsRenamed(names))


_ONCE = "SELECT count(*) = count(DISTINCT {c}) FROM {t}"
step("base_table", base_table, _BASE_TEMPORAL)
step("stratified_sample", stratified_sample, f"SELECT c_mktsegment AS {TARGET}, least(count(*), 50) AS n, least(count(*), 50) AS ids FROM customer GROUP BY c_mktsegment")
step("regression_sample", regression_sample, "SELECT least(count(*), 50) AS n, least(count(*), 50) AS ids FROM customer")
step("uniqueness", uniqueness, f"SELECT (SELECT max(n) = 1 FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate)) AS target_tuple, ({_ONCE.format(c='o_orderkey', t='orders')}) AS order_key, ({_ONCE.format(c='c_custkey', t='customer')}) AS customer_key, (SELECT max(n) = 1 FROM (SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)) AS base_id")
step("propagate_id", propagate_id, f"SELECT {ID}, {TARGET}, o_orderkey, o_orderstatus FROM ({ORDERS_OF_CUSTOMERS.sql})")
step("propagate_window", propagate_window, f"SELECT {ID}, {DATE}, {TARGET}, o_orderkey FROM ({HISTORY.sql})")
_FROM = {"customer": "customer", "nation": "customer JOIN nation ON c_nationkey = n_nationkey", "orders": "customer JOIN orders ON o_custkey = c_custkey"}
_FROM |= {"region": f"{_FROM['nation']} JOIN region ON n_regionkey = r_regionkey", "supplier": f"{_FROM['nation']} JOIN supplier ON s_nationkey = n_nationkey", "lineitem": f"{_FROM['orders']} JOIN lineitem ON l_orderkey = o_orderkey"}
_FROM |= {"part": f"{_FROM['lineitem']} JOIN part ON l_partkey = p_partkey"}
_DEPTH = {"customer": 0, "nation": 1, "orders": 1, "region": 2, "supplier": 2, "lineitem": 2, "part": 3}
step("breadth_first", breadth_first, " UNION ALL ".join(f"SELECT '{t}' AS name, CAST({_DEPTH[t]} AS INTEGER) AS depth, count(*) AS n, count(*) = count(DISTINCT c_custkey) AS is_unique FROM {j}" for t, j in _FROM.items()))
step("usable_dates", usable_dates, f"WITH b AS (SELECT min({DATE}) AS low, max({DATE}) AS high FROM ({_BASE_TEMPORAL})) SELECT low, high, count(*) FILTER (WHERE l_shipdate + INTERVAL 1 DAY <= high AND l_shipdate + INTERVAL 31 DAY >= low) AS usable FROM lineitem, b GROUP BY low, high")
step("profile", profile, "SELECT count(*) AS n, count(*) > count(o_orderdate) AS has_null, max(o_orderdate) > TIMESTAMP '2000-01-01' AS has_future, epoch(min(o_orderdate)) AS low, epoch(max(o_orderdate)) AS high FROM orders")
step("temporal_constraint", temporal_constraint, "SELECT 'lineitem' AS name, 'l_shipdate' AS chosen UNION ALL SELECT 'customer', NULL")
step("pivot_date", pivot_date, f"SELECT (epoch(min({DATE})) + epoch(max({DATE}))) / 2 AS pivot FROM ({_BASE_TEMPORAL})")
step("top_values", frequent_values, "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority ORDER BY n DESC, value LIMIT 3")
step("unique_values", distinct_values, "SELECT DISTINCT c_mktsegment AS value FROM customer")
_MIRROR = "SELECT n_nationkey AS a, n_regionkey AS b FROM nation"
_BOTH = f"({_MIRROR} UNION ALL SELECT b, a FROM ({_MIRROR}))"
step("is_symmetric", symmetry, f"SELECT NOT EXISTS (SELECT a, b FROM ({_MIRROR}) EXCEPT SELECT b, a FROM ({_MIRROR})) AS one_way, NOT EXISTS (SELECT a, b FROM {_BOTH} EXCEPT SELECT b, a FROM {_BOTH}) AS both_ways")

_LONG = "SELECT '{f}' AS feature, {x} AS x, {y} AS y, {late} AS late FROM {t} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
_LATE = "o_orderdate > (SELECT make_timestamp(CAST(1000000 * (epoch(min(o_orderdate)) + epoch(max(o_orderdate))) / 2 AS BIGINT)) FROM orders)"


def _binned(epsilon: str) -> str:
    """(feature, bin, y, late, is_nominal) of the scored columns of orders."""
    text = _LONG.format(f="o_orderpriority", x="o_orderpriority", y="o_orderstatus", late=_LATE, t="orders")
    numbers = " UNION ALL ".join(_LONG.format(f=f, x=x, y="o_orderstatus", late=_LATE, t="orders") for f, x in (("o_totalprice", "o_totalprice"), ("o_orderdate", "epoch(o_orderdate)")))
    return f"SELECT feature, x AS bin, y, late, TRUE AS is_nominal FROM ({text}) UNION ALL SELECT feature, CAST(CAST(floor((x - lo) / ((hi - lo) / 10 + {epsilon})) AS BIGINT) AS VARCHAR), y, late, FALSE FROM (SELECT *, min(x) OVER (PARTITION BY feature) AS lo, max(x) OVER (PARTITION BY feature) AS hi FROM ({numbers}))"


_CHI = (
    f"WITH u AS ({_binned('1e-7')}), c AS (SELECT feature, is_nominal, bin, y, CAST(count(*) AS DOUBLE) AS o FROM u GROUP BY feature, is_nominal, bin, y), "
    "g AS (SELECT a.feature, a.is_nominal, a.bin, nb * ny / n AS e, coalesce(o, 0) AS o FROM (SELECT feature, is_nominal, bin, sum(o) AS nb FROM c GROUP BY feature, is_nominal, bin) a "
    "JOIN (SELECT feature, y, sum(o) AS ny, sum(sum(o)) OVER (PARTITION BY feature) AS n FROM c GROUP BY feature, y) b ON a.feature = b.feature LEFT JOIN c ON c.feature = a.feature AND c.bin = a.bin AND c.y = b.y) "
    "SELECT feature, {chi} AS relevance FROM g GROUP BY feature, is_nominal"
)
_CHI_VALUE = "sum((e - o) * (e - o) / e) / (CASE WHEN is_nominal THEN count(DISTINCT bin) ELSE 10 END)"
step("chi_square", chi_square, _CHI.replace("{chi}", f"CAST({_CHI_VALUE} AS FLOAT)"))
step(
    "r_square", r_square,
    "WITH u AS (SELECT 'c_nationkey' AS feature, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal AS y FROM customer UNION ALL SELECT 'c_mktsegment', avg(c_acctbal) OVER (PARTITION BY c_mktsegment), c_acctbal FROM customer) "
    "SELECT feature, CAST(coalesce(count(*) * power(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 2), 0) AS FLOAT) AS relevance FROM u WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY feature",
)
_DRIFT = (
    f"WITH u AS ({_binned('1e-8')}), c AS (SELECT feature, bin, y, CAST(count(*) FILTER (WHERE NOT late) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE late) AS DOUBLE) AS b FROM u GROUP BY feature, bin, y), "
    "s AS (SELECT feature, a / (sum(a) OVER (PARTITION BY feature, bin) + 1) AS p, b / (sum(b) OVER (PARTITION BY feature, bin) + 1) AS q FROM c) "
    "SELECT feature, {d} AS drift FROM s GROUP BY feature"
)
_DRIFT_VALUE = "sum(least(p, q)) / nullif(sum(greatest(p, q)), 0)"
step("concept_drift", concept_drift, _DRIFT.replace("{d}", f"CAST({_DRIFT_VALUE} AS FLOAT)"))
step("weighted_relevance", weighted_relevance, f"SELECT r.feature, CAST(r.relevance * d.drift AS FLOAT) AS weighted FROM ({_CHI.replace('{chi}', _CHI_VALUE)}) r JOIN ({_DRIFT.replace('{d}', _DRIFT_VALUE)}) d ON r.feature = d.feature")
step("filled_counts", filled_counts, "SELECT count(*) AS n, count(o_orderpriority) AS o_orderpriority, count(o_totalprice) AS o_totalprice FROM orders")
step(
    "main_sample", main_sample,
    f"SELECT c_custkey AS {ID}, c_mktsegment AS {TARGET}, {fl(f'avg({X})', 'mean_price')}, CAST(CASE WHEN count(o_orderkey) > 0 THEN count(DISTINCT o_orderpriority) END AS FLOAT) AS priorities, {fl(f'max({X}) - min({X})', 'price_range')} FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment",
)
_PRICES = f"SELECT c_custkey AS {ID}, c_mktsegment AS {TARGET}, {', '.join(f'{f}({X}) AS aggregate_{f}' for f in FUNCTIONS)}, CASE WHEN count(o_orderkey) > 0 THEN count(*) END AS count, max({X}) - min({X}) AS aggregate_range FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment"
_FEATURES = [*(f"aggregate_{f}" for f in FUNCTIONS), "count", "aggregate_range"]
step("small_run", small_run, f"SELECT {ID}, {TARGET}, {', '.join(fl(f, f) for f in _FEATURES)} FROM ({_PRICES})")
_LONG_PRICES = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, {TARGET} AS y, '{'bigint' if f == 'count' else 'double'}' AS data_type FROM ({_PRICES} HAVING count(o_orderkey) > 0)" for f in _FEATURES)
step(
    "small_run_journal", small_run_journal,
    f"WITH u AS ({_LONG_PRICES}), "
    "b AS (SELECT feature, y, CAST(floor((x - min(x) OVER (PARTITION BY feature)) / ((max(x) OVER (PARTITION BY feature) - min(x) OVER (PARTITION BY feature)) / 10 + 1e-7)) AS BIGINT) AS bin FROM u WHERE x IS NOT NULL AND y IS NOT NULL), "
    "c AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS o FROM b GROUP BY feature, bin, y), "
    "g AS (SELECT p.feature, nb * ny / n AS e, coalesce(o, 0) AS o FROM (SELECT feature, bin, sum(o) AS nb FROM c GROUP BY feature, bin) p JOIN (SELECT feature, y, sum(o) AS ny, sum(sum(o)) OVER (PARTITION BY feature) AS n FROM c GROUP BY feature, y) q ON p.feature = q.feature "
    "LEFT JOIN c ON c.feature = p.feature AND c.bin = p.bin AND c.y = q.y), "
    "r AS (SELECT feature, CAST(sum((e - o) * (e - o) / e) / 10 AS FLOAT) AS relevance FROM g GROUP BY feature) "
    "SELECT u.feature, 'orders' AS table_name, 1 AS propagation_depth, count(*) AS qc_row_count, count(*) - count(x) AS qc_null_count, 1 AS is_ok, 0 AS is_duplicate, 1 AS is_selected, data_type, any_value(relevance) AS relevance "
    "FROM u JOIN r ON r.feature = u.feature GROUP BY u.feature, data_type",
)
_BEFORE = f"lag({X}) OVER (PARTITION BY {ID} ORDER BY {D}, o_orderkey)"
step(
    "other_kinds", other_kinds,
    f"WITH p AS ({ORDERS_OF_CUSTOMERS.sql}), l AS (SELECT *, {_BEFORE} AS before, lag({D}) OVER (PARTITION BY {ID} ORDER BY {D}, o_orderkey) AS day_before FROM p), "
    f"a AS (SELECT {ID}, {TARGET}, {fl(f'count(*) FILTER (WHERE before <> {X})', f'change_count_{X}')}, {fl(f'(count(*) FILTER (WHERE before < {X}) + 1) / CAST(count(*) FILTER (WHERE before > {X}) + 1 AS DOUBLE)', f'change_ratio_{X}')} FROM l GROUP BY {ID}, {TARGET}), "
    f"d AS (SELECT {ID}, {fl('coalesce(sum(n) FILTER (WHERE n >= 2), 0) / sum(n)', f'duplicate_ratio_{X}')} FROM (SELECT {ID}, {X} AS v, count(*) AS n FROM p GROUP BY {ID}, {X}) GROUP BY {ID}), "
    f"c AS (SELECT {ID}, {fl('100 * max(n) FILTER (WHERE v IS NOT NULL) / sum(n) FILTER (WHERE v IS NOT NULL)', f'concentration_{D}')} FROM (SELECT {ID}, {D} AS v, count(*) AS n FROM p GROUP BY {ID}, {D}) GROUP BY {ID}) "
    f"SELECT a.*, d.duplicate_ratio_{X}, c.concentration_{D} FROM a JOIN d ON d.{ID} = a.{ID} JOIN c ON c.{ID} = a.{ID}",
)
# Whole runs and journals have names and ranks that SQL has no account of: rows only.
step("full_run", full_run, None)
step("journal_predictor", journal_predictor, None)
step("journal_table", journal_table, None)
step("journal_pattern", journal_pattern, None)
_LED_TO = {"customer": "c_custkey", "nation": "n_nationkey", "orders": "o_custkey"}
step(
    "journal_table_counts", journal_table_counts,
    " UNION ALL ".join(
        f"SELECT '{t}' AS original_name, CAST({_DEPTH[t]} AS INTEGER) AS propagation_depth, CAST(NULL AS VARCHAR) AS temporal_constraint, {n} AS candidate_temporal_count, (SELECT count(*) FROM {_FROM[t]}) AS qc_row_count, "
        + ("0" if t == "customer" else f"(SELECT CAST(count(*) = count(DISTINCT {_LED_TO[t]}) AS INTEGER) FROM {t})") + f" AS is_id_unique, (SELECT CAST(count(*) = count(DISTINCT c_custkey) AS INTEGER) FROM {_FROM[t]}) AS is_target_id_unique, 1 AS is_ok"
        for t, n in (("customer", 0), ("nation", 0), ("orders", 1))
    ),
)
step("journal_run", journal_run, None)


def journal_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time columns that may bound a table, the rows that each leaves usable, and which is chosen."""
    from .plans.journal import temporal_table

    catalog = _catalog(spark, sf_dir, TEMPORAL, "orders", "lineitem")
    base = base_ops.build_base(catalog.tables["orders"].df, TEMPORAL, warn=False)
    low, high = temporal_ops.date_range(base)
    rows = []
    for name in ("lineitem", "orders"):
        columns = catalog.tables[name].of_kind("temporal")
        usable = temporal_ops.usable_rows(catalog.tables[name].df, columns, f"TIMESTAMP_NTZ'{low}'", f"TIMESTAMP_NTZ'{high}'", TEMPORAL)
        chosen = temporal_ops.find_constraint(catalog, name, base, False)
        rows += [(name, c, usable[c], c == chosen) for c in columns]
    return temporal_table(spark, rows)


_USABLE = f"SELECT '{{t}}' AS \"table\", '{{c}}' AS \"column\", count(*) FILTER (WHERE {{c}} + INTERVAL 1 DAY <= high AND {{c}} + INTERVAL 3651 DAY >= low) AS usable_rows, TRUE AS is_chosen FROM {{t}}, (SELECT min({DATE}) AS low, max({DATE}) AS high FROM ({_BASE_TEMPORAL}))"
step("journal_temporal", journal_temporal, " UNION ALL ".join(_USABLE.format(t=t, c=c) for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"))))
