"""Patterns that condense the many rows of a base row into one number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import Binding, Pattern, Quantile, Sweep, Within, agg, counts, frame, lag, register

FUNCTIONS = ("stddev_samp", "avg", "min", "max", "sum")
#: x and t of rows that have both.
_X = "CASE WHEN {temporal} IS NOT NULL THEN {numerical} END"
_T = "CASE WHEN {numerical} IS NOT NULL THEN {temporal} END"

agg("Aggregate", ("numerical",), "{f}({numerical})", params={"f": FUNCTIONS})
agg("Aggregate distinct", ("numerical",), "{f}(DISTINCT {numerical})", params={"f": ("stddev_samp", "avg", "sum")})
agg("Aggregate range", ("numerical",), "max({numerical}) - min({numerical})")
register(Pattern(
    "Aggregate frame", "n", ("numerical", "date"),
    lambda b: Within(b.params["f"], b.number("numerical"), b.sql("({base_date} - {date}) / 86400"), round(b.params["lead_fraction"] * b.params["lag"], 9), float(b.params["lag"])),
    params={"f": FUNCTIONS}, sweeps={"lag": Sweep(30, 240, 4, True), "lead_fraction": Sweep(0.2, 0.8, 4)}, needs_date=True,
    description="{f} of {numerical} over rows whose age in days is between {lead_fraction} * {lag} and {lag}",
))
agg(
    "Aggregate subgroup", ("nominal", "numerical"), "{f}(CASE WHEN {nominal} = {value} THEN {numerical} END)",
    having="count(CASE WHEN {nominal} = {value} THEN 1 END) > 0", params={"f": FUNCTIONS}, needs_value=True,
)
agg("Aggregate text length", ("character",), "{f}(CAST(char_length({character}) AS DOUBLE))", params={"f": FUNCTIONS[:4]})
agg("Coefficient of variation", ("numerical",), "stddev_samp({numerical}) / nullif(avg({numerical}), 0)")
agg("Correlation", ("numerical", "temporal"), f"covar_pop({_X}, {_T}) / nullif(stddev_pop({_X}) * stddev_pop({_T}), 0)")
agg("Count", (), "count(*)")
agg("Distinct count", ("nominal",), "count(DISTINCT {nominal})")
agg("Entropy continuous", ("numerical",), "ln(sum({x})) - sum({x} * ln({x})) / sum({x})".replace("{x}", "CASE WHEN {numerical} > 0 THEN {numerical} END"))
agg("Existential count", ("nominal",), "sum(CASE WHEN {nominal} = {value} THEN 1 ELSE 0 END)", needs_value=True)
agg("Geometric mean", ("number",), "exp(avg(CASE WHEN {number} > 0 THEN ln({number}) END))", having="count(CASE WHEN {number} > 0 THEN 1 END) > 0")
agg("Harmonic mean", ("numerical",), "count(nullif({numerical}, 0)) / nullif(sum(1 / nullif({numerical}, 0)), 0)", having="count(nullif({numerical}, 0)) > 0")
agg("Slope", ("numerical", "temporal"), f"covar_pop({_X}, {_T}) / nullif(var_pop({_T}), 0)")
agg("Intercept", ("numerical", "temporal"), f"avg({_X}) - covar_pop({_X}, {_T}) / nullif(var_pop({_T}), 0) * avg({_T})")
agg("Log product", ("numerical",), "sum(CASE WHEN {numerical} > -1 THEN ln({numerical} + 1) END)")
agg("Null ratio", ("any",), "avg(CASE WHEN {any} IS NULL THEN 1.0D ELSE 0.0D END)")
register(Pattern(
    "Percentile", "n", ("numerical",), lambda b: Quantile(b.number("numerical"), b.params["p"]),
    params={"p": (0.05, 0.5, 0.95)}, description="percentile_cont({p}) WITHIN GROUP (ORDER BY {numerical})",
))
agg(
    "Skewness", ("numerical",),
    "CASE WHEN stddev_samp({numerical}) > 0 AND count({numerical}) = 2 THEN 0.0D WHEN stddev_samp({numerical}) > 0 THEN skewness({numerical}) * power((count({numerical}) - 1) / count({numerical}), 1.5D) END",
    having="stddev_samp({numerical}) > 0",
)
agg(
    "Product", ("numerical",),
    "CASE WHEN min(abs({numerical})) = 0 THEN 0.0D ELSE (CASE WHEN count(CASE WHEN {numerical} < 0 THEN 1 END) % 2 = 1 THEN -1 ELSE 1 END) * exp(sum(ln(abs(nullif({numerical}, 0))))) END",
    experimental=True,
)

agg("Time aggregate", ("temporal",), "{f}({temporal})", params={"f": FUNCTIONS})
agg("Time aggregate since", ("temporal",), "{f}(({base_date} - {temporal}) / 86400)", params={"f": ("min", "max", "avg", "stddev_samp")}, needs_date=True)
agg(
    "Time aggregate since event", ("nominal", "temporal"), "{f}(CASE WHEN {nominal} = {value} THEN ({base_date} - {temporal}) / 86400 END)",
    having="count(CASE WHEN {nominal} = {value} THEN 1 END) > 0", params={"f": ("min", "max", "avg", "stddev_samp")}, needs_date=True, needs_value=True,
)
agg("Time frequency", ("temporal",), "count(*) / (max({temporal}) - min({temporal}) + 1)")
agg("Time range", ("temporal",), "(max({temporal}) - min({temporal})) / 86400")
#: The latest of the times at which the number is extreme.
_BOTH = "{numerical} IS NOT NULL AND {temporal} IS NOT NULL"
_PEAK = {
    "DESC": f"max(CASE WHEN {_BOTH} THEN named_struct('x', {{numerical}}, 't', {{temporal}}) END).t",
    "ASC": f"-min(CASE WHEN {_BOTH} THEN named_struct('x', {{numerical}}, 't', -{{temporal}}) END).t",
}


def _peak(name: str, template: str, **more) -> None:
    from .registry import Agg

    def build(b: Binding) -> Agg:
        return Agg(b.sql(template, peak=b.sql(_PEAK[b.params["order"]])), b.sql(f"count(CASE WHEN {_BOTH} THEN 1 END) > 0"))

    register(Pattern(name, "n", ("numerical", "temporal"), build, params={"order": ("DESC", "ASC")}, **more))


_peak("Time of peak", "{peak}")
_peak("Time from peak", "({base_date} - ({peak})) / 86400", needs_date=True)

lag("Change count", ("nominal", "temporal"), ("{nominal}",), "sum(CASE WHEN {prev_0} <> {nominal} THEN 1 ELSE 0 END)", also={"nominal": ("numerical",)})
lag("Change ratio", ("nominal", "temporal"), ("{nominal}",), "(sum(CASE WHEN {prev_0} < {nominal} THEN 1 ELSE 0 END) + 1) / (sum(CASE WHEN {prev_0} > {nominal} THEN 1 ELSE 0 END) + 1)", also={"nominal": ("numerical",)})
lag("Integral", ("numerical", "temporal"), ("{numerical}", "{temporal}"), "sum(({numerical} + {prev_0}) * ({temporal} - {prev_1}) / 2)")
lag("Zero crossing", ("numerical", "temporal"), ("{numerical}",), "sum(CASE WHEN sign({numerical}) <> sign({prev_0}) THEN 1 ELSE 0 END)")

counts("Concentration", "nominal", "100.0D * max(CASE WHEN v IS NOT NULL THEN n END) / nullif(sum(CASE WHEN v IS NOT NULL THEN n END), 0)", also={"nominal": ("date",)})
counts("Duplicate ratio", "nominal", "sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n)", also={"nominal": ("numerical",)})
counts("Entropy", "nominal", "ln(sum(n)) - sum(n * ln(n)) / sum(n)")
counts("Mode", "nominal", "min(CASE WHEN v IS NOT NULL THEN named_struct('n', -n, 'v', v) END).v")


def _robust(df: DataFrame, b: Binding) -> DataFrame:
    """The n-th lowest or highest value, or the last there is. A ranked window keeps n rows of a group, not all."""
    up = b.params["order"] == "ASC"
    x = F.expr(b.number("numerical"))
    place = F.row_number().over(Window.partitionBy(*b.base).orderBy(F.col("_x").asc() if up else F.col("_x").desc()))
    rows = df.select(*b.base, x.alias("_x")).filter("_x IS NOT NULL").withColumn("_k", place).filter(F.col("_k") <= b.params["nth"])
    return rows.groupBy(*b.base).agg((F.max if up else F.min)("_x").alias("value"))


frame("Aggregate robust", "n", ("numerical",), _robust, params={"order": ("ASC", "DESC"), "nth": (2, 3)})


def _mad(df: DataFrame, b: Binding) -> DataFrame:
    """Mean distance from the mean: window and aggregation share one shuffle."""
    rows = df.select(*b.base, F.expr(b.number("numerical")).alias("_x"))
    rows = rows.withColumn("_m", F.avg("_x").over(Window.partitionBy(*b.base)))
    return rows.groupBy(*b.base).agg(F.avg(F.abs(F.col("_x") - F.col("_m"))).alias("value"))


frame("Mean absolute difference", "n", ("numerical",), _mad)
