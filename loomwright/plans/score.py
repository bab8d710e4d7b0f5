"""How well features tell the target: chi-square, R squared and stability over time.

Features are scored in bulk. One pass gives counts and extremes of all of them. Another unpivots
the wide table into a cube: how many rows each feature has by bin, class of each target and half
of the time, counted before they are shuffled. Chi-square and drift of every target are sums
over the cube.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import epoch, quoted

BINS = 10
#: Extremes by feature and target.
Ends = dict[tuple[str, str], tuple[float, float]]
#: Tables of counts with no more rows than this are broadcast.
MOST_BROADCAST_ROWS = 200_000


def is_nominal(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType | T.BooleanType)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.DateType | T.TimestampType | T.TimestampNTZType)


def as_number(df: DataFrame, name: str) -> Column:
    return F.expr(epoch(quoted(name))) if is_temporal(df.schema[name].dataType) else F.col(quoted(name)).cast("double")


def long_form(df: DataFrame, features: Iterable[str], keep: list[str], nominal: bool) -> DataFrame:
    """(keep..., feature, value) rows of the nominal (text) or of the other (double) features; nulls are left out."""
    names = [f for f in features if is_nominal(df.schema[f].dataType) == nominal]
    if not names:
        return df.select(*keep, F.lit("").alias("feature"), F.lit("" if nominal else 0.0).alias("value")).limit(0)
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), (F.col(quoted(n)).cast("string") if nominal else as_number(df, n)).alias("value")) for n in names))
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value").filter("value IS NOT NULL" if nominal else "value IS NOT NULL AND NOT isnan(value)")


def facts(df: DataFrame, features: Iterable[str], targets: Iterable[str]) -> tuple[int, dict[str, int], Ends]:
    """Rows, rows with a value by feature, and each numeric feature's extremes among the rows that have a target; one job."""
    features, targets = list(features), list(targets)
    exprs = [F.count("*").alias("n"), *(F.count(F.col(quoted(f))).alias(f"c{k}") for k, f in enumerate(features))]
    for k, f in enumerate(features):
        if not is_nominal(df.schema[f].dataType):
            x = as_number(df, f)
            for j, t in enumerate(targets):
                known = F.when(F.col(quoted(t)).isNotNull() & ~F.isnan(x), x)
                exprs += [F.min(known).alias(f"lo{k}_{j}"), F.max(known).alias(f"hi{k}_{j}")]
    got = df.agg(*exprs).first().asDict()
    ends = {(f, t): (got[f"lo{k}_{j}"], got[f"hi{k}_{j}"]) for k, f in enumerate(features) for j, t in enumerate(targets) if got.get(f"lo{k}_{j}") is not None}
    return got["n"], {f: got[f"c{k}"] for k, f in enumerate(features)}, ends


def _bin(x: Column, ends: tuple[float, float] | None, epsilon: float) -> Column:
    """The number of the equal-width bin between the extremes; null without a value."""
    if ends is None:
        return F.lit(None).cast("long")
    low, high = (F.lit(float(e)) for e in ends)
    return F.when(~F.isnan(x), F.floor((x - low) / ((high - low) / BINS + epsilon)))


def cube(df: DataFrame, features: Iterable[str], targets: Iterable[str], ends: Ends, late: Column | None = None) -> DataFrame:
    """(feature, nominal, b<k>, d<k>, y<k> of the k-th target, late, o): rows by bins and classes, of rows with a value.

    Nominal features have a bin for each value, others ten of equal width; those of drift, d<k>,
    differ from those of chi-square by what keeps the last one open. Without late there is no d<k>.
    """
    features, targets = list(features), list(targets)
    kinds = [("b", 1e-7), *([("d", 1e-8)] if late is not None else [])]
    bins = [f"{b}{k}" for k in range(len(targets)) for b, _ in kinds]

    # Features and bins are numbers until rows are counted, texts then: there are far fewer.
    def one(number: int, f: str) -> Column:
        nominal = is_nominal(df.schema[f].dataType)
        text = F.col(quoted(f)).cast("string") if nominal else F.lit(None).cast("string")
        x = None if nominal else as_number(df, f)
        places = [(F.lit(None).cast("long") if nominal else _bin(x, ends.get((f, t)), e)).alias(f"{b}{k}") for k, t in enumerate(targets) for b, e in kinds]
        return F.struct(F.lit(number).alias("feature"), text.alias("text"), *places)

    keep = [F.col(quoted(t)).alias(f"y{k}") for k, t in enumerate(targets)] + ([late.alias("late")] if late is not None else [])
    rows = df.select(*keep, F.explode(F.array(*(one(n, f) for n, f in enumerate(features)))).alias("p")).select("*", "p.*").drop("p")
    rows = rows.filter(" OR ".join(f"{b} IS NOT NULL" for b in ["text", *bins]))
    more = [*(f"y{k}" for k in range(len(targets))), *(["late"] if late is not None else [])]
    cells = rows.groupBy("feature", "text", *bins, *more).agg(F.count("*").alias("o"))
    named = F.array(*(F.struct(F.lit(f).alias("name"), F.lit(is_nominal(df.schema[f].dataType)).alias("nominal")) for f in features))
    return cells.withColumn("_f", named[F.col("feature")]).select(
        F.col("_f.name").alias("feature"), F.col("_f.nominal").alias("nominal"), *(F.coalesce("text", F.col(b).cast("string")).alias(b) for b in bins), *more, "o"
    )


def chi_square(df: DataFrame, features: Iterable[str], target: str) -> DataFrame:
    """(feature, relevance): chi-square of bins by classes, divided by the number of bins.

    Nominal features have a bin for each value; others ten of equal width, and are divided by
    ten. Rows without value or target do not count.
    """
    features = list(features)
    cells = cube(df, features, [target], facts(df, features, [target])[2])
    return chi_of(cells, 0, few_classes(df, target, len(features)))


def chi_of(cells: DataFrame, k: int, few: bool) -> DataFrame:
    """Chi-square for the k-th target of a cube; few says whether its classes are."""
    cells = cells.filter(f"y{k} IS NOT NULL AND b{k} IS NOT NULL").groupBy("feature", "nominal", F.col(f"b{k}").alias("bin"), F.col(f"y{k}").alias("y")).agg(F.sum("o").alias("o"))
    by_class = cells.groupBy("feature", "y").agg(F.sum("o").alias("n_y"))
    if few:
        by_class = F.broadcast(by_class)
    # Over all bins and classes, empty cells too, the sum of (o - e)^2 / e with e = n_bin * n_y / n is n * sum(o^2 / (n_bin * n_y)) - n: cells that hold rows are enough.
    parts = cells.join(by_class, ["feature", "y"]).groupBy("feature", "nominal", "bin").agg(F.sum(F.col("o") * F.col("o") / F.col("n_y")).alias("s"), F.sum("o").alias("n_bin"))
    out = parts.groupBy("feature", "nominal").agg(F.sum(F.col("s") / F.col("n_bin")).alias("s"), F.sum("n_bin").alias("n"), F.count("*").alias("bins"))
    chi2 = F.greatest(F.col("n") * (F.col("s") - 1), F.lit(0.0))
    return out.select("feature", (chi2 / F.when(F.col("nominal"), F.col("bins")).otherwise(BINS)).alias("relevance"))


def few_classes(df: DataFrame, target: str, features: int) -> bool:
    """Whether a row for each feature and class may be broadcast, by a count of the classes."""
    most = MOST_BROADCAST_ROWS // max(1, features)
    return df.select(target).distinct().limit(most + 1).count() <= most


def r_square(df: DataFrame, features: Iterable[str], target: str) -> DataFrame:
    """(feature, relevance): rows times squared correlation with a numeric target; 0 where it's undefined.

    Nominal features stand for the mean target of their value. Of these only one row a value
    is looked at after the first aggregation: their squared correlation is the share of the
    target's variance that lies between values.
    """
    features = list(features)
    known = df.select("*", as_number(df, target).alias("_y")).filter("_y IS NOT NULL")
    groups = long_form(known, features, ["_y"], True).groupBy("feature", "value").agg(F.count("*").alias("n"), F.avg("_y").alias("x"), (F.var_pop("_y") * F.count("*")).alias("within"))
    middle = groups.groupBy("feature").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m"))
    groups = groups.join(F.broadcast(middle), "feature")  # one row a feature
    between = F.sum(F.col("n") * (F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))
    nominal = groups.groupBy("feature").agg(F.sum("n").alias("n"), between.alias("b"), F.sum("within").alias("w"))
    nominal = nominal.select("feature", F.coalesce(F.col("n") * F.col("b") / F.nullif(F.col("b") + F.col("w"), F.lit(0.0)), F.lit(0.0)).alias("relevance"))
    spread = F.stddev_pop("value") * F.stddev_pop("_y")
    got = long_form(known, features, ["_y"], False).groupBy("feature").agg(F.count("*").alias("n"), F.covar_pop("value", "_y").alias("c"), spread.alias("s"))
    r = F.col("c") / F.nullif(F.col("s"), F.lit(0.0))
    return nominal.unionByName(got.select("feature", F.coalesce(F.col("n") * r * r, F.lit(0.0)).alias("relevance")))


def pivot_date(base: DataFrame, date: str) -> float:
    """The middle of the base dates' range, in seconds."""
    lo, hi = base.agg(F.expr(f"min({epoch(quoted(date))})"), F.expr(f"max({epoch(quoted(date))})")).first()
    return (lo + hi) / 2 if lo is not None else 0.0


def is_late(date: str, pivot: float) -> Column:
    return F.expr(f"{epoch(quoted(date))} > {pivot!r}D")


def concept_drift(df: DataFrame, features: Iterable[str], target: str, date: str, pivot: float) -> DataFrame:
    """(feature, drift): likeness, 1 at most, of P(class | bin) before and after the pivot: sum of minima over sum of maxima."""
    features = list(features)
    return drift_of(cube(df, features, [target], facts(df, features, [target])[2], is_late(date, pivot)), 0)


def drift_of(cells: DataFrame, k: int) -> DataFrame:
    """Drift for the k-th target of a cube."""
    early, late = F.sum(F.when(F.col("late"), 0).otherwise(F.col("o"))), F.sum(F.when(F.col("late"), F.col("o")).otherwise(0))
    cells = cells.filter(f"y{k} IS NOT NULL AND d{k} IS NOT NULL").groupBy("feature", F.col(f"d{k}").alias("bin"), F.col(f"y{k}").alias("y")).agg(early.alias("a"), late.alias("b"))
    w = Window.partitionBy("feature", "bin")
    shares = cells.select("feature", (F.col("a") / (F.sum("a").over(w) + 1)).alias("p"), (F.col("b") / (F.sum("b").over(w) + 1)).alias("q"))
    return shares.groupBy("feature").agg((F.sum(F.least("p", "q")) / F.nullif(F.sum(F.greatest("p", "q")), F.lit(0.0))).alias("drift"))


def counts(df: DataFrame, features: Iterable[str]) -> tuple[int, dict[str, int]]:
    """How many rows there are, and how many of each feature aren't null; one job."""
    features = list(features)
    got = df.agg(F.count("*").alias("n"), *(F.count(F.col(quoted(f))).alias(f"c{k}") for k, f in enumerate(features))).first()
    return got["n"], {f: got[f"c{k}"] for k, f in enumerate(features)}
