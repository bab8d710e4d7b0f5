"""The base table: one row for each thing to predict."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import CLASSIFICATION, Settings


def id_name(k: int) -> str:
    return f"propagated_id{k + 1}"


def target_name(k: int) -> str:
    return f"propagated_target{k + 1}"


DATE, FOLD = "propagated_date", "propagated_fold"


def base_ids(s: Settings) -> list[str]:
    return [id_name(k) for k in range(len(s.target_ids))]


def base_targets(s: Settings) -> list[str]:
    return [target_name(k) for k in range(len(s.targets))]


def base_keys(s: Settings) -> list[str]:
    return [*base_ids(s), *([DATE] if s.target_date else [])]


def seeded(columns: list[str], seed: int) -> Column:
    """A hash that stands for a random number: the same on each run."""
    return F.xxhash64(*columns, F.lit(seed))


def is_unique(df: DataFrame, columns: list[str]) -> bool:
    """Whether no two rows agree in the columns; nulls agree with each other."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key no other row has: of repeated keys all rows go."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def build_base(table: DataFrame, s: Settings, warn: bool = True) -> DataFrame:
    """Ids, date, targets and a fold from the target table.

    Rows without a date go; so do all rows of a repeated key. The fold is a seeded hash.
    """
    columns = [F.col(c).alias(id_name(k)) for k, c in enumerate(s.target_ids)]
    if s.target_date:
        columns.append(F.col(s.target_date).alias(DATE))
    columns += [F.col(c).alias(target_name(k)) for k, c in enumerate(s.targets)]
    base = table.select(*columns)
    if s.target_date:
        base = base.filter(F.col(DATE).isNotNull())
    unique = warn and is_unique(base, base_keys(s))
    if warn and not unique:
        warnings.warn(f"{s.target_table}: rows of repeated keys are left out", stacklevel=2)
    # Either way rows are dealt by key: a table of few narrow columns is read in few tasks.
    base = base.repartition(*base_keys(s)) if unique else unique_keys(base, base_keys(s))
    return base.withColumn(FOLD, F.pmod(seeded(base_keys(s), s.seed), F.lit(s.folds)).cast("int"))


def sample_base(base: DataFrame, s: Settings) -> DataFrame:
    """At most sample_count rows of each class of the first target (null is one), or of all in regression; picked by hash."""
    if s.sample_count is None:
        return base
    order = [seeded(base_keys(s), s.seed + 1), *base_keys(s)]
    if s.task == CLASSIFICATION:
        place = F.row_number().over(Window.partitionBy(target_name(0)).orderBy(*order))
        return base.withColumn("_k", place).filter(F.col("_k") <= s.sample_count).drop("_k")
    return base.orderBy(*order).limit(s.sample_count)
