"""The journal: scored features, ranked for each target; duplicates, variants and worthless ones left out."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import PATTERNS, Pattern
from ..operators.propagate import Propagated
from ..settings import Settings
from .expand import FeatureSpec


@dataclass
class Relevance:
    relevance: float = 0.0
    drift: float = 1.0

    @property
    def weighted(self) -> float:
        return self.relevance * self.drift


@dataclass
class Scored:
    """A feature with what is known of it once it's been computed."""

    spec: FeatureSpec
    relevance: dict[str, Relevance] = field(default_factory=dict)
    rows: int = 0
    nulls: int = 0
    ok: bool = True
    state: int = 1  # candidates with a higher state go first
    start: datetime | None = None
    run_time: float = 0.0  # seconds, its share of the features computed with it
    data_type: str = ""
    category: str = ""  # nominal, numerical or temporal
    exception: str = ""  # why it could not be computed
    duplicate_of: str = ""  # name of the good feature before it that has the same scores and counts

    def weighted(self, target: str) -> float:
        return self.relevance[target].weighted if target in self.relevance else 0.0


def order(target: str):
    """Best first: state, weighted relevance, then the older feature."""
    return lambda x: (-x.state, -x.weighted(target), x.spec.number)


class Journal:
    """Keeps the best features of each target, at most ``most``."""

    def __init__(self, targets: Iterable[str], most: int, least: float = 1e-4):
        self.targets, self.most, self.least = list(targets), most, least
        self.top: dict[str, list[Scored]] = {t: [] for t in self.targets}
        self.all: list[Scored] = []
        self._seen: dict[tuple, Scored] = {}  # the first good feature of each signature, kept or not

    def add(self, x: Scored) -> bool:
        """Whether the feature is among the best of a target, for now."""
        self.all.append(x)
        if not x.ok or self._is_value_duplicate(x):
            return False
        kept = False
        for t in [x.spec.target] if x.spec.target else self.targets:
            if x.weighted(t) < self.least:
                continue
            twin = next((y for y in self.top[t] if x.spec.group and y.spec.group == x.spec.group), None)
            if twin is not None:
                if order(t)(twin) <= order(t)(x):
                    continue
                self.top[t].remove(twin)
            self.top[t].append(x)
            self.top[t].sort(key=order(t))
            if len(self.top[t]) > self.most:
                kept |= self.top[t].pop() is not x
            else:
                kept = True
        return kept

    def _is_value_duplicate(self, x: Scored) -> bool:
        """Whether a good feature before, kept or not, has the same scores and counts: the same values, most likely."""
        first = self._seen.setdefault(self._signature(x), x)
        if first.spec.number == x.spec.number:
            return False
        x.duplicate_of = first.spec.name
        return True

    @staticmethod
    def _signature(x: Scored) -> tuple:
        return x.rows, x.nulls, tuple(sorted((t, round(r.relevance, 9), round(r.drift, 9)) for t, r in x.relevance.items()))

    def best(self) -> list[Scored]:
        """The best of all targets, each once, by number."""
        return sorted({x.spec.number: x for top in self.top.values() for x in top}.values(), key=lambda x: x.spec.number)

    def ranked(self) -> list[Scored]:
        """The best of all targets, each once, those first that weigh most for any target."""
        return sorted(self.best(), key=lambda x: (-x.state, -max(x.weighted(t) for t in self.targets), x.spec.number))

    def of(self, target: str) -> list[Scored]:
        return list(self.top[target])

    def failed_patterns(self) -> list[str]:
        """Patterns of which no feature was good."""
        good = {x.spec.pattern for x in self.all if x.ok}
        return sorted({x.spec.pattern for x in self.all} - good)


def to_json(features: Iterable[Scored]) -> str:
    """The specs, for a second stage or another day."""
    return json.dumps([asdict(x.spec) for x in features], indent=1, default=str)


def from_json(text: str) -> list[FeatureSpec]:
    pairs = lambda v: tuple((k, x) for k, x in v)
    return [FeatureSpec(**{**x, "columns": pairs(x["columns"]), "params": pairs(x["params"])}) for x in json.loads(text)]


# Columns of the journals, as other tools read them.
PREDICTORS = (
    "predictor_id long, group_id string, start_time timestamp, run_time double, predictor_name string, predictor_long_name string, table_name string, column_list string, propagation_table_name string, propagation_path string,"
    " propagation_depth int, date_constraint string, parameter_list string, pattern_name string, pattern_author string, pattern_code string, sql_code string, data_type string, category_type string, qc_row_count long, qc_null_count long,"
    " exception_message string, is_ok int, is_duplicate int, duplicate_name string, used_target_column string"
)
TABLES = (
    "table_id int, start_time timestamp, run_time double, table_name string, original_name string, temporal_constraint string, temporal_constraint_reasoning string, candidate_temporal_list string, candidate_temporal_count int,"
    " row_count_optimistic long, propagation_path string, propagation_depth int, propagation_id string, sql_code string, is_id_unique int, is_target_id_unique int, qc_successfully_executed int, qc_row_count long, is_ok int"
)
PATTERN_TABLE = "name string, author string, is_aggregate int, is_multivariate int, is_nominal int, is_numerical int, is_temporal int, uses_base_target int, uses_base_date int, description string"
RUNS = "finish_time timestamp, schema_name string, run_time double, memory double, warn_count int, error_count int, predictor_count int, predictor_output_count int, propagated_table_count int, setting string"
TEMPORAL = "table string, column string, usable_rows long, is_chosen boolean"


def predictor_table(spark: SparkSession, journal: Journal, tables: Iterable[Propagated] = ()) -> DataFrame:
    """One row a feature, with relevance, drift and weighted relevance for each target, and whether it is in a main sample."""
    schema = T.StructType.fromDDL(PREDICTORS)
    for t in journal.targets:
        for what in ("relevance", "concept_drift", "weighted_relevance"):
            schema = schema.add(f"{what}_{t}", T.DoubleType())
    schema = schema.add("is_selected", T.IntegerType())
    of_name = {t.name: t for t in tables}
    selected = {x.spec.number for x in journal.best()}
    rows = []
    for x in journal.all:
        y, at, p = x.spec, of_name.get(x.spec.table), PATTERNS.get(x.spec.pattern)
        row: list[Any] = [
            y.number, y.group or None, x.start, x.run_time, y.name, y.long_name, y.original, json.dumps(dict(y.columns)), y.table, "/".join(at.path) if at else None,
            len(at.path) - 1 if at else None, at.temporal if at else None, json.dumps(dict(y.params), default=str), y.pattern, p.author if p else None, p.description if p else None, _code(y), x.data_type or None, x.category or None, x.rows, x.nulls,
            x.exception or None, int(x.ok), int(bool(x.duplicate_of)), x.duplicate_of or None, y.target,
        ]
        for t in journal.targets:
            r = x.relevance.get(t)
            row += [float(r.relevance), float(r.drift), float(r.weighted)] if r else [None] * 3
        rows.append((*row, int(y.number in selected)))
    return spark.createDataFrame(rows, schema)


def _code(spec: FeatureSpec) -> str:
    """The feature as a pattern with all its names and parameters filled in."""
    filled = ", ".join(f"{k}={v}" for k, v in (*spec.columns, *spec.params))
    return f"{spec.pattern}({filled})"


def table_table(spark: SparkSession, tables: Iterable[Propagated]) -> DataFrame:
    """One row a propagated table, in the order that they were reached."""
    rows = [
        (
            k, t.start, t.run_time, t.name, t.table, t.temporal, t.reasoning, ",".join(t.candidates), len(t.candidates),
            t.rows, "/".join(t.path), len(t.path) - 1, t.name.rsplit("_", 1)[-1], t.path[-1], int(t.is_id_unique), int(t.is_target_id_unique), 1, t.rows, int(t.rows > 0),
        )
        for k, t in enumerate(tables)
    ]
    return spark.createDataFrame(rows, TABLES)


def pattern_table(spark: SparkSession, patterns: Iterable[Pattern]) -> DataFrame:
    """One row a pattern: what it takes and uses."""

    def takes(p: Pattern, *kinds: str) -> int:
        found = {x.rstrip("0123456789") for x in p.slots} | {x for more in p.also.values() for x in more}
        return int(bool(found & set(kinds)))

    rows = [
        (
            p.name, p.author, int(p.cardinality != "1"), int(len(p.slots) > 1), takes(p, "nominal", "character", "counted"), takes(p, "numerical", "number", "decimal"), takes(p, "temporal", "date", "time"),
            int(p.needs_target), int(p.needs_date), p.description,
        )
        for p in patterns
    ]
    return spark.createDataFrame(rows, PATTERN_TABLE)


def run_table(spark: SparkSession, s: Settings, tables: int, journal: Journal, finish: datetime | None = None, run_time: float | None = None, warnings: int = 0) -> DataFrame:
    """One row for a run. Errors are features that could not be computed; memory is what the driver's JVM uses, in MB."""
    used = spark._jvm.java.lang.Runtime.getRuntime()
    memory = (used.totalMemory() - used.freeMemory()) / 1e6
    errors = sum(bool(x.exception) for x in journal.all)
    row = (finish, None, run_time, memory, warnings, errors, len(journal.all), len(journal.best()), tables, json.dumps(asdict(s), default=str))
    return spark.createDataFrame([row], RUNS)


def temporal_table(spark: SparkSession, rows: list[tuple[str, str, int, bool]]) -> DataFrame:
    return spark.createDataFrame(rows, TEMPORAL)
