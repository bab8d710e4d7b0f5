"""A whole run: base, propagation, expansion, fused computation, scores, ranking and the main samples.

What a run makes on its way is written to the cluster's shared folder: the base, spines of the
propagated tables, and the features of each fused set as they are scored. The main samples read these; no plan outlives its set, however many there are. In a folder of
one's own a run that ended early goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Pattern
from ..functions.registry import quoted
from ..operators.base import DATE, FOLD, base_keys, base_targets, build_base, sample_base
from ..operators.propagate import Propagated, base_columns, propagate
from ..settings import CLASSIFICATION, Settings
from ..sources.catalog import Catalog
from ..sources.keys import ForeignKey
from ..sources.store import Store
from . import score
from .expand import FeatureSpec, Plan, expand
from .fuse import fused, join_base
from .journal import Journal, Relevance, Scored


V = TypeVar("V")


@dataclass
class Result:
    base: DataFrame
    tables: list[Propagated]
    journal: Journal
    settings: Settings
    finish: datetime | None = None
    run_time: float = 0.0
    #: Written sets of features: the table's name in the store, and its features.
    sets: dict[str, list[str]] = field(default_factory=dict)
    store: Store | None = None  # where they are, if they were written

    def main_sample(self, target: str | None = None) -> DataFrame:
        """The base with its best features; of one target, or of all."""
        chosen = within_budget(self.base, [x.spec for x in (self.journal.of(target) if target else self.journal.ranked())], self.settings)
        names = {x.name for x in chosen}
        if self.store is None or not names <= {n for own in self.sets.values() for n in own}:
            return main_sample(self.base, self.tables, chosen, self.settings)
        out = self.base
        for name, own in self.sets.items():
            if some := [n for n in own if n in names]:
                out = join_base(out, self.store.read(name).select(*base_keys(self.settings), *(quoted(n) for n in some)), base_keys(self.settings))
        plan = Plan(sorted(chosen, key=lambda x: x.number))
        return out.select(*self.base.columns, *(quoted(x.name) for t in self.tables for x in plan.by_table.get(t.name, [])))

    def release(self) -> None:
        """Drops the written features; samples made from now on compute theirs anew."""
        if self.store is not None:
            self.store.drop(*self.sets)
        self.sets = {}

    def main_samples(self) -> dict[str, DataFrame]:
        return {f"mainsample_{name}": self.main_sample(t) for name, t in zip(self.settings.targets, base_targets(self.settings), strict=True)}


def bound(table: Propagated, specs: list[FeatureSpec], s: Settings) -> DataFrame:
    """A propagated table's rows with the base's columns, the table's keys and the columns that these features use: all that is read of it."""
    used = sorted({c for x in specs for _, c in x.columns} - set(table.ids))
    return table.df.select(*base_columns(s), *(quoted(c) for c in (*(c for c in table.ids if c in table.df.columns), *used)))


def by_base_row(table: Propagated, s: Settings) -> Propagated:
    """The table with the rows of a base row in one partition: what groups, orders and joins them by it needs no shuffle of its own.

    They stay where they are if a base row has too many for one task, or none has two.
    """
    return replace(table, df=table.df.repartition(*base_keys(s))) if 1 < table.most <= s.heavy_key_rows else table


def wide_table(table: Propagated, specs: list[FeatureSpec], s: Settings) -> DataFrame:
    """All features of a propagated table beside the base columns. Where times tie, order is settled by the table's keys, then by the columns in use."""
    b = replace(specs[0].binding(s), target=base_targets(s)[0])
    rows = bound(table, specs, s)
    tie = [quoted(c) for c in rows.columns if c not in base_columns(s)]
    return fused(rows, b, [(x.name, x.part(s)) for x in specs], tie, s.fuse_width)


def within_budget(base: DataFrame, specs: list[FeatureSpec], s: Settings) -> list[FeatureSpec]:
    """Of features in order of worth those that the column budget has room for; a warning tells of others."""
    budget = max(0, s.column_budget - len(base.columns))
    if len(specs) > budget:
        warnings.warn(f"the main sample keeps the best {budget} of {len(specs)} features: column_budget is {s.column_budget}", stacklevel=3)
    return specs[:budget]


def main_sample(base: DataFrame, tables: list[Propagated], specs: list[FeatureSpec], s: Settings) -> DataFrame:
    """The base left-joined with one wide table for each propagated table: no row is lost or repeated.

    specs are in order of worth: those beyond the column budget are left out, with a warning.
    """
    plan = Plan(sorted(within_budget(base, specs, s), key=lambda x: x.number))
    out = base
    for table in tables:
        if own := plan.by_table.get(table.name):
            wide = wide_table(table, own, s)
            out = join_base(out, wide.drop(*base_targets(s)), base_keys(s))
    return out


def limited(df: DataFrame, seconds: float | None, call: Callable[[], V]) -> V:
    """call's result; its Spark jobs are cancelled, and so fail, once it has taken so many seconds."""
    if seconds is None:
        return call()
    context, group = df.sparkSession.sparkContext, f"limited-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, context.cancelJobGroup, [group])
    context.setJobGroup(group, "features under a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return call()
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)


def scored(table: Propagated, specs: list[FeatureSpec], base_rows: int, pivot: float | None, s: Settings, store: Store | None = None, sets: dict[str, list[str]] | None = None) -> list[Scored]:
    """The features of a fused set, computed and scored. A set that fails or takes too long is halved, down to the features at fault, which are noted as not good.

    With a store the set is written there, and noted in sets; else it is cached while it is scored.
    """
    start, began = datetime.now(), time.perf_counter()
    held: list[DataFrame] = []
    name = f"features-{signature(specs)}"

    def compute() -> list[Scored]:
        wide = wide_table(table, specs, s)
        held.append(store.keep(wide, name) if store else wide.persist())
        return score_table(held[0], specs, base_rows, pivot, s, *([lambda cells: store.keep(cells, "cube")] if store else []))

    try:
        out = limited(table.df, s.seconds_limit, compute)
    except Exception as e:  # whatever a feature's expression or data may raise
        if len(specs) > 1:
            half = len(specs) // 2
            return [x for part in (specs[:half], specs[half:]) for x in scored(table, part, base_rows, pivot, s, store, sets)]
        return [Scored(specs[0], ok=False, start=start, run_time=time.perf_counter() - began, exception=str(e).split("\n", 1)[0][:255] or type(e).__name__)]
    finally:
        for df in held if not store else []:
            df.unpersist()
    if sets is not None and store:
        sets[name] = [x.name for x in specs]
    types = {f.name: f.dataType for f in held[0].schema.fields}
    for x in out:
        t = types[x.spec.name]
        x.start, x.run_time, x.data_type = start, (time.perf_counter() - began) / len(specs), t.simpleString()
        x.category = "nominal" if score.is_nominal(t) else "temporal" if score.is_temporal(t) else "numerical"
    return out


def signature(what: object) -> str:
    """Sixteen characters that name features, settings and the like, the same on each run."""
    return hashlib.sha256(repr(what).encode()).hexdigest()[:16]


def note(store: Store, name: str, got: list[Scored], sets: dict[str, list[str]]) -> None:
    """Writes down what is known of a set's features, once they are all done."""
    line = json.dumps({"sets": sets, "features": [{**asdict(x), "spec": x.spec.number, "start": x.start.isoformat() if x.start else None} for x in got]})
    store.keep(store.spark.createDataFrame([(line,)], "line string").coalesce(1), name)


def noted(store: Store, name: str, specs: list[FeatureSpec]) -> tuple[list[Scored], dict[str, list[str]]] | None:
    """What an earlier start has written down of these features; None if they weren't done."""
    if not store.has(name):
        return None
    told, by = json.loads(store.read(name).first()["line"]), {x.number: x for x in specs}
    out = []
    for x in told["features"]:
        relevance = {t: Relevance(**r) for t, r in x["relevance"].items()}
        out.append(Scored(**{**x, "spec": by[x["spec"]], "relevance": relevance, "start": datetime.fromisoformat(x["start"]) if x["start"] else None}))
    return out, told["sets"]


def score_table(wide: DataFrame, specs: list[FeatureSpec], base_rows: int, pivot: float | None, s: Settings, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> list[Scored]:
    """Scores of a wide table's features: counts and extremes in one job, a cube in another, from which every target's scores are read. keep holds the cube meanwhile."""
    names, targets = [x.name for x in specs], base_targets(s)
    rows, filled, ends = score.facts(wide, names, targets if s.task == CLASSIFICATION else [])
    unique = wide.groupBy(*base_keys(s)).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    good = [n for n in names if filled[n]] if unique and 0 < rows <= base_rows else []
    by: dict[str, dict[str, Relevance]] = {n: {} for n in names}
    if good and s.task == CLASSIFICATION:
        cells = keep(score.cube(wide, good, targets, ends, score.is_late(DATE, pivot) if pivot is not None else None))
        for k, target in enumerate(targets):
            for r in score.chi_of(cells, k, score.few_classes(wide, target, len(good))).collect():
                by[r["feature"]][target] = Relevance(r["relevance"] or 0.0)
            for r in score.drift_of(cells, k).collect() if pivot is not None else []:
                if target in by[r["feature"]]:
                    by[r["feature"]][target].drift = r["drift"] or 0.0
        cells.unpersist()
    for target in targets if good and s.task != CLASSIFICATION else []:
        for r in score.r_square(wide, good, target).collect():
            by[r["feature"]][target] = Relevance(r["relevance"] or 0.0)
    return [Scored(x, by[x.name], rows, rows - filled[x.name], x.name in good) for x in specs]


def run(
    tables: Mapping[str, DataFrame],
    keys: Iterable[ForeignKey],
    settings: Settings,
    library: Iterable[Pattern] | None = None,
    primary: Mapping[str, str] | None = None,
    not_null: Iterable[str] = (),
    now: datetime | None = None,
    specs: list[FeatureSpec] | None = None,
    persist: bool = True,
    folder: str | None = None,
) -> Result:
    """Features of the settings' target from related tables. With specs, those alone are computed and all are kept.

    The base and the spines are written to the shared folder. With persist, a table's bound columns
    are cached while its features are computed, and these are written, too; else both are computed
    again where they are needed. In a folder, which must be shared as well, what is written stays: a run
    of the same settings, keys and columns takes from there what an earlier one has done, set by
    set. It is for tables that haven't changed meanwhile.
    """
    s, began = settings, time.perf_counter()
    catalog = Catalog(tables, keys, s, primary, not_null)
    spark = catalog.tables[s.target_table].df.sparkSession
    facts = (s, catalog.keys, [(n, t.df.schema.simpleString()) for n, t in catalog.tables.items()])
    store = Store(spark, "run", f"{folder.rstrip('/')}/{signature(facts)}" if folder else None)
    base = once(store, sample_base(build_base(catalog.tables[s.target_table].df, s), s), "base")
    found = [by_base_row(t, s) for t in propagate(base, catalog, now, store=store)]
    plan = Plan(specs if specs is not None else list(expand(found, catalog, library)))
    journal = Journal(base_targets(s), s.predictor_max if specs is None else max(1, len(specs)), s.least_relevance if specs is None else 0.0)
    n, pivot = base.count(), score.pivot_date(base, DATE) if s.target_date else None
    sets: dict[str, list[str]] = {}
    for table in found:
        own = plan.by_table.get(table.name, [])
        rows = table
        for at in range(0, len(own), s.fuse_width):
            some, made = own[at : at + s.fuse_width], {}
            done = noted(store, f"journal-{signature(some)}", some) if folder else None
            if done is None:
                if persist and rows is table:  # the first set that isn't done yet; a lost block is joined again, from the spine and one scan
                    rows = replace(table, df=bound(table, own, s).persist())
                done = scored(rows, some, n, pivot, s, store if persist else None, made), made
                if folder:
                    note(store, f"journal-{signature(some)}", *done)
            for x in done[0]:
                journal.add(x)
            sets |= done[1]
        if rows is not table:
            rows.df.unpersist()
    return Result(base, found, journal, s, datetime.now(), time.perf_counter() - began, sets, store if persist else None)


def once(store: Store, df: DataFrame, name: str) -> DataFrame:
    """df as a table of the store, where an earlier start may have left it."""
    return store.read(name, df) if store.has(name) else store.keep(df, name)


def two_stages(tables: Mapping[str, DataFrame], keys: Iterable[ForeignKey], settings: Settings, explore: int, **more) -> tuple[Result, Result]:
    """Explore on a sample of so many rows a class, then compute the features it chose on all rows, from the tables and columns that they need.

    Names of propagated tables hash the path of keys, so that specs of the first stage hold in the second.
    """
    keys = list(keys)
    first = run(tables, keys, replace(settings, sample_count=explore), **more)
    chosen = [x.spec for x in first.journal.best()]
    columns = {f"{x.original}.{c}" for x in chosen for _, c in x.columns}
    # Columns that bound a table in time are needed too, and a table without chosen columns has a name that none has: an empty list would let all in.
    columns |= {f"{t.table}.{t.temporal or ''}" for t in first.tables}
    if settings.target_date:
        columns.add(f"{settings.target_table}.{settings.target_date}")
    whites = replace(
        settings, sample_count=None, table_white=sorted({t.table for t in first.tables}), pattern_white=sorted({x.pattern for x in chosen}),
        column_white=sorted(columns),
    )
    return first, run(tables, keys, whites, **{**more, "specs": chosen})


__all__ = ["FOLD", "Result", "main_sample", "run", "two_stages"]
