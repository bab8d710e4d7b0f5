"""Expansion: patterns times parameters, tables, columns and values, as feature specs. No Spark job but for top values."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions import PATTERNS, Binding, Pattern
from ..functions.registry import Part
from ..operators.base import DATE, FOLD, base_ids, base_targets
from ..operators.propagate import Propagated
from ..settings import CLASSIFICATION, Settings
from ..sources.catalog import Catalog
from ..sources.lists import chosen

FIRST_ID = 100_000


@dataclass(frozen=True)
class FeatureSpec:
    """One feature: a pattern bound to a propagated table, its columns and parameters."""

    pattern: str
    table: str  # name of the propagated table
    original: str  # name of the table it came from
    columns: tuple[tuple[str, str], ...] = ()
    params: tuple[tuple[str, Any], ...] = ()
    target: str | None = None
    target_value: Any = None
    prior: float | None = None
    group: str = ""
    number: int = 0

    def binding(self, s: Settings) -> Binding:
        return Binding(
            tuple(base_ids(s)), dict(self.columns), dict(self.params), DATE if s.target_date else None, self.target or base_targets(s)[0], self.target_value, self.prior, FOLD
        )

    def part(self, s: Settings) -> Part:
        return PATTERNS[self.pattern].build(self.binding(s))

    @property
    def name(self) -> str:
        """table_columns_pattern_parameters_number, each part cut to a third of what names may be long."""
        params = "_".join(str(v) for _, v in self.params)
        parts = [self.original, "_".join(c for _, c in self.columns), self.pattern, params]
        return "_".join([*(cut(p, 40) for p in parts if p), str(self.number)])

    @property
    def long_name(self) -> str:
        """As name, but nothing is cut."""
        return "_".join([self.original, *(c for _, c in self.columns), self.pattern, *(f"{k}={v}" for k, v in self.params), str(self.number)])


def cut(text: str, most: int) -> str:
    """The text's longest beginning that takes at most so many bytes; no character is split. Only letters, digits and _ stay."""
    text = "".join(c if c.isalnum() else "_" for c in text)
    return text.encode()[:most].decode("utf-8", "ignore")


def patterns_for(s: Settings, library: Iterable[Pattern] | None = None) -> list[Pattern]:
    """The library under the lists; patterns that need a date, classes or a fold only where there are such."""
    library = list(library) if library is not None else [p for p in PATTERNS.values() if s.experimental or not p.experimental]
    by_name = {p.key: p for p in library}
    names = chosen(by_name, s.pattern_white, s.pattern_black)
    return [by_name[n] for n in names if (s.target_date or not by_name[n].needs_date) and (s.task == CLASSIFICATION or not by_name[n].needs_target)]


def parameters(p: Pattern) -> list[dict[str, Any]]:
    """All combinations of a pattern's parameter values."""
    return [dict(zip(p.params, values, strict=True)) for values in itertools.product(*p.params.values())]


def sweep(p: Pattern, s: Settings | None = None) -> list[dict[str, Any]]:
    """All points of a pattern's grid under the settings' window; one empty point where it has none."""
    lag, lead = (s.lag, s.lead) if s else (0, 0)
    return [dict(zip(p.sweeps, values, strict=True)) for values in itertools.product(*(x.values(lag, lead) for x in p.sweeps.values()))]


def column_tuples(p: Pattern, table: Propagated, catalog: Catalog) -> list[dict[str, str]]:
    """Each way to fill a pattern's slots with different columns of the table; ordered pairs both count."""
    of_kind = catalog.tables[table.table].of_kind
    choices = [list(dict.fromkeys(c for kind in (slot.rstrip("0123456789"), *p.also.get(slot, ())) for c in of_kind(kind))) for slot in p.slots]
    return [dict(zip(p.slots, t, strict=True)) for t in itertools.product(*choices) if len(set(t)) == len(t)]


def fits(p: Pattern, table: Propagated) -> bool:
    return (p.cardinality == "1") == table.is_target_id_unique


def target_values(catalog: Catalog) -> dict[str, tuple[Any, float]]:
    """For each target its most frequent class and that class's share of the frequent ones."""
    s = catalog.settings
    out = {}
    for target, name in zip(s.targets, base_targets(s), strict=True):
        top = catalog.top_values(s.target_table, target)
        if top:
            out[name] = (top[0][0], top[0][1] / sum(n for _, n in top))
    return out


def expand(tables: list[Propagated], catalog: Catalog, library: Iterable[Pattern] | None = None) -> Iterator[FeatureSpec]:
    """All features of all tables, numbered in order."""
    s = catalog.settings
    classes = target_values(catalog) if s.task == CLASSIFICATION else {}
    values: dict[tuple[str, str], list[Any]] = {}
    number = itertools.count(FIRST_ID)
    for p in patterns_for(s, library):
        bound = [(t, v, prior) for t, (v, prior) in classes.items()] if p.needs_target else [(None, None, None)]
        for (target, value, prior), params, table in itertools.product(bound, parameters(p), [t for t in tables if fits(p, t)]):
            for columns in column_tuples(p, table, catalog):
                own: list[dict[str, Any]] = [{}]
                if p.needs_value:
                    nominal = columns[next(x for x in p.slots if x.startswith("nominal"))]
                    if (table.table, nominal) not in values:
                        values[table.table, nominal] = [v for v, _ in catalog.top_values(table.table, nominal)]
                    own = [{"value": v} for v in values[table.table, nominal]]
                for more in own:
                    group = f"{p.key}|{table.name}|{sorted(columns.items())}|{sorted(params.items())}|{sorted(more.items(), key=str)}|{target}" if p.sweeps else ""
                    for point in sweep(p, s):
                        spec = FeatureSpec(p.key, table.name, table.table, tuple(columns.items()), tuple({**params, **more, **point}.items()), target, value, prior, group)
                        yield replace(spec, number=next(number))


@dataclass
class Plan:
    """Specs by propagated table, ready for fusion."""

    specs: list[FeatureSpec]
    by_table: dict[str, list[FeatureSpec]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for x in self.specs:
            self.by_table.setdefault(x.table, []).append(x)
