"""Feature patterns: what a feature computes, from which kinds of columns, with which parameters.

A pattern's ``build`` turns a binding into one of seven parts, which tell the planner how it
may be fused with others:

* Row: an expression for each row of the table.
* Agg: an aggregate expression over the rows of a base row.
* Lag: aggregates over rows with their predecessor's values, in time order.
* Counts: aggregates over a column's values and how often each occurs.
* Quantile: the value at a share of a column's order; all shares of a column share a plan.
* Within: a function over the rows within a window of time; all windows over a column share partial sums.
* Frame: a DataFrame function, where none of the above can express it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: Any) -> str:
    """A value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"CAST('{value}' AS DOUBLE)"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def epoch(sql: str) -> str:
    """A date or time as seconds since 1970-01-01, in double precision, whatever the session's zone."""
    return f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({sql} AS TIMESTAMP_NTZ)) / 1e6D)"


@dataclass(frozen=True)
class Binding:
    """A pattern's context: base columns, the columns in its slots, its parameters."""

    ids: tuple[str, ...]
    columns: Mapping[str, str] = field(default_factory=dict)
    params: Mapping[str, Any] = field(default_factory=dict)
    date: str | None = None
    target: str | None = None
    target_value: Any = None
    prior: float | None = None
    fold: str | None = None
    types: Mapping[str, T.DataType] = field(default_factory=dict)

    @property
    def base(self) -> list[str]:
        """The columns that name a base row, with its target."""
        return [*self.part, *([self.target] if self.target else [])]

    @property
    def part(self) -> list[str]:
        return [*self.ids, *([self.date] if self.date else [])]

    def raw(self, slot: str) -> str:
        return quoted(self.columns[slot])

    def number(self, slot: str) -> str:
        return f"CAST({self.raw(slot)} AS DOUBLE)"

    def sql(self, template: str, **more: str) -> str:
        """The template with {slot}: numbers as double, times as seconds, others as they are; {slot_raw}; {param}; {base_date}; {value}; {target_is}."""
        names: dict[str, str] = {}
        for slot in self.columns:
            kind = slot.rstrip("0123456789")
            names[slot] = self.number(slot) if kind in NUMBERS else epoch(self.raw(slot)) if kind in TIMES else self.raw(slot)
            names[f"{slot}_raw"] = self.raw(slot)
        names |= {k: str(v) for k, v in self.params.items()}
        if "value" in self.params:
            names["value"] = literal(self.params["value"])
        if self.date:
            names["base_date"] = epoch(quoted(self.date))
        if self.target:
            names["target_raw"] = quoted(self.target)
            names["target_is"] = f"({quoted(self.target)} = {literal(self.target_value)})"
            names["target_is_not"] = f"({quoted(self.target)} <> {literal(self.target_value)})"
        return template.format(**(names | more))


NUMBERS = {"numerical", "number", "decimal"}
TIMES = {"temporal", "date", "time"}


@dataclass(frozen=True)
class Row:
    value: str
    where: str | None = None


@dataclass(frozen=True)
class Agg:
    value: str
    #: Groups without such a row have no value: an aggregate that is true of those that stay.
    having: str | None = None


@dataclass(frozen=True)
class Lag:
    """value aggregates over the columns and over ``prev_<k>``, the k-th input of the row before in order of time."""

    inputs: tuple[str, ...]
    order: str
    value: str


@dataclass(frozen=True)
class Counts:
    """value aggregates over ``v``, the values of the column, and ``n``, how often each occurs (null is one value)."""

    column: str
    value: str


@dataclass(frozen=True)
class Quantile:
    column: str
    share: float


@dataclass(frozen=True)
class Within:
    """f of the column over the rows with low < at < high."""

    f: str
    column: str
    at: str
    low: float
    high: float


@dataclass(frozen=True)
class Frame:
    make: Callable[[DataFrame], DataFrame]


Part = Row | Agg | Lag | Counts | Quantile | Within | Frame


@dataclass(frozen=True)
class Sweep:
    """A parameter tried at evenly spaced values; variants share a group, of which the best is kept.

    An end may be the window's own: "lagMax", its lag and lead together, or "leadMin", its lead, in its unit.
    """

    low: float | str
    high: float | str
    steps: int
    integer: bool = False

    def values(self, lag: float = 0, lead: float = 0) -> list[float]:
        low, high = ({"lagMax": lag + lead, "leadMin": lead}[x] if isinstance(x, str) else x for x in (self.low, self.high))
        out = [low + i * (high - low) / (self.steps - 1) for i in range(self.steps)] if self.steps > 1 else [low]
        return [int(x) for x in out] if self.integer else out


@dataclass(frozen=True)
class Pattern:
    name: str
    cardinality: str  # "1": tables with one row for each base row; "n": others
    slots: tuple[str, ...]
    build: Callable[[Binding], Part]
    params: Mapping[str, tuple] = field(default_factory=dict)
    sweeps: Mapping[str, Sweep] = field(default_factory=dict)
    needs_date: bool = False
    needs_target: bool = False
    needs_value: bool = False
    needs_fold: bool = False
    experimental: bool = False
    #: Further kinds of columns that a slot takes, as they are.
    also: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    author: str = "loomwright"
    description: str = ""

    @property
    def key(self) -> str:
        return self.name.lower().replace(" ", "_")


PATTERNS: dict[str, Pattern] = {}


def register(pattern: Pattern) -> None:
    if pattern.key in PATTERNS:
        raise ValueError(f"two patterns are named {pattern.name}")
    PATTERNS[pattern.key] = pattern


def agg(name: str, slots: tuple[str, ...], value: str, having: str | None = None, **more: Any) -> None:
    register(Pattern(name, "n", slots, lambda b: Agg(b.sql(value), b.sql(having) if having else None), description=value, **more))


def row(name: str, slots: tuple[str, ...], value: str, where: str | None = None, **more: Any) -> None:
    register(Pattern(name, "1", slots, lambda b: Row(b.sql(value), b.sql(where) if where else None), description=value, **more))


def lag(name: str, slots: tuple[str, ...], inputs: tuple[str, ...], value: str, order: str = "{temporal}", **more: Any) -> None:
    register(Pattern(name, "n", slots, lambda b: Lag(tuple(b.sql(i) for i in inputs), b.sql(order), b.sql(value, prev_0="{prev_0}", prev_1="{prev_1}")), description=value, **more))


def counts(name: str, slot: str, value: str, **more: Any) -> None:
    register(Pattern(name, "n", (slot,), lambda b: Counts(b.raw(slot), b.sql(value)), description=value, **more))


def frame(name: str, cardinality: str, slots: tuple[str, ...], make: Callable[[DataFrame, Binding], DataFrame], **more: Any) -> None:
    register(Pattern(name, cardinality, slots, lambda b: Frame(lambda df: make(df, b)), description=" ".join((make.__doc__ or "").split()), **more))
