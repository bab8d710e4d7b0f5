"""Patterns declared as data: a user's own library, as JSON.

An entry has a name, a cardinality ("1" or "n"), slots, and one of ``row``, ``aggregate``,
``lag`` or ``counts``: a Spark SQL template with the slots and parameters in braces, as in
the built-in library. ``where`` / ``having`` say which rows or groups have a value; ``inputs``
and ``order`` belong to lags; ``parameters`` and ``sweeps`` are tried in all combinations.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from .registry import Agg, Binding, Counts, Lag, Part, Pattern, Row, Sweep

KINDS = ("row", "aggregate", "lag", "counts")


def pattern(entry: Mapping[str, Any]) -> Pattern:
    """The pattern that an entry declares; ValueError where it's none."""
    kind = [k for k in KINDS if k in entry]
    if len(kind) != 1:
        raise ValueError(f"pattern {entry.get('name')}: one of {', '.join(KINDS)} is needed")
    slots = tuple(entry.get("slots", ()))
    template = entry[kind[0]]

    def build(b: Binding) -> Part:
        value = b.sql(template, prev_0="{prev_0}", prev_1="{prev_1}") if kind[0] == "lag" else b.sql(template)
        if kind[0] == "row":
            return Row(value, b.sql(entry["where"]) if "where" in entry else None)
        if kind[0] == "aggregate":
            return Agg(value, b.sql(entry["having"]) if "having" in entry else None)
        if kind[0] == "lag":
            return Lag(tuple(b.sql(i) for i in entry["inputs"]), b.sql(entry.get("order", "{temporal}")), value)
        return Counts(b.raw(slots[0]), value)

    text = json.dumps(dict(entry))
    return Pattern(
        entry["name"],
        "1" if kind[0] == "row" else str(entry.get("cardinality", "n")),
        slots,
        build,
        {k: tuple(v) for k, v in entry.get("parameters", {}).items()},
        {k: Sweep(**v) for k, v in entry.get("sweeps", {}).items()},
        needs_date="{base_date}" in text,
        needs_target="{target_" in text,
        needs_value="{value}" in text,
        author=entry.get("author", ""),
        description=entry.get("description", template),
    )


def library(text: str) -> list[Pattern]:
    return [pattern(x) for x in json.loads(text)]
