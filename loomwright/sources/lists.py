"""Lists of what to take and what to leave: tables, columns, patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable


def chosen(names: Iterable[str], white: Iterable[str] = (), black: Iterable[str] = ()) -> list[str]:
    """Names that the white list has (all, if it's empty) and the black list hasn't, in natural order."""
    white, black = set(white), set(black)
    return sorted((n for n in names if n not in black and (not white or n in white)), key=natural)


def natural(name: str) -> list[tuple[int, int, str]]:
    """A sort key under which digits compare as numbers: table2 before table10."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|\D+", name)]


def parse(text: str) -> list[str]:
    """Comma-separated names, white space and empty ones dropped."""
    return [x.strip() for x in text.split(",") if x.strip()]


def resolved(table: str, tables: Iterable[str]) -> list[str]:
    """The known tables that a name in a list stands for: itself; without its schema, if tables have none; without one of its own, that table of every schema."""
    tables = list(tables)
    if table in tables:
        return [table]
    bare = table.rsplit(".", 1)[-1]
    if bare != table:
        return [bare] if bare in tables else []
    return [t for t in tables if t.rsplit(".", 1)[-1] == table]


def by_table(names: Iterable[str], tables: Iterable[str] | None = None) -> dict[str, set[str]]:
    """table.column names, perhaps with a schema before them, by table; a bare table stands for all of its columns.

    Tables that are known by schema.table are told apart by it; where none are known, schemas are dropped.
    """
    known = None if tables is None else list(tables)
    out: dict[str, set[str]] = {}
    for name in names:
        parts = name.split(".")
        if known is None:
            table, column = (parts[0], None) if len(parts) == 1 else (parts[-2], parts[-1])
            found = [table]
        elif len(parts) == 1 or name in known:
            found, column = resolved(name, known), None
        else:
            found, column = resolved(".".join(parts[:-1]), known), parts[-1]
        for table in found:
            out.setdefault(table, set()).update([column] if column is not None else [])
    return out
