"""Foreign keys: declared, read from DDL text, or kept as XML or JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from xml.etree import ElementTree


@dataclass(frozen=True)
class ForeignKey:
    """Columns of ``table`` that refer to columns of ``f_table``, in order. Propagation may follow it either way."""

    table: str
    columns: tuple[str, ...]
    f_table: str
    f_columns: tuple[str, ...]
    name: str = ""
    schema: str = ""
    f_schema: str = ""

    def __post_init__(self) -> None:
        if len(self.columns) != len(self.f_columns) or not self.columns:
            raise ValueError(f"key {self.name or self.table}: {len(self.columns)} columns refer to {len(self.f_columns)}")

    def reversed(self) -> ForeignKey:
        return ForeignKey(self.f_table, self.f_columns, self.table, self.columns, self.name, self.f_schema, self.schema)


def key(table: str, columns: str | Iterable[str], f_table: str, f_columns: str | Iterable[str] | None = None, name: str = "") -> ForeignKey:
    """A key from plain strings; the columns referred to have the same names unless given."""
    own = (columns,) if isinstance(columns, str) else tuple(columns)
    theirs = own if f_columns is None else (f_columns,) if isinstance(f_columns, str) else tuple(f_columns)
    return ForeignKey(table, own, f_table, theirs, name)


def both_ways(keys: Iterable[ForeignKey]) -> list[ForeignKey]:
    """Each key and its reverse, once, in order."""
    return list(dict.fromkeys(k for one in keys for k in (one, one.reversed())))


_WORD = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[^\s"`\[\].(),;]+)'
_STATEMENT = re.compile(
    rf"ALTER\s+TABLE\s+(?:ONLY\s+)?(?P<table>{_WORD}(?:\s*\.\s*{_WORD})?)\s+ADD\s+(?:CONSTRAINT\s+(?P<name>{_WORD})\s+)?"
    rf"FOREIGN\s+KEY\s*\((?P<columns>[^)]*)\)\s*REFERENCES\s+(?P<f_table>{_WORD}(?:\s*\.\s*{_WORD})?)\s*\((?P<f_columns>[^)]*)\)[^;]*;?",
    re.I,
)


def _plain(word: str) -> str:
    return word.strip().strip('"`[]')


def from_ddl(text: str, default_schema: str = "") -> list[ForeignKey]:
    """Keys that ALTER TABLE ... ADD [CONSTRAINT n] FOREIGN KEY statements declare.

    The table referred to becomes ``table`` and the altered one ``f_table``: the way that
    propagation goes from one row to its many.
    """

    def entity(found: str) -> tuple[str, str]:
        parts = [_plain(p) for p in re.findall(_WORD, found)]
        return (parts[0], parts[1]) if len(parts) > 1 else (default_schema, parts[0])

    out = []
    for m in _STATEMENT.finditer(text):
        schema, altered = entity(m["table"])
        f_schema, referred = entity(m["f_table"])
        columns = tuple(_plain(c) for c in m["columns"].split(","))
        f_columns = tuple(_plain(c) for c in m["f_columns"].split(","))
        out.append(ForeignKey(referred, f_columns, altered, columns, _plain(m["name"] or ""), f_schema, schema))
    return out


def to_json(keys: Iterable[ForeignKey]) -> str:
    return json.dumps([asdict(k) for k in keys], indent=1)


def from_json(text: str) -> list[ForeignKey]:
    return [ForeignKey(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}) for x in json.loads(text)]


def to_xml(keys: Iterable[ForeignKey]) -> str:
    root = ElementTree.Element("foreignConstraints")
    for k in keys:
        e = ElementTree.SubElement(root, "foreignConstraint")
        for tag, value in (("name", k.name), ("schema", k.schema), ("table", k.table), ("fSchema", k.f_schema), ("fTable", k.f_table)):
            if value:
                ElementTree.SubElement(e, tag).text = value
        for tag, values in (("column", k.columns), ("fColumn", k.f_columns)):
            for value in values:
                ElementTree.SubElement(e, tag).text = value
    ElementTree.indent(root)
    return ElementTree.tostring(root, encoding="unicode")


def from_xml(text: str) -> list[ForeignKey]:
    """Keys from elements with table, fTable, column and fColumn children, in any order, composite ones in theirs."""
    out = []
    for e in ElementTree.fromstring(text):
        one = lambda tag: (e.findtext(tag) or "").strip()  # noqa: B023, E731
        many = lambda tag: tuple((x.text or "").strip() for x in e.findall(tag))  # noqa: B023, E731
        out.append(ForeignKey(one("table"), many("column"), one("fTable"), many("fColumn"), one("name"), one("schema"), one("fSchema")))
    return out
