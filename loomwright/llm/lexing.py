"""Assignments in source and configuration text: names, and the literals or names they are given.

A tokenizer for what such syntaxes share, not a grammar of one language: Python, JavaScript,
Java, Go, PHP, Ruby, shell, SQL, JSON, YAML, TOML, INI, properties, HCL and XML write
``name op value`` in a few ways.

* A name is bare, quoted (JSON), or the last of its subscripts (``cfg["db"]["key"]``); a type
  may stand before the operator (``key: str = ...``). Operators are ``=``, ``:``, ``:=``,
  ``=>`` and ``?=``. Further forms are ``#define NAME "x"``, ``ENV NAME x``, ``--name x``,
  ``name("NAME", "x")`` and XML elements and attributes.
* A value is one primary or several, joined by ``+``, ``.``, ``..``, ``||``, ``<<``, a line's
  continuation or mere adjacency of quoted literals. Parentheses let it run over lines. A
  primary is a quoted literal (with prefix, over lines in triple or back quotes), a bare word,
  a name, or a name in ``$x``, ``${x}``, ``%x%`` or ``{{ x }}``; a YAML block scalar is one
  literal for each of its lines. A call has no literal.

``assignments`` yields them in order of their names. All scans move forwards only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Part(NamedTuple):
    """A literal's stretch of the text, or a reference to a name."""

    start: int
    end: int
    name: str | None = None
    #: A reference that may also be a literal: a bare word where configuration has values.
    bare: bool = False


class Assignment(NamedTuple):
    at: int
    name: str
    parts: tuple[Part, ...]


_ID = r"[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z0-9_]++)*+"
_OPEN = r"(?<![A-Za-z0-9_.\\-])"
#: What begins an assignment. Alternatives are told apart by their groups.
HEAD = re.compile(
    rf"""{_OPEN}(?:
    --(?P<flag>[A-Za-z][A-Za-z0-9_-]*+)(?:=|[ ]++(?=[^\s-]))
    |(?:\#[ \t]*+define|ENV|ARG|set|setenv)[ \t]++(?P<defined>{_ID})[ \t]++(?=[^\s=:+*/|&<>-])
    |(?:(?P<quote>["'])(?P<quoted>[A-Za-z_][A-Za-z0-9_. -]*+)(?P=quote)|(?P<name>{_ID})|(?<=\$)(?P<dollar>{_ID}))
     [ \t]*+(?:\][ \t]*+)?
     (?::[ \t]*+&?(?:'[a-z]++[ ]++)?[A-Za-z_][\w.\[\]|<>?]*+[ \t]*+(?==[^=>~])|(?<=[ \t])(?:\[\]|\*)?(?:string|byte)[ \t]*+(?==[^=>~]))?
     (?P<op>:=|=>|\?=|=(?![=~>])|:(?![:/=]))
    )
    |(?<![A-Za-z_.])[A-Za-z_.]*+\([ \t]*+(?P<q2>["'])(?P<first>{_ID})(?P=q2)[ \t]*+,(?=[ \t]*+["'`])
    |<(?P<element>[A-Za-z_][\w:.-]*+)(?P<attributes>(?:[ \t\r\n]++[\w:.-]++[ \t]*+=[ \t]*+(?:"[^"<]*+"|'[^'<]*+'))*+)[ \t\r\n]*+/?>(?P<inside>[^<]*+)
    """,
    re.A | re.X,
)
ATTRIBUTE = re.compile(r"""([\w:.-]++)[ \t]*+=[ \t]*+(?:"([^"<]*+)"|'([^'<]*+)')""", re.A)
NAMED = {"name", "key", "id", "property"}
#: A quoted literal. In the last form back quotes.
STRING = re.compile(
    r"""[A-Za-z@$]{0,2}(?:\"{3}(?P<a>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}(?P<b>(?:[^'\\]|\\.|'(?!''))*+)'{3}|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`]*+)`)""",
    re.S | re.A,
)
REFERENCE = re.compile(r"""\$\{?([A-Za-z_][A-Za-z0-9_]*+)\}?(?![A-Za-z0-9_+/=-])|%([A-Za-z_][A-Za-z0-9_]*+)%|\{\{-?[ \t]*+\.?([A-Za-z_][A-Za-z0-9_.]*+)[ \t]*+-?\}\}|\$\(([A-Za-z_][A-Za-z0-9_]*+)\)""", re.A)
#: A bare word; = only ends one, as padding.
WORD = re.compile(r"""[^\s"'`,;(){}\[\]<>|&=]++={0,2}(?![^\s"'`,;(){}\[\]<>|&])|[^\s"'`,;(){}\[\]<>|&=]++""", re.A)
IDENTIFIER = re.compile(r"[$@]?([A-Za-z_][A-Za-z0-9_]*+(?:(?:\.|->|::)[A-Za-z_][A-Za-z0-9_]*+)*+)\Z", re.A)
JOIN = re.compile(r"[ \t]*+(?:\+|\.\.|\.(?=[ \t\"'$])|\|\||<<)[ \t]*+(?:\\?\r?\n[ \t]*+)?(?:(?:#|//)[^\n]*+\n[ \t]*+)?", re.A)
NEXT_LINE_JOIN = re.compile(r"[ \t]*+\\?\r?\n[ \t]*+(?=(?:\+|\.(?=[ \t\"'])|\|\|)[ \t]*+)", re.A)
ADJACENT = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)?(?=[A-Za-z]{0,2}[\"'])", re.A)
ADJACENT_IN_PARENTHESES = re.compile(r"(?:[ \t\r\n]|#[^\n]*+\n|\\\n)*+(?=[A-Za-z]{0,2}[\"'])", re.A)
BLANK = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)?", re.A)
BLOCK_SCALAR = re.compile(r"[ \t]*+[|>][+-]?[0-9]?[+-]?[ \t]*+(?:#[^\n]*+)?\r?\n", re.A)
LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)")
OPERATOR = re.compile(r"[ \t]*+(?:=|:|\?=)")
END_OF_VALUE = re.compile(r"[ \t]*+(?:$|[#;,}])", re.M)
#: Names that are put into quoted text.
IN_BRACES = re.compile(r"\{([A-Za-z_][A-Za-z0-9_.]*+)(?:[!:][^{}\"']*+)?\}", re.A)
IN_TEXT = re.compile(r"[$#]\{([A-Za-z_][A-Za-z0-9_.]*+)\}", re.A)
FILLS = re.compile(r"[ \t]*+%[ \t]*+(?:\(|(?=[A-Za-z_]))|\.format\(", re.A)
ONLY_PLACES = re.compile(r"(?:%[sdr]|\{[0-9]*\})+")
JOINS = re.compile(r"\.join\([\[(]")
#: A call of at most one plain argument, or the first of several.
CALL = re.compile(r"""\([ \t]*+(?:"[^"\\\n]*+"|'[^'\\\n]*+'|[\w.]++)?[ \t]*+(?:\)|(?P<more>,[ \t]*+(?:default[ \t]*+=[ \t]*+)?))""", re.A)
#: Functions whose second argument stands for what is missing.
WITH_DEFAULT = {"getenv", "get", "env", "fetch", "getProperty", "getOrDefault", "get_or_default", "config", "setdefault", "pop", "coalesce", "nvl", "ifnull", "lookup"}
OTHERWISE = re.compile(r"[ \t]+(?:or|\?\?)[ \t]+|[ \t]*+\|\|[ \t]*+(?=[\"'`])|[ \t]+if[ \t]+(?:[^\n;:=]|[=!<>]=)*?[ \t]else[ \t]+|(?P<condition>[ \t]*+\?[ \t]*+(?=[\"'`]))", re.A)
ELSE_COLON = re.compile(r"[ \t]*+:[ \t]*+(?=[\"'`])", re.A)
BETWEEN = re.compile(r"(?:[\s,]|(?:#|//)[^\n]*+\n)*+")
KEY_ENDS = re.compile(r"[ \t]*+(?:=>|:|=)")
KEY_FOLLOWS = re.compile(r"""\s*+(?:["'][^"'\n]*+["']|[\w.-]++)\s*+(?:=>|:|=)|\s*+[}\[{]""", re.A)
MEMBER_ENDS = re.compile(r"[ \t]*+(?:[,\])]|\r?\n)")
SUBSCRIPTS = re.compile(r"""(?:\[(?:"([^"\n\]]*+)"|'([^'\n\]]*+)'|(\w++))\])++""", re.A)
COMMA = re.compile(r"[ \t]*+,[ \t]*+")
TARGETS = re.compile(rf"[ \t]*+(?:(?:let|const|var|local|my)[ \t]++)?\(?(?P<names>(?:[$]?{_ID}[ \t]*+,[ \t]*+)++)\$?", re.A)
TYPED = re.compile(r"(?:new[ \t]++)?[A-Za-z_][\w.]*+(?:\[\])?[ \t]*+(?=\{[ \t\r\n]*+[\"'`])", re.A)
HERE_DOCUMENT = re.compile(r"[ \t]*+(?:\"?\$\([ \t]*+cat[ \t]*+)?<<[<~-]?[ \t]*+[\"']?(?P<tag>[A-Za-z_]\w*+)[\"']?[;,)]?[ \t]*+\r?\n", re.A)
EMPTY_LINE = re.compile(r"[ \t]*+(?:#[^\n]*+)?\r?\n")
LEAD = re.compile(r"([ \t]*+(- [ \t]*+)?)[\"']?")
ITEM = re.compile(r"([ \t]*+)-[ \t]++")
BRACKET = re.compile(r"""\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[{}\[\]]""")
#: Keys that take their meaning from the mapping they are in.
SAYS_NOTHING = set("value val default data content text plain plaintext raw current previous old new primary secondary prod production staging stage dev development test live sandbox main".split())


def _block_scalar(text: str, at: int, key_at: int) -> list[Part]:
    """The lines that are indented further than the key's line, each a literal."""
    line = text.rfind("\n", 0, key_at) + 1
    indent = len(text[line:key_at]) - len(text[line:key_at].lstrip(" \t-"))
    out: list[Part] = []
    while at < len(text):
        m = LINE.match(text, at)
        inside = m[2].rstrip()
        if inside and len(m[1]) <= indent:
            break
        if inside:
            out.append(Part(m.start(2), m.start(2) + len(inside)))
        at = m.end()
    return out


def _string(m: re.Match) -> list[Part]:
    """A quoted literal's parts: its stretches, and the names that it has put in."""
    a, b = m.span(m.lastgroup)
    text, prefix = m.string, m.string[m.start() : m.start() + 2].lower()
    if ref := REFERENCE.fullmatch(text, a, b):
        return [Part(a, b, next(g for g in ref.groups() if g), True)]
    if m.lastgroup in "bd" and "f" not in prefix:
        return [Part(a, b)]
    out, at = [], a
    for name in (IN_BRACES if "f" in prefix or "$" in prefix else IN_TEXT).finditer(text, a, b):
        if name.start() > at:
            out.append(Part(at, name.start()))
        out.append(Part(*name.span(), name[1], True))
        at = name.end()
    return [*out, Part(at, b)] if at < b or not out else out


class _Values(NamedTuple):
    #: The parts of each alternative.
    either: list[tuple[Part, ...]]
    #: Where to look for the next name: the value's begin, as quoted text may hold assignments itself, but a bare word's end.
    begin: int
    end: int


def _members(text: str, at: int, configuration: bool) -> tuple[list[tuple[Part, ...]], int]:
    """The literals and names of the sequence whose bracket is at a place, up to the first member that is neither."""
    out: list[tuple[Part, ...]] = []
    depth = 0
    while True:
        at = BETWEEN.match(text, at).end()
        c = text[at : at + 1]
        if c and (c in "[(" or c == "{" and not depth):
            depth += 1
            at += 1
        elif c and c in "])}":
            depth -= 1
            at += 1
            if depth <= 0:
                return out, at
        elif m := STRING.match(text, at):
            if KEY_ENDS.match(text, m.end()):
                return out, at
            out.append(tuple(_string(m)))
            at = m.end()
        elif (m := WORD.match(text, at)) and MEMBER_ENDS.match(text, m.end()):
            name = IDENTIFIER.match(m[0])
            out.append((Part(at, m.end(), name[1], configuration) if name else Part(at, m.end()),))
            at = m.end()
        else:
            return out, at


def _filled(text: str, at: int, parts: list[Part]) -> tuple[list[Part], int]:
    """A literal's parts with those of the names that ``%`` or ``format`` puts into it, and the literal left out if it has nothing else."""
    m = FILLS.match(text, at)
    if not m:
        return parts, at
    more, at = _members(text, m.end() - 1, False) if m[0].endswith("(") else ([], m.end())
    if not m[0].endswith("(") and (name := WORD.match(text, at)) and (known := IDENTIFIER.match(name[0])):
        more, at = [(Part(at, name.end(), known[1]),)], name.end()
    if not more:
        return parts, at
    own = [p for p in parts if p.name is not None or not ONLY_PLACES.fullmatch(text, p.start, p.end)]
    return own + [p for two in more for p in two], at


def _value(text: str, at: int, configuration: bool) -> _Values:
    """The value that begins at a place; without parts for most calls."""
    begin = at
    at = BLANK.match(text, at).end()
    inside = 0
    while text.startswith("(", at):
        inside += 1
        at += 1
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
    either: list[tuple[Part, ...]] = []
    parts: list[Part] = []
    chosen = False  # after a condition

    def ended() -> _Values:
        return _Values([*either, tuple(parts)], begin, at)

    while True:
        if m := STRING.match(text, at):
            now, at = _filled(text, m.end(), _string(m))
            if not now or m.end() - m.start() == 2:
                if joins := JOINS.match(text, at):
                    more, at = _members(text, joins.end() - 1, False)
                    now = [p for two in more for p in two]
            parts += now
            quoted = True
        elif m := REFERENCE.match(text, at):
            parts.append(Part(at, m.end(), next(g for g in m.groups() if g)))
            at, quoted = m.end(), False
        elif m := WORD.match(text, at):
            word, quoted = m[0], False
            if "+" in word and (cut := IDENTIFIER.match(word.split("+", 1)[0])) and not configuration:
                word = cut[0]  # a + b, not a word in base 64
            end = at + len(word.rstrip(".:!?" if not word.endswith("=") else ""))
            if end == at or word in ("new", "await", "not", "function", "lambda"):
                return _Values([*either], max(begin, end), end)
            if text.startswith("(", end):
                call = CALL.match(text, end)
                if not call or call["more"] and word.rsplit(".", 1)[-1].rsplit(">", 1)[-1] not in WITH_DEFAULT:
                    return _Values([*either], max(begin, end), end)
                at = call.end()
                if call["more"]:
                    default = STRING.match(text, at)
                    if not default:
                        return _Values([*either], max(begin, end), end)
                    either.append(tuple(_string(default)))
                    at = default.end()
                    at += text.startswith(")", at)
                if not OTHERWISE.match(text, at):
                    return _Values([*either], max(begin, end), at)
            else:
                name = IDENTIFIER.match(text[at:end])
                bare = (configuration or any(c.isdigit() for c in word)) and END_OF_VALUE.match(text, end) is not None
                held = SUBSCRIPTS.match(text, end) if name else None
                parts.append(Part(at, held.end(), next(g for g in held.groups() if g is not None)) if held else Part(at, end, name[1], bare) if name else Part(at, end))
                at = held.end() if held else end
                if len(parts) == 1 and not either and not OPERATOR.match(text, end):
                    begin = end
        else:
            return ended()
        if m := OTHERWISE.match(text, at) or (quoted and chosen and ELSE_COLON.match(text, at)):
            if m.re is OTHERWISE and m["condition"]:
                chosen = True
            else:
                either.append(tuple(parts))
            parts, at = [], m.end()
            continue
        m = JOIN.match(text, at) or NEXT_LINE_JOIN.match(text, at)
        if m and m.re is NEXT_LINE_JOIN:
            m = JOIN.match(text, m.end())
        if m is None and quoted:
            m = (ADJACENT_IN_PARENTHESES if inside else ADJACENT).match(text, at)
        if m is None:
            return ended()
        at = m.end()


def _here_document(text: str, m: re.Match) -> list[Part]:
    """The lines up to the closing word, each a literal; none where the word or another here-document's begin is missing or in the way."""
    at, out = m.end(), []
    while at < len(text):
        line = LINE.match(text, at)
        inside = line[2].rstrip()
        if inside.rstrip(";,)") == m["tag"]:
            return out
        if "<<" in inside:
            return []
        if inside:
            out.append(Part(line.start(2), line.start(2) + len(inside)))
        at = line.end()
    return []


def _items(text: str, at: int, indent: int) -> Iterator[tuple[Part, ...]]:
    """The members of a YAML sequence from a line's begin, up to the first that is no plain value."""
    while (m := ITEM.match(text, at)) and len(m[1]) >= indent:
        got = _value(text, m.end(), True)
        if not got.either or not END_OF_VALUE.match(text, got.end):
            return
        yield from got.either
        at = text.find("\n", got.end) + 1
        if not at:
            return


class _Brackets:
    """Where each bracket of a text closes; looked up once, when first asked."""

    def __init__(self, text: str):
        self.text, self.closes = text, None

    def close(self, at: int) -> int:
        if self.closes is None:
            self.closes, open_ = {}, []
            for m in BRACKET.finditer(self.text):
                c = m[0]
                if c in "{[":
                    open_.append((c, m.start()))
                elif c in "}]" and open_ and open_[-1][0] == ("{" if c == "}" else "["):
                    self.closes[open_.pop()[1]] = m.start()
        return self.closes.get(at, -1)


def assignments(text: str) -> Iterator[Assignment]:
    """All assignments, in the order of their names; nested ones too."""
    brackets = _Brackets(text)
    around: list[tuple[int, str]] = []  # mappings that are open: where they close, and their keys
    under: list[tuple[int, str]] = []  # the same by indentation
    named: str | None = None
    for x in _plain(text, brackets, around, under):
        yield x
        key = x.name.rsplit(".", 1)[-1].lower()
        if key == "value" and named:
            yield x._replace(name=named)
        elif key in SAYS_NOTHING and (around or under):
            yield x._replace(name=(around or under)[-1][1])
        first = x.parts[0] if len(x.parts) == 1 else None
        named = text[first.start : first.end] if first and key in NAMED and IDENTIFIER.match(text[first.start : first.end]) else None


def _plain(text: str, brackets: _Brackets, around: list[tuple[int, str]], under: list[tuple[int, str]]) -> Iterator[Assignment]:
    """Assignments as they are written; ``around`` and ``under`` follow the mappings that the place is in."""
    at = before = 0
    lost = False
    while m := HEAD.search(text, at):
        before, at = at, m.end()
        while around and around[-1][0] < m.start():
            around.pop()
        line = text.rfind("\n", before, m.start()) + 1
        if line or not before:
            lead = LEAD.match(text, line)
            while under and m.start() <= lead.end() and under[-1][0] >= len(lead[1]):
                under.pop()
        if m["element"] is not None:
            given = {a.group(1).lower(): a for a in ATTRIBUTE.finditer(text, m.start("attributes"), m.end("attributes"))}
            spans = {k: (a.span(2) if a.group(2) is not None else a.span(3)) for k, a in given.items()}
            named = next((text[slice(*spans[k])] for k in ("name", "key", "id", "property") if k in spans), None)
            for k, (a, b) in spans.items():
                if k not in NAMED:
                    yield Assignment(m.start(), named if k == "value" and named else k, (Part(a, b),))
            inside = m["inside"].strip()
            span = None
            if inside and text.startswith("</", at):
                a = m.start("inside") + m["inside"].index(inside)
                span = Part(a, a + len(inside))
            elif not inside and not lost and text.startswith("<![CDATA[", at):
                end = text.find("]]>", at)
                lost = end < 0
                if not lost:
                    a = at + 9
                    held = text[a:end]
                    span = Part(a + len(held) - len(held.lstrip()), end - len(held) + len(held.rstrip()))
            if span:
                yield Assignment(m.start(), m["element"], (span,))
                if named:
                    yield Assignment(m.start(), named, (span,))
            # What an element holds may be source text itself.
            at = m.end("attributes") if m["inside"] else at
            continue
        name = m["name"] or m["quoted"] or m["dollar"] or m["flag"] or m["defined"] or m["first"]
        if m["op"] == ":" and (block := BLOCK_SCALAR.match(text, at)):
            yield Assignment(m.start(), name, tuple(_block_scalar(text, block.end(), m.start())))
            continue
        if here := HERE_DOCUMENT.match(text, at):
            yield Assignment(m.start(), name, tuple(_here_document(text, here)))
            continue
        # Words without quotes are values after a colon, after = without spaces, in flags and definitions.
        spaced = m["op"] == "=" and text[m.end() - 2 : m.end() - 1] in " \t" and text[at : at + 1] in " \t"
        configuration = m["op"] is None or m["op"] == ":" or m["op"] == "=" and not spaced
        opens = BLANK.match(text, at).end()
        opens = opens + 2 if text.startswith("[]", opens) else opens
        if typed := TYPED.match(text, opens):
            opens = typed.end()
        if text[opens : opens + 1] in ("{", "["):
            close = brackets.close(opens)
            if close > 0:
                around.append((close, name))
            members = _members(text, opens, configuration)[0] if text[opens] == "[" or not KEY_FOLLOWS.match(text, opens + 1) else []
            for parts in members:
                yield Assignment(m.start(), name, parts)
            if not members:
                yield Assignment(m.start(), name, ())
            continue
        if m["op"] == ":" and (rest := EMPTY_LINE.match(text, at)):
            lead = LEAD.match(text, line) if line or not before else None
            indent = len(lead[1]) if lead and m.start() <= lead.end() else -1
            yield Assignment(m.start(), name, ())
            if indent >= 0:
                under.append((indent, name))
                for parts in _items(text, rest.end(), indent):
                    yield Assignment(m.start(), name, parts)
            continue
        names = [name]
        if m["op"] in ("=", ":=") and text[max(before, m.start() - 2) : m.start()].rstrip(" \t").endswith(","):
            if (tuple_ := TARGETS.match(text, line if line or not before else before, m.start())) and tuple_.end() == m.start():
                names = [*re.findall(_ID, tuple_["names"], re.A), name]
        got = _value(text, at, configuration)
        begin = got.begin
        for k, target in enumerate(names):
            for parts in got.either or [()]:
                yield Assignment(m.start(), target, parts)
            if k + 1 < len(names):
                if not (comma := COMMA.match(text, got.end)):
                    break
                got = _value(text, comma.end(), False)
        at = begin
