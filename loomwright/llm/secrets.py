"""Secret scan by assignment-aware lexing.

Three fixed shapes form the base (assignments to a secret-like name, access key ids, long
lower-case hexadecimal runs). On top of them ``lexing`` reads the text as source or
configuration into names and the literals and names they are given; constants are followed
forwards and backwards, through any number of joined parts, and every literal is scored by
how sensitive the name is that it ends up in.

Defined results: a null or empty text has no spans; spans are in code points with an
exclusive end; a name that is given several values stands for the last one before each use,
or the first one after it; rows are judged one by one, so repeated rows give repeated
results, and extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, small_batches
from .lexing import Assignment, Part, assignments

#: Base kinds, in the order that breaks ties between spans with one start.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]{24,}")),  # a run is maximal, so shorter ones can be passed over at once
)
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = {"assign": 0, "access": 1, "hex": 2, "pair": 3}

#: Parts of a name that make it sensitive, or less so.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pass": 0.7, "pwd": 0.9, "pin": 0.4, "secret": 1.0, "secrets": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8, "bearer": 0.8,
    "authorization": 0.8, "auth": 0.5, "private": 0.5, "key": 0.5, "access": 0.2, "api": 0.2, "signing": 0.4,
    "encryption": 0.4, "client": 0.1, "webhook": 0.3, "salt": 0.6, "session": 0.3, "jwt": 0.8,
}
HARMLESS = {
    "public": 0.7, "name": 0.5, "file": 0.6, "path": 0.6, "url": 0.5, "uri": 0.5, "length": 0.8, "len": 0.8, "count": 0.8, "size": 0.8,
    "type": 0.6, "min": 0.6, "max": 0.6, "limit": 0.7, "expiry": 0.7, "expires": 0.7, "ttl": 0.7, "enabled": 0.8, "field": 0.6,
    "column": 0.6, "primary": 0.7, "foreign": 0.7, "sort": 0.7, "index": 0.6, "id": 0.3, "label": 0.7, "prompt": 0.7, "hint": 0.7,
}
PLACEHOLDER_WORD = re.compile(r"null|none|nil|true|false|undefined|changeme|change_me|example|sample|dummy|placeholder|redacted|required|optional|string|todo|default", re.I)
PLACEHOLDER_START = re.compile(r"(?:your|my)[_-]", re.I)
PLACEHOLDER_INSIDE = re.compile(r"\*{3}|x{4}|\.{3}|<|>|\$\{|\{\{|%\(", re.I)
#: A lower-case text without any of these holds no assignment of the base, or no name that scores above 0.
NEEDED = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "pair": tuple(p for p in SENSITIVE if not any(q in p for q in SENSITIVE if q != p))}
PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[int, int, str]


def name_score(name: str) -> float:
    """0 to 1: how sensitive a target of that name is."""
    parts = [p.lower() for p in PIECES.findall(name.replace("apiKey", "apikey").replace("ApiKey", "Apikey"))]
    parts = [p[:-1] if p not in SENSITIVE and p[-1] == "s" and p[:-1] in SENSITIVE else p for p in parts]  # keys, tokens
    joined = "".join(parts)
    up = max((SENSITIVE[p] for p in parts if p in SENSITIVE), default=0.0)
    up += sum(sorted(SENSITIVE[p] for p in parts if p in SENSITIVE)[:-1]) * 0.7
    if "apikey" in joined or "privatekey" in joined or "accesskey" in joined or "secretkey" in joined:
        up = max(up, 1.0)
    return max(0.0, min(1.0, up) - sum(HARMLESS.get(p, 0.0) for p in parts))


class Shape:
    """What literal_score needs to know of a text, for texts that are joined from parts of any number."""

    __slots__ = ("length", "shares", "first", "last", "spaces", "placeholder")

    def __init__(self, text: str = ""):
        self.length = float(len(text))
        self.shares = {c: n / len(text) for c, n in Counter(text).items()}
        self.first, self.last = text[:16], text[-3:]
        self.spaces = any(c in " \t\n" for c in text)
        self.placeholder = PLACEHOLDER_INSIDE.search(text) is not None

    def __add__(self, other: Shape) -> Shape:
        if not other.length or not self.length:
            return self if self.length else other
        out = Shape()
        out.length = min(self.length + other.length, 1e300)
        mine = self.length / (self.length + other.length)
        out.shares = {c: mine * self.shares.get(c, 0.0) + (1 - mine) * other.shares.get(c, 0.0) for c in self.shares | other.shares}
        out.first = (self.first + other.first)[:16] if self.length < 16 else self.first
        out.last = (self.last + other.last)[-3:] if other.length < 3 else other.last
        out.spaces = self.spaces or other.spaces
        out.placeholder = self.placeholder or other.placeholder or PLACEHOLDER_INSIDE.search(self.last + other.first) is not None
        return out

    def score(self) -> float:
        """0 to 1: how much a literal looks like a secret and not like a word, number or placeholder."""
        if self.length < 6 or self.spaces or self.placeholder or len(self.shares) < 2:
            return 0.0
        if PLACEHOLDER_START.match(self.first) or self.length <= 16 and PLACEHOLDER_WORD.fullmatch(self.first):
            return 0.0
        entropy = -sum(p * math.log2(p) for p in self.shares.values() if p > 0)
        classes = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "_" for c in self.shares})
        return min(1.0, 0.25 * entropy * min(1.0, 0.55 + 0.15 * classes))


def literal_score(text: str) -> float:
    return Shape(text).score()


class Value:
    """What a name stands for: a literal, or values joined. Shared, never copied, by all that refer to it."""

    __slots__ = ("span", "of", "shape", "reported")

    def __init__(self, shape: Shape, span: tuple[int, int] | None = None, of: tuple[Value, ...] = ()):
        self.shape, self.span, self.of, self.reported = shape, span, of, False

    def report(self, into: set[tuple[int, int]]) -> None:
        """Adds the literals below that haven't been reported; each value is looked into once."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.reported:
                v.reported = True
                if v.span:
                    into.add(v.span)
                todo += v.of


NOTHING = Value(Shape())


def resolved(text: str, found: list[Assignment]) -> list[Value]:
    """Each assignment's value, constants followed.

    A name stands for what it was last given before, or where there is nothing before, for what
    it is first given after. A name that ends up in itself is nothing there.
    """
    of_name: dict[str, list[int]] = {}
    for k, x in enumerate(found):
        of_name.setdefault(x.name, []).append(k)
    out: list[Value | None] = [None] * len(found)
    open_ = [False] * len(found)

    def target(k: int, part: Part) -> int | None:
        places = of_name.get(part.name) or of_name.get(part.name.rsplit(".", 1)[-1]) or ()
        before = bisect_left(places, k)
        at = places[before - 1] if before else next((p for p in places if p != k), None)
        return at

    for first in range(len(found)):
        stack = [first]
        while stack:
            k = stack[-1]
            if out[k] is not None:
                stack.pop()
                continue
            wanted = [None if p.name is None else target(k, p) for p in found[k].parts]
            if not open_[k]:
                open_[k] = True
                more = [t for t in wanted if t is not None and out[t] is None and not open_[t]]
                if more:
                    stack += more
                    continue
            values = []
            for part, t in zip(found[k].parts, wanted, strict=True):
                if t is not None:
                    values.append(out[t] or NOTHING)
                elif part.name is None or part.bare:
                    values.append(Value(Shape(text[part.start : part.end]), (part.start, part.end)))
            out[k] = values[0] if len(values) == 1 else Value(reduce(add, (v.shape for v in values), Shape()), None, tuple(values))
            stack.pop()
    return out


def base_spans(text: str) -> list[Span]:
    found, low = [], text.lower()
    for kind, pattern in BASE:
        if not any(p in low for p in NEEDED.get(kind, ("",))):
            continue
        for m in pattern.finditer(text):
            if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS[s[2]]))


def pair_spans(text: str, least: float = 0.5) -> list[Span]:
    """Literals that end up under a sensitive name, straight, through constants or joined."""
    low = text.lower()
    if not any(p in low for p in NEEDED["pair"]):
        return []
    found = list(assignments(text))
    hows = [name_score(x.name) for x in found]
    if not any(hows):
        return []
    spans: set[tuple[int, int]] = set()
    for value, how in zip(resolved(text, found), hows, strict=True):
        if how and how * value.shape.score() >= least:
            value.report(spans)
    return sorted((a, b, "pair") for a, b in spans if b > a)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans, and all: a pair that lies within a base span adds nothing."""
    if not text:
        return [], []
    base = base_spans(text)
    more, reach, k = [], -1, 0
    for a, b, kind in pair_spans(text):
        while k < len(base) and base[k][0] <= a:
            reach, k = max(reach, base[k][1]), k + 1
        if b > reach:
            more.append((a, b, kind))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS[s[2]], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping spans replaced by the mark."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in ("assign", "access", "hex", "pair")]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


@F.pandas_udf(FOUND)
def _scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            base, spans = scan(text)
            n = Counter(s[2] for s in spans)
            rows.append((n["assign"], n["access"], n["hex"], n["pair"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        yield pd.DataFrame(rows, columns=FOUND.names)


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redacted, na_action="ignore").astype(object)


def scanned(text: str | Column) -> Column:
    """A struct of counts, digest and spans."""
    return _scanned(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, counts of spans, the digest of the base spans and all spans."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), scanned(text_col).alias("_found"))
    return rows.select(F.col("_id").alias(id_col), *(F.col(f"_found.{n}").alias(n) for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_pair")))


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets replaced by a mark; every row and column stays, the length column follows the text."""
    small_batches(docs.sparkSession)
    out = docs.withColumn(text_col, _redacted(text_col))
    return out.withColumn(chars_col, F.length(text_col).cast("long")) if chars_col and chars_col in docs.columns else out
