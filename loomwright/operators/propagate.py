"""Propagation: the base's keys, date and targets carried along foreign keys into every table in reach.

Two phases. The first walks the key graph over spines: base columns and the keys that lead on,
and nothing else of a table. A table's rows are counted from how many share a key, without
joining them one by one: through a key of few values there are as many pairs as the product of
both sides. Spines that lead on are written to the shared folder and joined to the next level. The second, when features are bound, joins the spine before a table with the
columns that these features use (``Propagated.df`` is that join, not yet computed: what is not
selected from it isn't read).
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import quoted
from ..settings import Settings
from ..sources.catalog import Catalog
from ..sources.keys import ForeignKey, both_ways
from ..sources.store import Store
from .base import DATE, FOLD, base_ids, base_keys, base_targets
from .temporal import bounds, find_constraint, span_of, window

#: Slots of the sketch that finds heavy keys.
SLOTS = 1 << 14
#: Salts of a heavy key for each partition: few enough to copy, many enough to even out.
SALTS = 4
#: How many rows of a table a row of counts stands for.
ROWS = "propagated_rows"


def path_hash(path: str) -> str:
    """Twelve characters that name a path of keys, the same on each run."""
    return hashlib.sha256(path.encode()).hexdigest()[:12]


@dataclass
class Propagated:
    """A table joined with the base: all its columns beside the base's, of which only those that are selected are read."""

    name: str
    table: str
    df: DataFrame
    path: tuple[str, ...]
    key: ForeignKey | None = None
    temporal: str | None = None
    is_id_unique: bool = False
    is_target_id_unique: bool = False
    rows: int = 0
    #: The most rows that a base id has.
    most: int = 1
    candidates: list[str] = field(default_factory=list)
    #: Why the window is as it is, when the table was begun, and how many seconds it took.
    reasoning: str = ""
    start: datetime | None = None
    run_time: float = 0.0
    #: Base columns and the table's own keys: what the next level is joined to; none where nothing is.
    spine: DataFrame | None = None
    #: The table's id columns, which settle ties.
    ids: tuple[str, ...] = ()


def base_columns(s: Settings) -> list[str]:
    return [*base_keys(s), *base_targets(s), FOLD]


def _slot(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*(F.col(quoted(c)) for c in columns)), F.lit(SLOTS)).cast("int")


def heavy_slots(df: DataFrame, columns: list[str], rows: int) -> set[int]:
    """The slots of a count sketch over keys that hold more rows than so many: all keys of more rows are in one. SLOTS counts at most leave a task."""
    known = df.filter(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns))
    return {r["slot"] for r in known.groupBy(_slot(columns).alias("slot")).agg(F.count("*").alias("n")).filter(F.col("n") > rows).collect()}


def _spread(left: DataFrame, right: DataFrame, own: list[str], theirs: list[str], rows: int, unique: tuple[bool, bool] = (False, False)) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides of a join with ``_salt``, if a key is heavy on one: its rows there have one of many salts, on the other side a copy for each.

    Keys of unlike types hash unlike: such joins are left as they are. A side whose keys are known to be unique isn't looked at.
    """
    if [left.schema[c].dataType for c in own] != [right.schema[c].dataType for c in theirs]:
        return left, right, False
    many_right = set() if unique[1] else heavy_slots(right, theirs, rows)
    many_left = set() if unique[0] else heavy_slots(left, own, rows) - many_right
    if not many_right and not many_left:
        return left, right, False
    salts = SALTS * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def salted(df: DataFrame, columns: list[str], many: set[int], other: set[int]) -> DataFrame:
        among = lambda x: F.col("_slot").isin(sorted(x)) if x else F.lit(False)
        df = df.withColumns({"_slot": _slot(columns), "_number": F.monotonically_increasing_id()})
        one = F.when(among(many), F.pmod("_number", F.lit(salts)).cast("int")).otherwise(F.lit(0))
        each = F.when(among(other), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(one))
        return df.withColumn("_salt", F.explode(each)).drop("_slot", "_number")

    return salted(left, own, many_left, many_right), salted(right, theirs, many_right, many_left), True


def join_on(
    before: DataFrame, table: DataFrame, own: list[str], theirs: list[str], s: Settings, temporal: str | None, span: tuple[datetime, datetime] | None = None, heavy: int | None = None,
    unique: tuple[bool, bool] = (False, False),
) -> DataFrame:
    """Base columns of ``before`` beside all of ``table``, where the key agrees and the time is in the window.

    With the span of base dates, rows of ``table`` that no window holds are left to its scan. Keys
    with more rows than ``heavy`` are dealt over salts, but not on a side whose keys are ``unique``. A key that is a base id is joined by its
    name there: rows then lie by base row, and what groups them by it needs no shuffle of its own.
    """
    names = {c: c if c in base_ids(s) else f"_k{i}" for i, c in enumerate(own)}
    left = before.select(*base_columns(s), *(F.col(quoted(c)).alias(a) for c, a in names.items() if a != c))
    if temporal and span:
        table = table.filter(bounds(temporal, table.schema[temporal].dataType, span, s))
    right = table.select("*", *(F.col(quoted(c)).alias(f"_f{i}") for i, c in enumerate(theirs)))
    ours, other = [names[c] for c in own], [f"_f{i}" for i in range(len(own))]
    left, right, salted = _spread(left, right, ours, other, heavy, unique) if heavy else (left, right, False)
    on = [left[a] == right[b] for a, b in zip(ours, other, strict=True)] + ([left["_salt"] == right["_salt"]] if salted else [])
    out = left.join(right, on, "inner").drop(*(a for c, a in names.items() if a != c), *other, *(["_salt"] if salted else []))
    return out.filter(window(temporal, s)) if temporal else out


def first_table(base: DataFrame, catalog: Catalog) -> Propagated:
    """The target table itself, beside its base rows."""
    s = catalog.settings
    table = catalog.tables[s.target_table].df
    own = [*base_ids(s), *([DATE] if s.target_date else [])]
    theirs = [*s.target_ids, *([s.target_date] if s.target_date else [])]
    left = base.select(*base_columns(s), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(own)))
    right = table.select("*", *(F.col(c).alias(f"_f{i}") for i, c in enumerate(theirs)))
    df = left.join(right, [left[f"_k{i}"].eqNullSafe(right[f"_f{i}"]) for i in range(len(own))]).drop(*(f"_k{i}" for i in range(len(own))), *(f"_f{i}" for i in range(len(own))))
    name = f"propagated_{s.target_table}_{path_hash(s.target_table)}"
    return Propagated(name, s.target_table, df, (s.target_table,), is_target_id_unique=True, reasoning="the target table itself", start=datetime.now(), ids=tuple(c.name for c in catalog.tables[s.target_table].columns.values() if c.is_id))


def counted(table: DataFrame, columns: list[str], unique: bool) -> DataFrame:
    """The columns and, as ROWS, how many rows share them; one each where they are unique."""
    keys = table.select(*(quoted(c) for c in columns))
    return keys.withColumn(ROWS, F.lit(1).cast("long")) if unique else keys.groupBy(*(quoted(c) for c in columns)).agg(F.count("*").alias(ROWS))


def _shape(df: DataFrame, s: Settings) -> tuple[int, int]:
    """How many rows there are, and the most that a base id has; each stands for ROWS."""
    got = df.groupBy(*base_ids(s)).agg(F.sum(ROWS).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    return got["rows"] or 0, got["most"] or 0


def propagate(base: DataFrame, catalog: Catalog, now: datetime | None = None, persist: bool = True, store: Store | None = None) -> list[Propagated]:
    """Breadth first over the key graph from the target table.

    At each level every key from a table of the last level to a table not reached before
    gives a propagated table of its own, so that parallel keys give several. It ends when
    nothing is new or at the depth limit. A table that the window leaves empty is joined
    without it; one that is empty still is not followed. persist writes the spines that lead on to
    the shared folder; without it they are computed again wherever they are read.
    """
    s = catalog.settings
    keys = both_ways(catalog.keys)
    store = (store or Store(base.sparkSession, "propagation")) if persist else None
    span = span_of(base) if s.target_date else None
    lead_on = lambda t: list(dict.fromkeys(c for k in keys if k.table == t for c in k.columns))
    first, began = first_table(base, catalog), time.perf_counter()
    first.spine = first.df.select(*base_columns(s), *(quoted(c) for c in lead_on(s.target_table)))
    first.spine = store.keep(first.spine, f"spine-{first.name}") if store else first.spine
    first.rows, first.run_time = first.spine.count(), time.perf_counter() - began
    out, level, reached = [first], [first], {s.target_table}
    for depth in range(s.max_depth):
        new: list[Propagated] = []
        for before in level:
            for k in keys:
                if k.table != before.table or k.f_table in reached:
                    continue
                table, start, began = catalog.tables[k.f_table], datetime.now(), time.perf_counter()
                # Unique in the table it leads to: one row of it for each row before.
                unique = catalog.is_unique(k.f_table, k.f_columns)
                temporal = find_constraint(catalog, k.f_table, base, unique, now, span)
                candidates = table.of_kind("temporal")
                why = "no target date" if not s.target_date else f"{temporal} leaves the most rows" if temporal else "one row for each row before" if unique else "no column that fits" if candidates else "no column with a time"
                path = (*before.path, f"{','.join(k.columns)}>{k.f_table}.{','.join(k.f_columns)}")
                name = f"propagated_{k.f_table}_{path_hash('/'.join(path))}"

                # In the target table itself the base's ids are its own.
                own = [dict(zip(s.target_ids, base_ids(s), strict=True)).get(c, c) if before is first else c for c in k.columns]

                one = before is first and set(base_keys(s)) <= set(own)

                def joined(rows: DataFrame, temporal: str | None, single: bool) -> DataFrame:
                    return join_on(before.spine, rows, own, list(k.f_columns), s, temporal, span, s.heavy_key_rows if persist else None, (one, single))  # noqa: B023

                def shape(temporal: str | None) -> tuple[int, int]:
                    columns = list(dict.fromkeys([*k.f_columns, *([temporal] if temporal else [])]))  # noqa: B023
                    return _shape(joined(counted(table.df, columns, unique), temporal, unique or len(columns) == len(set(k.f_columns))), s)  # noqa: B023

                rows, most = shape(temporal)
                if not rows and temporal:
                    temporal, why = None, f"{temporal} leaves no row"
                    rows, most = shape(None)
                if not rows:
                    continue
                ids = tuple(c.name for c in table.columns.values() if c.is_id)
                new.append(Propagated(name, k.f_table, joined(table.df, temporal, unique), path, k, temporal, unique, most <= 1, rows, most, candidates, why, start, time.perf_counter() - began, ids=ids))
        if not new:
            break
        out += new
        reached |= {p.table for p in new}
        # Only now it is known where each of them leads.
        level = [p for p in new if any(k.table == p.table and k.f_table not in reached for k in keys)] if depth + 1 < s.max_depth else []
        for p in level:
            began = time.perf_counter()
            p.spine = p.df.select(*base_columns(s), *(quoted(c) for c in lead_on(p.table)))
            if store:
                p.spine = store.keep(p.spine, f"spine-{p.name}")
            p.run_time += time.perf_counter() - began
    return out
