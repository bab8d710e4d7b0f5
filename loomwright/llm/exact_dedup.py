"""Exact deduplication: Grace hashing, with open-addressing tables that compare complete content.

1. Each map task passes its rows through a table of bounded size. A content that it holds
   already becomes a member of the record that it holds; a full table is emptied. So thousands
   of copies leave a task as one record and light members, however frequent the content is.
2. Records are dealt to buckets by a hash of their content. A bucket fills a table up to its
   bound; records whose content is in it are settled, the others spill with their content to
   a file in the shared folder.
3. What has spilt is dealt anew, by another hash and to as many buckets as its size asks for,
   until nothing spills. Each bucket settles one content at least, so this ends.
4. Members learn their group from their record, in a join in which no key has more rows than
   one task has read.

A table compares hash first and then the whole content, so that contents of one hash stay
apart. It holds distinct contents only: a bucket's copies pass by. Texts are shuffled once,
and once more for each further level; members carry no text.

Defined results: null counts as the empty text, and texts of white space alone are equal to
it; of rows that agree in length and id one stays; a null id comes after all others; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, quoted, shuffle_width, small_batches

#: Bytes of distinct content that a table holds: of a map task's, and of a bucket's.
MAP_BYTES, BUCKET_BYTES = 32 << 20, 64 << 20
#: Buckets of a further level, at most, for each partition that a shuffle has; what they can't hold spills again.
MOST_BUCKETS = 8
#: What an entry costs besides its content.
ENTRY_BYTES = 200
WHITE = b" \t\n\v\f\r"
#: (name, type); id stands for the id column's own type. m: member, g: settled record, o: spilt record.
COLUMNS = [
    ("kind", "string"), ("row", "long"), ("id", "id"), ("rep", "long"), ("h", "long"), ("content", "binary"), ("n", "long"), ("best_chars", "long"), ("best_id", "id"), ("best_row", "long"), ("sha", "string"),
]
NAMES = [c for c, _ in COLUMNS]


def content_hash(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content)


class Table:
    """Open addressing with linear probing over complete contents; each has a number, in order of arrival."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents, self.bytes = [-1] * 1024, [], [], 0

    def find(self, h: int, content: bytes) -> int:
        """The content's number, or where it would stand, as a negative number."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            at = (at + 1) & mask
        return -1 - at

    def add(self, at: int, h: int, content: bytes) -> int:
        """Puts a content where ``find`` has said."""
        self.slots[-1 - at] = number = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + ENTRY_BYTES
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return number

    def _grow(self) -> None:
        size = 4 * len(self.slots)
        self.slots, mask = [-1] * size, size - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def better(a: tuple, b: tuple) -> bool:
    """Whether (chars, id, row) a stays rather than b: more characters, then the lesser id, null last, then the earlier row."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] != b[1]:
        return b[1] is None or (a[1] is not None and a[1] < b[1])
    return a[2] < b[2]


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "id": id_type}
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, COLUMNS, strict=True)], names=NAMES)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _combine(bound: int, hash_of: Callable[[bytes], int]):
    """Rows (row, id, chars, text) as members and records of a map task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first, best, count = Table(), [], [], []
        id_type = None

        def emptied() -> list[tuple]:
            out = [("r", f[0], f[1], f[0], _signed(h), c, n, *b, None) for f, h, c, n, b in zip(first, table.hashes, table.contents, count, best, strict=True)]
            first.clear(), best.clear(), count.clear()
            return out

        for t in batches:
            id_type = t.schema.field("id").type
            out = []
            for row, id_, chars, text in zip(*(t[c].to_pylist() for c in ("row", "id", "chars", "text")), strict=True):
                content = text.translate(None, WHITE)
                h = hash_of(content)
                e = table.find(h, content)
                if e < 0:
                    if table.hashes and table.bytes + len(content) > bound:
                        out += emptied()
                        table = Table()
                        e = table.find(h, content)
                    table.add(e, h, content)
                    first.append((row, id_)), best.append((chars, id_, row)), count.append(1)
                else:
                    count[e] += 1
                    if better((chars, id_, row), best[e]):
                        best[e] = (chars, id_, row)
                    # Members are dealt by their row: a group of any size is spread.
                    out.append(("m", row, id_, first[e][0], row, None, None, None, None, None, None))
            if out:
                yield _batch(out, id_type)
        if out := emptied():
            for at in range(0, len(out), 512):
                yield _batch(out[at : at + 512], id_type)

    return run


def _settle(bound: int):
    """A bucket's records: those whose content fits the table are settled, the others spill; members pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, records, best, count = Table(), [], [], []
        id_type = None
        for t in batches:
            id_type = t.schema.field("id").type
            rows = list(zip(*(t[c].to_pylist() for c in NAMES), strict=True))
            out = [r for r in rows if r[0] == "m"]
            for r in rows:
                if r[0] == "m":
                    continue
                _, row, id_, _, h, content, n, *b, _ = r
                e = table.find(h & (1 << 64) - 1, content)
                if e < 0 and table.hashes and table.bytes + len(content) > bound:
                    out.append(("o", *r[1:]))
                    continue
                if e < 0:
                    e = table.add(e, h & (1 << 64) - 1, content)
                    records.append([]), best.append(tuple(b)), count.append(0)
                count[e] += n
                records[e].append((row, id_))
                if better(tuple(b), best[e]):
                    best[e] = tuple(b)
            if out:
                yield _batch(out, id_type)
        out = []
        for content, own, b, n in zip(table.contents, records, best, count, strict=True):
            sha = hashlib.sha256(content).hexdigest()
            out += [("g", row, id_, row, None, None, n, *b, sha) for row, id_ in own]
            if len(out) >= 4096:
                yield _batch(out, id_type)
                out = []
        if out:
            yield _batch(out, id_type)

    return run


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", map_bytes: int = MAP_BYTES, bucket_bytes: int = BUCKET_BYTES, hash_of: Callable[[bytes], int] = content_hash
) -> DataFrame:
    """One row for each row of docs: its id, keep_id (the id of the row that stays), group_size, kept, text_sha256 (of the text without white space)."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "exact-dedup")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join(f"{c} {id_type if t == 'id' else t}" for c, t in COLUMNS)
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("id"), F.char_length(text).cast("long").alias("chars"), text.cast("binary").alias("text"))
    dealt = rows.mapInArrow(_combine(map_bytes, hash_of), schema).repartition(shuffle_width(spark), "h")
    level = work.keep(dealt.mapInArrow(_settle(bucket_bytes), schema), "level-0")
    members, settled, k = level.filter("kind = 'm'"), level.filter("kind = 'g'"), 0
    while spilt := level.filter("kind = 'o'").agg(F.sum(F.length("content") + ENTRY_BYTES)).first()[0]:
        k += 1
        buckets = min(1 + 2 * spilt // bucket_bytes, MOST_BUCKETS * shuffle_width(spark))
        again = level.filter("kind = 'o'").repartition(buckets, F.xxhash64("h", F.lit(k)))
        level = work.keep(again.mapInArrow(_settle(bucket_bytes), schema), f"level-{k}")
        settled = settled.unionByName(level.filter("kind = 'g'"))
    groups = settled.filter("n > 1").select("row", "n", "best_id", "best_row", "sha").withColumnRenamed("row", "rep")
    found = settled.select("row", "id", "n", "best_id", "best_row", "sha").unionByName(members.select("row", "id", "rep").join(groups, "rep").drop("rep"))
    return found.select(F.col("id").alias(id_col), F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, columns as they were; ids must be unique and not null."""
    kept = deduplicate(docs, id_col, text_col).filter("kept").select(F.col(quoted(id_col)).alias("_kept"))
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row"), F.col(quoted(id_col)).alias("_id"))
    return rows.join(kept, F.col("_id") == F.col("_kept"), "left_semi").select("_row.*")
