"""Exact deduplication against brute force and SQL."""

import hashlib
import random

import pytest

from loomwright.llm import exact_dedup, oracle, queries

FOLDER = "/root/testdata/sf0.001"
WHITE = str.maketrans("", "", " \t\n\v\f\r")


def brute(rows):
    groups = {}
    for k, (id_, text) in enumerate(rows):
        groups.setdefault((text or "").translate(WHITE), []).append((-len(text or ""), id_ is None, id_ or 0, k))
    out = []
    for content, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        sha = hashlib.sha256(content.encode()).hexdigest()
        out += [(None if m[1] else m[2], keep, len(members), sha) for m in members]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


def test_query_matches_sql(spark, duck, same):
    same(queries.QUERIES["op11_exact_dedup"](spark, FOLDER).toPandas(), duck.execute(oracle.EXACT).df())


@pytest.fixture(scope="module")
def copies():
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab \t\n") for _ in range(draw.randrange(9))) for _ in range(300)]
    hot = ["the same\nline"] * 200 + ["the  same line "] * 3
    return list(enumerate(texts + hot)) + [(7, "a b"), (7, "a b"), (None, "ab"), (None, None), (900, None)]


@pytest.mark.parametrize("bounds", [{}, {"map_bytes": 1000, "bucket_bytes": 1200}, {"map_bytes": 1, "bucket_bytes": 4000}])
def test_equals_brute_force_at_any_bound(spark, documents, copies, bounds):
    """Bounds of a few contents empty tables often and spill over many levels."""
    df = documents(copies).repartition(3)
    out = exact_dedup.deduplicate(df, **bounds)
    assert got(out) == brute(copies)
    rows = out.collect()
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})


def test_contents_of_one_hash_stay_apart(spark, documents):
    rows = [(k, f"text {k % 40}") for k in range(120)]
    out = exact_dedup.deduplicate(documents(rows), bucket_bytes=2000, hash_of=lambda content: 5)
    assert got(out) == brute(rows)


def test_table_compares_content_and_grows():
    t = exact_dedup.Table()
    for k in range(3000):
        content = str(k).encode()
        at = t.find(k % 7, content)
        assert at < 0 and t.add(at, k % 7, content) == k
    assert all(t.find(k % 7, str(k).encode()) == k for k in range(3000))
    assert len(t.slots) >= 6000


def test_hard_rows_clashing_columns_and_no_rows(spark, documents, hard, clashing):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert got(exact_dedup.deduplicate(clashing(hard))) == brute(rows)
    assert exact_dedup.deduplicate(documents([])).count() == 0
    odd = documents([(1, "a b"), (2, "ab")]).withColumnsRenamed({"doc_id": "a.b", "text": "t`x"})
    assert [r["kept"] for r in exact_dedup.deduplicate(odd, "a.b", "t`x").orderBy("keep_id", "kept").collect()] == [False, True]


def test_the_longest_stays_then_the_least_id(spark, documents):
    out = exact_dedup.deduplicate(documents([(4, "a b"), (2, "ab"), (3, "a  b"), (1, "b")]))
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in out.collect()} == {4: (3, False), 2: (3, False), 3: (3, True), 1: (1, True)}


def test_kept_rows_come_back_whole(spark, documents):
    df = documents([(1, "x y"), (2, "xy"), (3, "z")])
    assert sorted(map(tuple, exact_dedup.keep_one_of_each(df).collect())) == sorted(map(tuple, df.filter("doc_id <> 2").collect()))
