import random
from collections import defaultdict

import numpy as np
import pytest
from loomwright.llm import near_dedup as nd
from loomwright.llm.common import Workspace
from loomwright.llm.components import _star, components
from pyspark.sql import functions as F

AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def brute(rows):
    sets, root = [], {}
    for i, t in rows:
        w = (t or "").encode().translate(AZ).split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


def test_families_match_brute_force(documents):
    """Exact copies, light and heavy edits, chains and short texts."""
    rng = random.Random(5)
    rows, i = [], 0
    for family in range(6):
        words = [f"w{family}x{k}" for k in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(25):
            rows.append((i := i + 1, edited(rng, words, rng.choice([0, 0, 1, 1, 2, 3, 5, 9]))))
    chain = [f"c{k}" for k in range(200)]
    for k in range(12):  # each is near the next alone
        chain = chain[4:] + [f"d{k}x{j}" for j in range(4)]
        rows.append((i := i + 1, " ".join(chain)))
    rows += [(i + 1, "a b"), (i + 2, "A  B"), (i + 3, "a b c"), (i + 4, ""), (i + 5, None), (i + 6, "É b"), (i + 7, "é b"), (i + 8, " ")]
    root, n = brute(rows)
    got = nd.near_duplicates(documents(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root
    assert {r["doc_id"]: r["n_shingles"] for r in got} == n
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_bucket_is_cut_into_blocks(documents, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(150)]
    rows = [(i, edited(rng, words, i % 4)) for i in range(120)]
    root, _ = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(documents(rows)).collect()} == root


def family(rng, n, words=150, kinds=2):
    """Near copies of a few texts that are near enough to share buckets and too far apart to be linked, and strays between them."""
    base = [f"w{k}" for k in range(words)]
    texts = [base, base[:120] + [f"x{k}" for k in range(30)]][:kinds]
    return [(i, edited(rng, texts[i % kinds], rng.choice([0, 1, 2, 4]))) for i in range(n)]


@pytest.mark.parametrize("finds", ["all", "last", "representatives"])
def test_no_link_hangs_on_one_way_to_find_it(spark, documents, monkeypatch, finds):
    """What the forests propose only saves work: without them the tiles find the same components."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "HOT_BUCKET", 4)  # buckets are salted
    if finds != "all":  # nothing is proposed in blocks, and all buckets stay open
        monkeypatch.setattr(nd, "_first_pairs", lambda buckets, nodes, percent: spark.createDataFrame([], nd.PROPOSED))
        monkeypatch.setattr(nd, "_unsettled", lambda buckets, proposed: buckets)
    if finds == "last":
        monkeypatch.setattr(nd, "_representative_pairs", lambda mixed, nodes, percent: spark.createDataFrame([], nd.PAIRS))
    rows = family(random.Random(6), 60)
    root, _ = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(documents(rows)).collect()} == root
    assert 1 < len(set(root.values())) < 30


def test_a_group_gives_out_no_more_than_its_rows():
    """Rows alike give a forest, and rows left open give rows: never all pairs."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: 300 - k % 7], rng.integers(0, 2**63, k % 7, dtype=np.uint64)]) for k in range(80)]
    t = {
        "group": 1, "fp": [bytes([k]) * 16 for k in range(80)], "sketch": np.stack([np.frombuffer(nd.odd_sketch(nd.minhashes(s)), np.uint64) for s in sets]),
        "n_shingles": np.array([len(s) for s in sets]), "side": np.zeros(80, int), "parity": [nd.parity(s) for s in sets],
    }
    most = nd.fewest_agreeing()
    assert len(nd._forest_pairs(t, most, 85)) == 79 and all(more for *_, more in nd._forest_pairs(t, most, 85))
    labelled = t | {"label": np.arange(80) % 5}
    assert len(nd._forest_pairs(labelled, most, 85)) == 4 and len(nd._left_open(labelled, most, 85)) == 80


def made(df):
    """Rows that each join and generator of df's plan made when it ran."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        if "Join" in kind or "Generate" in kind:
            out.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return out


@pytest.mark.parametrize("large", [True, False])
def test_a_star_makes_no_more_rows_than_links(spark, large):
    """However many links a group's forests give, a round's joins make each of them once."""
    rng = random.Random(4)
    links = {(max(p), min(p)) for p in (rng.sample(range(60), 2) for _ in range(900))}
    got = _star(spark.createDataFrame(sorted(links), "a long, b long").repartition(3).localCheckpoint(), large)
    assert 0 < max(made(got)) <= len(links)
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    if large:
        want = {(u, min(v, *near[v])) for v in near for u in near[v] if u > v}
    else:
        want = {(u, min(x for x in near[v] if x < v)) for v in near for u in {v, *near[v]} if u <= v and min(near[v]) < v}
    assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a, b in want if a != b}


def test_later_components_start_from_one_link_a_node(documents, monkeypatch):
    """Bands give a large group many links a node; once they are components, no step reads them again."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    read = []
    monkeypatch.setattr(nd, "components", lambda links, work, name: read.append((name, links.count())) or components(links, work, name))
    # Another link within each component, so that there is a last step whatever the forests found.
    last = nd._last_links
    within = lambda mixed: mixed.groupBy("label").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).select("a", "b")
    monkeypatch.setattr(nd, "_last_links", lambda mixed, *rest: last(mixed, *rest).unionByName(within(mixed)))
    rows = family(random.Random(6), 120)
    root, _ = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(documents(rows)).collect()} == root
    counts = dict(read)
    assert counts["third"] < len(rows) < counts["first"]


def test_components_of_long_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(0, 300)]
    hub = [(1000, 1000 + k) for k in range(1, 200)]
    links = spark.createDataFrame([*chain, *hub, (5, 5), (1, 0)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links, Workspace(spark, "test"), "c").collect()}
    assert got == {**{k: 0 for k in range(301)}, **{k: 1000 for k in range(1000, 1200)}}
    assert components(links.limit(0), Workspace(spark, "test"), "c").count() == 0


def test_parity_never_overstates():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 300, 900, 5000)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(0, 2**63, max(1, len(s) // 9), dtype=np.uint64)]) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    low = nd.fewest_differing([nd.parity(s) for s in sets], i, j)
    for a, b, x in zip(i, j, low, strict=True):
        assert x <= len(np.setxor1d(sets[a], sets[b]))


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(2)
    most = nd.fewest_agreeing()
    for _ in range(40):
        base = rng.integers(0, 2**63, 400, dtype=np.uint64)
        other = np.r_[base[:380], rng.integers(0, 2**63, 10, dtype=np.uint64)]
        x, y = (np.frombuffer(nd.odd_sketch(nd.minhashes(np.unique(s))), np.uint64) for s in (base, other))
        assert np.bitwise_count(x ^ y).sum() <= most
    x, y = (np.frombuffer(nd.odd_sketch(nd.minhashes(np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)))), np.uint64) for _ in range(2))
    assert np.bitwise_count(x ^ y).sum() > most


def test_hard_rows(hard, clashing):
    got = nd.near_duplicates(clashing(hard)).collect()
    assert len(got) == 9
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["component_id"] == i for i in (1, 2, 3))
    assert [r["component_id"] for r in by[5] + by[6]] == [5, 5, 5] and not by[6][0]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    assert nd.near_duplicates(hard.limit(0)).count() == 0
    kept = nd.keep_one_of_each(clashing(hard))
    assert kept.columns == clashing(hard).columns and kept.count() == 8


def test_two_texts_under_one_id(documents):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (1, "quite another text under the same id here"), (2, "Quite another text under the same id here"), (3, "no relation at all to any of these")]
    got = {(r["doc_id"], r["component_id"]) for r in nd.near_duplicates(documents(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


@pytest.mark.parametrize("n", [1, 4, 5, 6])
def test_short_texts_are_one_shingle(n):
    assert len(nd.shingles([b"x%d" % k for k in range(n)])) == max(1, n - 4)
