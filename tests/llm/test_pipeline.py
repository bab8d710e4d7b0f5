import random
import subprocess
import sys

import corpus_pipeline
import pytest
from loomwright.llm import near_dedup, secrets
from loomwright.llm.common import Workspace

from test_near_dedup import brute as components
from test_quality import brute as counts


def _corpus(documents):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(40)]
    texts += [texts[k] for k in range(8)] + [texts[8] + " tail", texts[9].upper().lower()]
    texts += ["#$% " * 60, "too short", None, "say " * 100, " ".join(word() for _ in range(50)) + ' password = "hunter2222"', " ".join(word() for _ in range(50)) + " 0123456789abcdef0123456789abcdef"]
    return documents([(k, t, rng.choice(["a", "b", None])) for k, t in enumerate(texts)])


def _kept_by_rules(text):
    """The rules written plainly."""
    import unicodedata

    n, chars, symbols, dup, repeated = counts(text)
    text = text or ""
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    kinds = len(set(text.split()))
    m = max(n, 1)
    bad = n < 20 or 100 * repeated > 30 * n or symbols * 100 > m * 30 or chars < m * 2 or chars > m * 20 or dup * 100 > len(text.split("\n")) * 50
    return not (bad or letters * 100 < chars * 50 or upper * 100 > letters * 60 or kinds * 100 < min(m, 200) * 10)


def test_stages_match_brute_force(spark, documents, tmp_path):
    docs = _corpus(documents)
    rows = {r["doc_id"]: r for r in docs.collect()}
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, None)
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        after.append(docs.collect())
        assert k == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rules = [i for i, r in rows.items() if _kept_by_rules(r["text"])]
    assert sorted(r["doc_id"] for r in after[0]) == sorted(rules)
    root, _ = components([(i, rows[i]["text"]) for i in rules])
    assert sorted(r["doc_id"] for r in after[1]) == sorted({i for i in rules if root[i] == i})
    assert {r["doc_id"]: r["text"] for r in after[2]} == {r["doc_id"]: secrets.redacted(r["text"]) for r in after[1]}
    assert any("[SECRET]" in r["text"] for r in after[2]) and all(len(r["text"]) == r["n_chars"] for r in after[2])
    left = {r["doc_id"]: r["text"] for r in after[2]}
    assert all(r["text"] == left[r["doc_id"]] for r in after[3])
    assert sum(r["n_tokens"] for r in after[4]) == sum(len(r["text"].split()) for r in after[3])


def test_near_duplicates_from_four_fifths_on_go(spark, documents):
    words = [f"w{k}" for k in range(105)]
    two, three = list(words), list(words)
    for k in (30, 70):  # 91 of 111 shingles shared
        two[k] = f"new{k}"
    for k in (20, 50, 80):  # 86 of 116 shared, 0.74
        three[k] = f"other{k}"
    docs = documents([(1, " ".join(words)), (2, " ".join(two)), (3, " ".join(three))])
    _, stage = corpus_pipeline.STAGES[1]
    assert sorted(r["doc_id"] for r in stage(spark, docs, None).collect()) == [1, 3]
    assert all(r["kept"] for r in near_dedup.near_duplicates(docs).collect())


def test_run_repeats(spark):
    one = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    two = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() > 50


def test_empty_documents(spark, documents):
    docs = documents([(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
    assert docs.count() == 0


def test_the_rest_does_not_need_the_corpus_operators(tmp_path):
    """Without this subpackage the entry still imports and offers the relational queries."""
    import os
    import shutil

    here = os.path.dirname(corpus_pipeline.__file__)
    shutil.copytree(f"{here}/loomwright", tmp_path / "loomwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries() and e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_tests_of_the_rest_pass_without_the_corpus_operators(tmp_path):
    """All of them are collected, and those that need no test tables run."""
    import os
    import shutil

    here = os.path.dirname(corpus_pipeline.__file__)
    for name in ("loomwright", "tests"):
        shutil.copytree(f"{here}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(f"{here}/{name}", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda *more: subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", *more], cwd=tmp_path, env=env, check=True, timeout=600)
    run("--collect-only", "tests")
    run("tests/test_patterns.py")


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        master = "spark://host:7077"

    class Unset:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf, sparkContext = Unset, Cluster

    with pytest.raises(ValueError):
        Workspace(Session, "test")


def test_stages_take_hard_rows(spark, hard, clashing):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass through each stage alone."""
    docs = clashing(hard)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, None)
        assert k == 4 or out.columns == docs.columns
        assert 0 < out.count() <= 30


def test_registered_with_all_ten(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
