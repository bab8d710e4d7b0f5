import random
import re
from collections import Counter

from loomwright.llm import quality
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, documents):
    words = "a b c d e f g h i j"
    texts = [words * 3, f"{words} {words}", f"{words}\n{words}\nx\n\nx", "#a *b\u00a0c\u2003d |", "a " * 40, "é" * 9, "x\x0by\x0cz\rw", "\n\n", "a b c d e f g h " * 2 + "z", None, ""]
    got = quality.judge(documents(list(enumerate(texts)))).collect()
    for r in got:
        assert tuple(r[c] for c in quality.COUNTS) == brute(texts[r["_row"]["doc_id"]]), texts[r["_row"]["doc_id"]]


def test_query_matches_sql(spark, duck, same):
    from loomwright.llm.queries import ORACLE_SQL, QUERIES

    for name in ("op2_quality_rules", "op3_url_filter", "op5_minhash_near_dedup", "op8_packing", "op9_nearest_neighbours", "op10_source_mixing"):
        same(QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.execute(ORACLE_SQL[name]).df())


def test_order_of_rules_does_not_change_verdicts(documents):
    docs = documents([(0, "plain words of a text that is long enough to be kept by every rule there is and more of them " * 1), (1, "#$%& " * 40), (2, "SHOUTING WORDS " * 30), (3, "word " * 50), (4, None)])
    rules = [name for name, _ in quality.lazy_rules()]
    one = {r["_row"]["doc_id"]: r["kept"] for r in quality.judge(docs, order=rules).collect()}
    assert one == {r["_row"]["doc_id"]: r["kept"] for r in quality.judge(docs, order=rules[::-1]).collect()}
    assert one == {0: False, 1: False, 2: False, 3: False, 4: False} or one[0]


def test_cheap_rejecting_rules_go_first(documents):
    docs = quality.with_words(documents([(k, "#$%& " * 40) for k in range(50)]))
    order = quality.ordered(docs, [("never", F.lit(False)), ("symbols", F.col("_text").contains("#"))])
    assert [n for n, _ in order] == ["symbols", "never"]
    assert quality.ordered(docs.limit(0)) and len(order) == 2


def test_selectivity_is_of_the_rows_left():
    # Rule 1 rejects most of what rule 0 rejects too: after rule 0 it is worth less than rule 2.
    kinds = {0b011: 50, 0b001: 10, 0b100: 5, 0b010: 1, 0: 34}
    assert quality.by_worth(kinds, [1.0, 1.0, 1.0]) == [0, 2, 1]
    assert quality.by_worth(kinds, [100.0, 1.0, 1.0]) == [1, 2, 0]
    assert quality.by_worth({}, [1.0, 2.0]) == [0, 1]


def test_costs_are_those_of_the_rules(documents):
    rng = random.Random(1)
    docs = quality.with_words(documents([(k, " ".join(str(rng.random()) for _ in range(300))) for k in range(200)])).select("_text", "_words").persist()
    known = dict(quality.lazy_rules())
    cost = dict(zip(known, quality.costs(docs, list(known.items()))))
    assert cost["short"] < cost["repeats"] / 2 and min(cost.values()) > 0


def test_rows_without_repeated_pairs_need_no_windows(spark, documents):
    """The cheap half of the repeats rule never says no where the rule says yes."""
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        part = [rng.choice("abcdefghij") + str(rng.randrange(rng.choice([2, 9, 400]))) for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(part * rng.choice([1, 1, 2, 3]) + part[: rng.randint(0, 20)]))
    df = quality.with_words(documents(list(enumerate(texts))))
    n = quality.repeated_words(F.col("_words"))
    got = df.select(quality.may_repeat(F.col("_words")).alias("may"), (100 * n > quality.MOST_REPEATED_PERCENT * F.size("_words")).alias("fails")).collect()
    assert not any(r["fails"] and not r["may"] for r in got) and any(r["fails"] for r in got) and any(not r["may"] for r in got)


def test_later_rules_are_not_worked_out_for_rejected_rows(documents):
    """A rule that fails on any row it meets never meets rows that an earlier one rejects."""
    boom = F.when(F.raise_error(F.lit("met")).isNull(), True).otherwise(False)
    docs = quality.with_words(documents([(k, "#$%& " * 40) for k in range(50)]))
    assert docs.filter(quality.cascade([("symbols", F.col("_text").contains("#")), ("boom", boom)]).isNull()).count() == 0


def test_both_ways_keep_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(docs).filter("kept").select("_row.doc_id")
    assert sorted(quality.keep_good(docs).select("doc_id").collect()) == sorted(judged.collect())


def test_no_python_on_the_main_path(documents):
    for df in (quality.judge(documents([(1, "a b")])), quality.keep_good(documents([(1, "a b")]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_clean_text_is_kept_and_junk_is_not(spark):
    folder = "/root/testdata/sf0.01"
    from loomwright.llm.queries import op2_quality_rules

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = op2_quality_rules(spark, folder).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] > 0.99 and share[0] < 0.1


def test_hard_rows(hard, clashing):
    kept = quality.keep_good(clashing(hard))
    assert kept.columns == clashing(hard).columns and {r["doc_id"] for r in kept.collect()} == {4}
    assert quality.judge(hard).count() == 9 and quality.judge(hard.limit(0)).count() == 0
    odd = hard.withColumn("a `b", F.lit(1)).withColumnRenamed("text", "t`x")
    assert quality.keep_good(odd, "t`x").columns == odd.columns and quality.keep_good(odd, "t`x").count() == 1
