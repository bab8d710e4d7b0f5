"""Phrase mining against brute force and SQL."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwright.llm import oracle, phrases, queries
from loomwright.llm.common import Workspace

FOLDER = "/root/testdata/sf0.01"
TEXTS = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tally(rows, longest):
    f = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang if lang is not None else "und", tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    return f


def brute(rows, least, longest, top):
    f = tally(rows, longest)
    n = Counter()
    for (lang, w), a in f.items():
        n[lang] += a * (len(w) == 1)
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + m]) for (lang, w), a in good.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if a >= f[lang, w[i : i + m]]}
    out = []
    for lang in n:
        own = []
        for (g, w), a in good.items():
            if g == lang and (g, w) not in gone:
                score, _, l, r = min((1000 * a * n[lang] // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
                own.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    words = ["a", "B", "the", "É", "of", "x\x00y", "Zürich", "i j", "cat", "dog", "emu", "fox"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?", "\v"]
    text = lambda n: "".join(draw.choices(words, range(12, 0, -1))[0] + draw.choice(ends) for _ in range(n))
    out = [(k, text(draw.randrange(40)), draw.choice(["en", "en", "de", None, "und"])) for k in range(150)]
    return out + [(200, None, "en"), (201, "", "en"), (202, " .\n", "fr"), (203, text(6000), "en"), (7, "the the the the the the", "en"), (7, "the the the the the the", "en"), (None, "cat dog " * 30, "")]


def test_query_matches_sql(spark, same):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    same(queries.QUERIES["op13_phrase_mining"](spark, FOLDER).toPandas(), con.execute(oracle.PHRASES).df())


@pytest.mark.parametrize("more", [{}, {"bits": 2}, {"hot": 20}, {"hot": 3, "bits": 1}, {"longest": 3, "top": 5}])
def test_equals_brute_force(spark, rows, more, monkeypatch):
    """With a table so small that words share their sums, and with salted pivots; chunks of a few lines."""
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 900)
    monkeypatch.setattr(phrases, "MINE_BYTES", 2000)
    monkeypatch.setattr(phrases, "ROW_BYTES", 100)
    monkeypatch.setattr(phrases, "HELD_BYTES", 3000)
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    assert got(phrases.mine(df, least=4, **more)) == brute(rows, 4, more.get("longest", 5), more.get("top", 2000))


def test_all_frequent_phrases_are_counted(spark, rows):
    df = spark.createDataFrame(rows, TEXTS)
    _, found = phrases.counts(df, Workspace(spark, "test"), least=3)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in found.collect()} == {k: a for k, a in tally(rows, 5).items() if len(k[1]) > 1 and a >= 3}


def test_a_fragment_holds_no_rarer_word_and_counts_once():
    import numpy as np

    table = np.zeros(1 << 16, np.uint32)
    for word, n in ((b"a", 9), (b"b", 5), (b"c", 3)):
        table[phrases.word_hash(b"en", word) & 0xFFFF] = n
    _, _, blobs = phrases.fragments(b"en", [b"a b a c rare b. A c", b"a b a c rare b"], table, 2, 5, 100, 4)
    lines = sorted(line for blob in blobs.to_pylist() for line in blob.split(b"\n"))
    assert lines == [b"1 a \x0bc", b"2 a \x0bb a", b"2 a b a \x0bc"]


def test_scores_beyond_64_bits_are_exact(spark):
    draw = random.Random(2)
    rows = [(a := draw.randrange(1, 10**15), draw.randrange(a, 10**16), draw.randrange(a, 10**16), draw.randrange(10**16, 10**17)) for _ in range(200)]
    out = spark.createDataFrame(rows, "a long, l long, r long, n long").select("*", F.expr(phrases.SCORE).alias("score")).collect()
    assert [x["score"] for x in out] == [1000 * a * n // (l * r) for a, l, r, n in rows]


def test_no_words_no_rows(spark, clashing):
    assert phrases.mine(spark.createDataFrame([], TEXTS)).count() == 0
    assert phrases.mine(clashing(spark.createDataFrame([(1, None, "en"), (2, " . ", None)], TEXTS)), least=1).count() == 0
    df = clashing(spark.createDataFrame([(1, "b c d", "en")] * 2, TEXTS)).withColumnsRenamed({"text": "t.x", "lang": "l`g"})
    assert got(phrases.mine(df, "t.x", "l`g", least=2)) == brute([(1, "b c d", "en")] * 2, 2, 5, 2000)
