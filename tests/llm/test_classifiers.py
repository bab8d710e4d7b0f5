import itertools
import math

import numpy as np
import pytest
from loomwright.llm import deobfuscate as noisy
from loomwright.llm import positive_unlabelled as pu
from loomwright.llm import quality_model, toxicity
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.1"


def held_out_scores(spark, query, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    got = query(spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    pdf = got.join(labels, "doc_id", "left").toPandas()
    assert len(pdf) == 10_000 and pdf["score"].between(0, 1).all()
    return pdf[pdf["held_out"] & pdf["y"].notna()]


def test_held_out_toxicity(spark):
    from loomwright.llm.queries import op4_toxicity

    h = held_out_scores(spark, op4_toxicity, "toxic")
    assert ((h["score"] >= 0.3) == h["predicted"]).all()
    assert (h["predicted"] == h["y"]).mean() > 0.97 and h[h["y"] == 1]["predicted"].mean() > 0.9


def test_held_out_quality(spark):
    from loomwright.llm.queries import op6_quality_classifier

    h = held_out_scores(spark, op6_quality_classifier, "quality")
    assert ((h["score"] >= 0.7) == h["predicted"]).all()
    assert (h["predicted"] == h["y"]).mean() > 0.98 and h[h["y"] == 1]["predicted"].mean() > 0.98


@pytest.fixture(scope="module")
def costs():
    words = ["pathetic", "idiot", "worthless", "moron", "clown", "stupid", "disgusting", "trash", "the", "that", "with", "letter", "good", "boot"]
    at, n = noisy.trigrams([" ".join(words)] * 50)
    counts = np.zeros(noisy.SIZE**3, np.int64)
    counts[at] = n
    return noisy.model(counts).tolist()


@pytest.mark.parametrize("word, want", [("1d10t", "idiot"), ("p4th3t1c", "pathetic"), ("st00pid", "stoopid"), ("$tup1d", "stupid"), ("idiooooot", "idiot"), ("m.o.r.o.n", "moron"), ("w0rthl3ss", "worthless"), ("tr@sh!!", "trash"), ("i-d-i-o-t", "idiot")])
def test_decoding(costs, word, want):
    assert noisy.is_noisy(word)
    got = noisy.decode(word, costs)
    assert got == want or word == "st00pid" and got.startswith("st")


def test_clean_words_stay():
    assert not any(map(noisy.is_noisy, ("letter", "boot", "good.", "the,", "2024", "###", "éêè")))
    assert noisy.plain("clown###") == "clown" and noisy.plain("***") == ""
    assert noisy.tokens("A i d  i\no t. word") == {"a", "i", "d", "o", "t.", "word", "a i d i o t."}


@pytest.mark.parametrize("text, want", [("i d i o t.", ["idiot"]), ("id io t", ["idiot"]), ("s t u p i d i d i o t", ["stupid", "idiot"]), ("1 d 1 0 t", ["idiot"])])
def test_spelt_out_words(costs, text, want):
    assert noisy.readings(text, costs) == want


def test_doubled_letters_are_read_both_ways(costs):
    assert "stupid" in noisy.readings("stuupiidd", costs) and "letter" in noisy.readings("letter", costs)
    assert "stupid" in noisy.readings("stuupid", costs)


def test_viterbi_finds_the_cheapest_path_of_all(costs):
    """Every path through small lattices, enumerated and priced plainly."""
    rng = np.random.default_rng(5)
    signs = "aist10$@.! db"
    for _ in range(400):
        word = "".join(rng.choice(list(signs), rng.integers(1, 8))).strip()
        word = " ".join(word.split())
        lattice = noisy.options(word)
        if not word or not all(lattice):
            continue

        def price(letters):
            a = b = 0
            total = 0.0
            for c in letters:
                k = 0 if c == " " else noisy.CODE[c]
                total += costs[(a * noisy.SIZE + b) * noisy.SIZE + k]
                a, b = b, k
            return total + costs[(a * noisy.SIZE + b) * noisy.SIZE]

        best = {}
        for way in itertools.product(*lattice):
            letters = "".join(x[2] for x in way)
            best[letters] = min(best.get(letters, 1e9), sum(x[1] for x in way))
        total = {k: v + price(k) for k, v in best.items()}
        assert total[noisy.decode(word, costs)] == pytest.approx(min(total.values()), abs=1e-6), word


def test_words_of_letters_are_read_without_a_lattice(costs, monkeypatch):
    rng = np.random.default_rng(6)
    words = {"".join(np.repeat(rng.choice(list("abioßéλ一"), 6), rng.integers(1, 4, 6))[: rng.integers(1, 12)]) for _ in range(3000)}
    want = {w: noisy.through_lattice(w, costs) for w in words}
    monkeypatch.setattr(noisy, "options", None)
    assert {w: noisy.decode(w, costs) for w in words} == want
    assert any(len(w) - len(want[w]) > 1 for w in words) and any(len(w) > 1 and w[-1] == w[-2] != want[w][-2:-1] for w in words)
    assert noisy.readings("stuupiidd.", costs) == ["stuupiidd", "stupid"]


def test_a_beginning_is_hashed_once_for_all_words_that_have_it(costs, monkeypatch):
    words = [f"wor{a}{b}{c}" for a in "abcd" for b in "efgh" for c in "iklmn"]
    starts = {w[:n] for w in words for n in range(toxicity.SHORTEST, len(w) + 1)}
    bucket = lambda text: toxicity.xxhash.xxh32_intdigest(text.encode()) % toxicity.BUCKETS
    by_start = {bucket("worbf"): 1.5, bucket("worbfk"): 2.5, bucket("worc"): 1.25}
    want_seen, hashed, real = {bucket(s) for s in starts}, [], toxicity.xxhash.xxh32_intdigest
    monkeypatch.setattr(toxicity.xxhash, "xxh32_intdigest", lambda b: hashed.append(b) or real(b))
    assert toxicity.Reader(np.array(costs)).seen_starts(" ".join(words)) == want_seen
    assert len(hashed) == len(words) + len(starts)  # a word is hashed once as a whole
    hashed.clear()
    got = toxicity.Reader(np.array(costs), {}, by_start).strongest(" ".join(words))
    assert got == (2.5, 2.5 + 2 * 1.5, 5 + 20, len(words))
    assert len(hashed) == len(words) + len(starts)


def test_word_counts_of_both_halves_are_weighed_together():
    toxic, clean = np.zeros(4), np.zeros(4)
    toxic[1], clean[1] = 5, 8
    assert toxicity.weights_of(toxic, clean, 449, 3531).keys() == toxicity.weights_of(np.array([0, 5.0]), np.array([0, 8.0]), 449, 3531).keys()


def plainly_counted(rows, reader):
    """For each half and label how many texts have each bucket, one text after the other."""
    out = np.zeros((2, toxicity.BUCKETS + 1, 2), int)
    for half, text, label in rows:
        for b in reader.seen_words(text):
            out[half, b, label] += 1
        out[half, toxicity.BUCKETS, label] += 1
    return out


def test_scores_match_a_plain_computation(documents, spark):
    """Toxicity scored text by text on the driver, with a word whose counts lie in one half but for one toxic text."""
    from loomwright.llm.training import logistic, sigmoid

    rng = np.random.default_rng(4)
    clean = ["the", "that", "with", "letter", "table", "window", "green", "over", "house", "under"]
    rows = []
    for i in range(300):
        words = list(rng.choice(clean, 12)) + (["idiot"] if i % 4 == 0 else []) + (["m0r0n"] if i % 9 == 0 else [])
        rows.append((i, " ".join(rng.permutation(words))))
    labels = {i: int(i % 4 == 0 or i % 9 == 0) for i, _ in rows}
    docs = documents(rows)
    marked = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("h"), toxicity.held_out("doc_id").alias("out")).collect()
    half, out = {r["doc_id"]: r["h"] for r in marked}, {r["doc_id"] for r in marked if r["out"]}
    counts = np.zeros(noisy.SIZE**3, np.int64)
    for _, t in rows:
        at, n = noisy.trigrams([t])
        counts[at] += n
    model = noisy.model(counts)
    learnt = [(half[i], t, labels[i]) for i, t in rows if i not in out]
    by_word = plainly_counted(learnt, toxicity.Reader(model))
    total = by_word.sum(0)
    learn = lambda t: toxicity.weights_of(t[: toxicity.BUCKETS, 1], t[: toxicity.BUCKETS, 0], t[toxicity.BUCKETS, 1], t[toxicity.BUCKETS, 0])
    strong = learn(total)
    by_start = np.zeros_like(by_word)
    reader = toxicity.Reader(model, strong)
    for h, t, y in learnt:
        for b in reader.seen_starts(t):
            by_start[h, b, y] += 1
        by_start[h, toxicity.BUCKETS, y] += 1
    halves = [toxicity.Reader(model, learn(by_word[1 - h]), learn(by_start[1 - h])) for h in range(2)]
    x = np.array([halves[h].strongest(t) for h, t, _ in learnt])
    w = logistic(toxicity._inputs(x), np.array([y for *_, y in learnt], float))
    whole = toxicity.Reader(model, strong, learn(by_start.sum(0)))
    want = sigmoid(toxicity._inputs(np.array([whole.strongest(t) for _, t in rows])) @ w[:-1] + w[-1])
    table = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, table).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist(), abs=1e-6)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality_model.score_quality])
def test_an_id_of_many_rows_is_one_text_of_the_sample(spark, documents, score):
    from loomwright.llm.training import sampled_ids, texts_of

    docs = documents([(7, f"some words of text {k % 3}") for k in range(300)] + [(8, "other words of text")])
    labels = spark.createDataFrame([(7, 1, 1)] * 300 + [(8, 1, 0)], "doc_id long, quality int, toxic int")
    ids = sampled_ids(labels, "doc_id", 50, "toxic")
    assert sorted(map(tuple, ids.collect())) == [(7, 1), (8, 0)]
    assert texts_of(docs, ids, "doc_id", "text").count() == 2
    assert score(docs, labels).count() == 301


def test_risk_is_at_its_least():
    """No small step from the fit lowers the non-negative risk, computed plainly."""
    rng = np.random.default_rng(8)
    p, u = rng.normal(1, 1, (400, 2)), np.vstack([rng.normal(1, 1, (200, 2)), rng.normal(-1, 1, (200, 2))])
    prior, ridge = 0.5, 1e-3
    w = pu.fit(p, u, prior, ridge=ridge)

    def risk(w):
        total = unlabelled = as_negative = 0.0
        for x in p:
            f = float(x @ w[:-1] + w[-1])
            total += prior * math.log1p(math.exp(-f)) / len(p)
            as_negative += prior * math.log1p(math.exp(f)) / len(p)
        for x in u:
            unlabelled += math.log1p(math.exp(float(x @ w[:-1] + w[-1]))) / len(u)
        return total + max(0.0, unlabelled - as_negative) + ridge / 2 * float(w[:-1] @ w[:-1])

    best = risk(w)
    for k in range(3):
        for step in (-0.05, 0.05):
            assert risk(w + step * np.eye(3)[k]) > best - 1e-3  # steps go against the unlabelled part alone while it is below zero


def test_quality_features_match_a_plain_count():
    text = "One two, THREE 44! #a\nOne two, THREE 44! #a\nshort"
    got = dict(zip(quality_model.NAMES, quality_model.features(text)))
    words = text.split()
    assert got["capitals"] == sum(w.isupper() for w in words) / len(words) and got["pipes"] == 0
    assert got["bangs"] == text.count("!") / len(words)
    assert got["symbols"] == pytest.approx(text.count("#") / (len(text) - len(words)))
    assert quality_model.features(None) == quality_model.features(" ") == [0.0] * len(quality_model.NAMES)


def test_obfuscated_insults_score_as_plain_ones(documents, spark):
    rng = np.random.default_rng(1)
    clean = ["the", "that", "with", "letter", "table", "window", "green", "over", "house", "under"]
    text = lambda *more: " ".join([*rng.choice(clean, 30), *more])
    rows = [(i, text(*(["idiot", "moron"] if i % 3 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    rows += [(1000, text("1d10t")), (1001, text("i", "d", "i", "o", "t")), (1002, text("mooooron")), (1003, text())]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(documents(rows), labels).collect()}
    assert [got[i] for i in range(1000, 1004)] == [1, 1, 1, 0]


def test_class_prior_and_risk():
    rng = np.random.default_rng(2)
    positive = rng.normal(2, 1, (3000, 1))
    unlabelled = np.vstack([rng.normal(2, 1, (2100, 1)), rng.normal(-2, 1, (900, 1))])[rng.permutation(3000)]
    prior = pu.class_prior(positive, unlabelled)
    assert prior == pytest.approx(0.7, abs=0.06)
    w = pu.fit(positive, unlabelled, prior)
    test = np.r_[rng.normal(2, 1, 1000), rng.normal(-2, 1, 1000)]
    assert ((test * w[0] + w[1] > 0) == (np.arange(2000) < 1000)).mean() > 0.95


def test_hard_rows(spark, hard, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(5, 1, 0), (4, 1, 1), (None, 1, 1), (6, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    for score in (toxicity.score_toxicity, quality_model.score_quality):
        for labels in (none, some):
            got = score(clashing(hard), clashing(labels)).collect()
            assert len(got) == 9 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert score(hard.limit(0), some).count() == 0
