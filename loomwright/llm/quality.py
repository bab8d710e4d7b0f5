"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a Boolean expression over a document's text and words. On a sample its cost is
measured, the time of its own work alone, and its selectivity as the share of rows it rejects
among those that the rules before it leave. Rules run in order of rejections per cost, as the
branches of one CASE, so that a document meets no rule after the first that rejects it, and
what only a later rule needs, repeated windows above all, is not worked out for it. The order
changes how fast a verdict comes, never the verdict.

``judge`` gives all counts of every row, as asked, and so works them out before the cascade;
``keep_good`` needs verdicts only and works out no more than they take.

Defined results: null text has no words, so that it fails the base; so does an empty text.
Counts depend on a row's own text alone: repeated rows give repeated results. Columns that
share a name with a count are not read and, in ``keep_good``, come back as they were.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, words

WINDOW = 8  # words in a window that may repeat
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SAMPLE_FILES = 8  # files read to order the rules
SAMPLE_ROWS = 400  # rows, about, that the rules are measured on
REPEATS = 4  # copies of each row of the sample that a rule is timed on
LEAST_COST = 0.02  # of a pass that does nothing: less can't be told from it

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

Rule = tuple[str, Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def together(hashes: Column, width: int) -> Column:
    """The hashes of all stretches of so many words, from the words' hashes."""
    all_ = F.transform(hashes, lambda _, i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))
    return F.slice(all_, F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(0)))


def hashed(its_words: Column) -> Column:
    return F.transform(its_words, lambda w: F.xxhash64(w))


def repeated_words(its_words: Column) -> Column:
    """Words in windows of WINDOW that the array holds twice or more.

    Words are hashed once, and windows' hashes put together from theirs. Windows are compared
    as 64-bit hashes within one text: n of them share one by chance with probability
    n * n / 2**65. Only texts with a repeat pay for what comes after.
    """
    windows = let(hashed(its_words), lambda h: together(h, WINDOW))

    def covered(found: Column) -> Column:
        in_order = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Neighbours with one hash are paired by zipping the sorted array with itself shifted.
        same = let(in_order, lambda x: F.filter(F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"]["h"] == p["b"]["h"]))
        at = let(same, lambda x: F.sort_array(F.array_distinct(F.concat(F.transform(x, lambda p: p["a"]["i"]), F.transform(x, lambda p: p["b"]["i"])))))
        return F.aggregate(
            at,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    some = let(windows, lambda x: F.when(F.size(x) > F.size(F.array_distinct(x)), covered(x)).otherwise(0))
    return F.when(F.size(its_words) >= WINDOW, some).otherwise(0).cast("long")


def measures(text: Column, its_words: Column) -> dict[str, Column]:
    """COUNTS as expressions over a text and its words."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(its_words).cast("long"),
        "word_chars": F.length(F.array_join(its_words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(its_words),
    }


def base_rules(m: dict[str, Column]) -> list[Rule]:
    """The contract's base as rules: the cheap half and the costly one."""
    return [("short", m["n_words"] < LEAST_WORDS), ("repeats", 100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])]


def may_repeat(its_words: Column) -> Column:
    """False only where the costly half of the base holds for certain, by pairs of words alone.

    A repeated window has a twin elsewhere, so that among the words in such windows each pair
    within a window occurs twice: c words hold c * (WINDOW - 1) / WINDOW such pairs or more, of
    which at most half are the first of their kind.
    """
    pairs = let(hashed(its_words), lambda h: let(together(h, 2), lambda x: F.size(x) - F.size(F.array_distinct(x))))
    return 100 * 2 * WINDOW * pairs >= (WINDOW - 1) * MOST_REPEATED_PERCENT * F.size(its_words)


def rules(m: dict[str, Column] | None = None) -> list[Rule]:
    """Beyond the base: each is true of documents to reject. Over the text ``_text``, its ``_words`` and measures."""
    m = m or {c: F.col(c) for c in COUNTS}
    n = F.greatest(m["n_words"], F.lit(1).cast("long"))
    letters = F.length(F.regexp_replace("_text", r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", ""))
    # Where half of all characters are a to z, letters are neither few nor mostly capitals; where the first 200 words are of enough kinds, all are.
    small = F.length("_text") - F.length(F.regexp_replace("_text", "[a-z]+", ""))
    few_kinds = lambda words: F.size(F.array_distinct(words)) * 100 < F.least(n, F.lit(200)) * 10
    return [
        ("symbols", m["n_symbols"] * 100 > n * 30),
        ("word_length", (m["word_chars"] < n * 2) | (m["word_chars"] > n * 20)),
        ("duplicate_lines", m["n_dup_lines"] * 100 > F.size(F.split("_text", "\n", -1)) * 50),
        ("letters", F.when(small * 100 >= m["word_chars"] * 50, False).otherwise((letters * 100 < m["word_chars"] * 50) | (capitals * 100 > letters * 60))),
        ("few_kinds", few_kinds(F.slice("_words", 1, 200)) & few_kinds(F.col("_words"))),
    ]


def lazy_rules() -> list[Rule]:
    """All rules, the base's too, each working out what it needs."""
    m = measures(F.col("_text"), F.col("_words"))
    short, (name, repeats) = base_rules(m)
    return [short, (name, F.when(may_repeat(F.col("_words")), repeats).otherwise(False)), *rules(m)]


def base_failed() -> Column:
    short, repeats = (rule for _, rule in base_rules({c: F.col(c) for c in COUNTS}))
    return short | repeats


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' rows as one struct ``_row`` beside the text ``_text``, never null, and its ``_words``."""
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row")
    df = docs.select(row, F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("_text"))
    # Through a generator nothing is pushed: pushed filters would split the text anew for each use of its words.
    return df.select("_row", "_text", F.inline_outer(F.array(F.struct(words("_text").alias("_words")))))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' rows as one struct ``_row`` beside the text, its words and the counts."""
    counts = F.struct(*(c.alias(name) for name, c in measures(F.col("_text"), F.col("_words")).items()))
    return with_words(docs, text_col).select("_row", "_text", "_words", F.inline_outer(F.array(counts)))


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES) -> DataFrame:
    """About so many rows, from a few of docs' files evenly apart where docs are what these files hold.

    Only the order of rules rests on it. Reading a few files keeps the sample's cost the
    same for any size of input.
    """
    names = sorted(docs.inputFiles())
    if len(names) > files and all(n.endswith(".parquet") for n in names):
        some = docs.sparkSession.read.parquet(*names[:: -(-len(names) // files)])
        if {(f.name, f.dataType) for f in docs.schema} <= {(f.name, f.dataType) for f in some.schema}:
            docs = some.select(*(quoted(c) for c in docs.columns))
    # Parquet counts rows from its footers. A share of the rows, unlike a limit, is drawn where they are.
    n = docs.count()
    return docs.sample(rows / n, seed=11) if n > rows else docs


def costs(sample: DataFrame, candidates: list[Rule]) -> list[float]:
    """Seconds that each rule takes on copies of the sample's rows in memory, less those of a pass that does nothing.

    Each is the better of two passes, as the first compiles.
    """
    rows = sample.select("_text", "_words", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(rule: Column) -> float:
        job, best = rows.agg(F.sum(F.coalesce(rule, F.lit(False)).cast("long"))), float("inf")
        for _ in range(2):
            began = time.perf_counter()
            job.collect()
            best = min(best, time.perf_counter() - began)
        return best

    # What reads both columns, and hardly more.
    empty = seconds((F.octet_length("_text") < 0) | (F.size("_words") < 0))
    return [max(seconds(rule) - empty, LEAST_COST * empty) for _, rule in candidates]


def by_worth(kinds: dict[int, int], cost: list[float]) -> list[int]:
    """Rules in order of rejections per cost among the rows left, most first; ties in the order given.

    kinds: how many rows each set of rules, as bits, rejects.
    """
    left, out = dict(kinds), []
    while len(out) < len(cost):
        rejected = {k: sum(n for bits, n in left.items() if bits >> k & 1) for k in range(len(cost)) if k not in out}
        best = min(rejected, key=lambda k: (-rejected[k] / cost[k], k))
        out.append(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return out


def ordered(sample: DataFrame, candidates: list[Rule] | None = None) -> list[Rule]:
    """The rules in the order that the sample, rows of with_words, shows to be best."""
    candidates = candidates or lazy_rules()
    sample = sample.select("_text", "_words").persist()
    try:
        bits = sum((F.when(rule, F.lit(1 << k)).otherwise(0) for k, (_, rule) in enumerate(candidates)), F.lit(0))
        kinds = {r["bits"]: r["n"] for r in sample.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()}
        if not kinds:
            return candidates
        return [candidates[k] for k in by_worth(kinds, costs(sample, candidates))]
    finally:
        sample.unpersist()


def cascade(order: list[Rule]) -> Column:
    """The name of the first rule that rejects; null where none does."""
    out = F
    for name, rule in order:
        out = out.when(rule, F.lit(name))
    return out


def judge(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: ``_row`` (its columns), the counts, base_failed and kept. order: names of rules."""
    if order is None:
        order = [name for name, _ in ordered(with_words(sample_of(docs.select(quoted(text_col))), text_col))]
    m = {c: F.col(c) for c in COUNTS}
    known = dict(base_rules(m) + rules(m))
    verdict = cascade([(name, known[name]) for name in order])
    return with_counts(docs, text_col).select("_row", *COUNTS, base_failed().alias("base_failed"), verdict.isNull().alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that the rules reject; columns as they were."""
    order = ordered(with_words(sample_of(docs.select(quoted(text_col))), text_col))
    return with_words(docs, text_col).filter(cascade(order).isNull()).select("_row.*")
