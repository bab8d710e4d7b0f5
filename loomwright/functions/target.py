"""Patterns that encode a value by how the target is spread over the rows that share it.

All rest on one aggregation by value, joined back on the value. Totals are one row, joined
on a constant. Rows whose target is null count for neither class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import Binding, frame, quoted


def _flags(b: Binding) -> tuple[Column, Column]:
    """1 where the target is, or is another than, the value; 0 where it's null."""
    is_, not_ = F.expr(b.sql("{target_is}")), F.expr(b.sql("{target_is_not}"))
    return F.when(is_, 1).otherwise(0), F.when(not_, 1).otherwise(0)


def _labelled(df: DataFrame, b: Binding, value: Column, *more: str) -> DataFrame:
    pos, neg = _flags(b)
    return df.select(*dict.fromkeys([*b.base, *more]), value.alias("_v"), pos.alias("_pos"), neg.alias("_neg"))


def _by_value(rows: DataFrame) -> DataFrame:
    return rows.filter("_v IS NOT NULL").groupBy("_v").agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"), F.count("*").alias("_rows"))


def _with_totals(df: DataFrame, rows: DataFrame, *more: Column) -> DataFrame:
    totals = rows.agg(F.sum("_pos").alias("_all_p"), F.sum("_neg").alias("_all_q"), *more).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one").drop("_one")  # one row


def _slot(b: Binding, slot: str = "nominal") -> Column:
    return F.col(quoted(b.columns[slot]))


def _woe(df: DataFrame, b: Binding) -> DataFrame:
    """100 ln of the ratio of class shares in the value, the row itself left out; counts start from one, totals from two."""
    rows = _labelled(df, b, _slot(b))
    counts = _with_totals(_by_value(rows), rows)
    ratio = ((F.col("_p") + 1 - F.col("_pos")) / (F.col("_all_p") + 2)) / ((F.col("_q") + 1 - F.col("_neg")) / (F.col("_all_q") + 2))
    return rows.join(counts, "_v").select(*b.base, (100 * F.log(ratio)).alias("value"))


def _woe_mod(df: DataFrame, b: Binding) -> DataFrame:
    """As WOE, but totals start from the number of values."""
    rows = _labelled(df, b, _slot(b))
    counts = _with_totals(_by_value(rows), rows, F.countDistinct("_v").alias("_levels"))
    ratio = ((F.col("_p") + 1 - F.col("_pos")) / (F.col("_all_p") + F.col("_levels"))) / ((F.col("_q") + 1 - F.col("_neg")) / (F.col("_all_q") + F.col("_levels")))
    return rows.join(counts, "_v").select(*b.base, (100 * F.log(ratio)).alias("value"))


def _plain_woe(counts: DataFrame) -> DataFrame:
    ratio = ((F.col("_p") + 1) / (F.col("_all_p") + 2)) / ((F.col("_q") + 1) / (F.col("_all_q") + 2))
    return counts.select("_v", (100 * F.log(ratio)).alias("_woe"))


def _woe_no_loo(df: DataFrame, b: Binding) -> DataFrame:
    rows = _labelled(df, b, _slot(b))
    # Values whose rows have no target at all have no weight.
    counts = _with_totals(_by_value(rows.filter(F.col("_pos") + F.col("_neg") > 0)), rows)
    return rows.join(_plain_woe(counts), "_v").select(*b.base, F.col("_woe").alias("value"))


def _woe_limit(df: DataFrame, b: Binding) -> DataFrame:
    """Mean weight over the rows whose value has ten rows or more; half counts, the ratio divided by both totals."""
    rows = _labelled(df, b, _slot(b))
    counts = _with_totals(_by_value(rows), rows).filter("_rows >= 10")
    ratio = (F.col("_p") + 0.5) / (F.col("_all_p") + 0.5) / (F.col("_q") + 0.5) / (F.col("_all_q") + 0.5)
    return rows.join(counts.select("_v", (100 * F.log(ratio)).alias("_woe")), "_v").groupBy(*b.base).agg(F.avg("_woe").alias("value"))


def _aggregate_woe(df: DataFrame, b: Binding) -> DataFrame:
    """Mean weight of a base row's values, all rows of its id left out of the counts."""
    rows = _labelled(df, b, _slot(b))
    counts = _with_totals(_by_value(rows), rows)
    own = rows.filter("_v IS NOT NULL").groupBy(*b.ids, "_v").agg(F.sum("_pos").alias("_own_p"), F.sum("_neg").alias("_own_q"))
    ratio = ((F.col("_p") + 1 - F.col("_own_p")) / (F.col("_all_p") + 2)) / ((F.col("_q") + 1 - F.col("_own_q")) / (F.col("_all_q") + 2))
    return rows.join(own, [*b.ids, "_v"]).join(counts, "_v").groupBy(*b.base).agg(F.avg(100 * F.log(ratio)).alias("value"))


def _affinity(df: DataFrame, b: Binding) -> DataFrame:
    """Smoothed share of the target value among the rows that share the value; a half for null."""
    rows = _labelled(df, b, _slot(b))
    p, q = F.coalesce("_p", F.lit(0)), F.coalesce("_q", F.lit(0))
    return rows.join(_by_value(rows), "_v", "left").select(*b.base, ((p + 1) / (p + q + 2)).alias("value"))


def _class_rates(rows: DataFrame) -> DataFrame:
    return rows.filter("_v IS NOT NULL").groupBy("_v").agg((F.avg("_pos") + 1).alias("_a"), (F.avg("_neg") + 1).alias("_b"))


def _affinity2(df: DataFrame, b: Binding) -> DataFrame:
    rows = _labelled(df, b, _slot(b))
    return rows.join(_class_rates(rows), "_v").groupBy(*b.base).agg((F.sum("_b") / F.sum("_a")).alias("value"))


def _affinity_weighted(df: DataFrame, b: Binding) -> DataFrame:
    rows = _labelled(df, b, _slot(b))
    return rows.join(_class_rates(rows), "_v").groupBy(*b.base).agg((F.sum("_b") / F.sum("_a") * F.sqrt(F.count("_v"))).alias("value"))


def _affinity_loo(df: DataFrame, b: Binding) -> DataFrame:
    rows = _labelled(df, b, _slot(b))
    unknown = F.when(F.col(b.target).isNull(), 1).otherwise(0)
    value = (F.col("_p") + 1 - F.col("_pos")) / (F.col("_p") + F.col("_q") + 1 + unknown)
    return rows.join(_by_value(rows), "_v").select(*b.base, value.alias("value"))


def _affinity_loo_em(df: DataFrame, b: Binding) -> DataFrame:
    """Shrunk towards the prior of the target value."""
    rows = _labelled(df, b, _slot(b))
    known = F.when(F.col(b.target).isNull(), 0).otherwise(1)
    value = (F.col("_p") + 2 * F.lit(float(b.prior)) - F.col("_pos")) / (F.col("_p") + F.col("_q") + 2 - known)
    return rows.join(_by_value(rows), "_v").select(*b.base, value.alias("value"))


def _affinity_cv(df: DataFrame, b: Binding) -> DataFrame:
    """From the other folds alone: mean counts of either class over the folds that have it, each from one.

    A value's sums over all folds less those of the row's own fold replace a join of unequal folds.
    """
    rows = _labelled(df, b, _slot(b), b.fold)
    some = rows.filter("_v IS NOT NULL").groupBy("_v", b.fold).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
    folds = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    total = some.groupBy("_v").agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_tq"), folds("_p").alias("_fp"), folds("_q").alias("_fq"))
    both = rows.join(some, ["_v", b.fold], "left").join(total, "_v", "left")

    def mean(t: str, own: str, n: str) -> Column:
        return F.coalesce((F.col(t) - F.col(own)) / F.nullif(F.col(n) - F.when(F.col(own) > 0, 1).otherwise(0), F.lit(0)), F.lit(0.0)) + 1

    p, q = mean("_tp", "_p", "_fp"), mean("_tq", "_q", "_fq")
    return both.groupBy(*b.base).agg(F.avg(p).alias("_a"), F.avg(q).alias("_b")).select(*b.base, (F.col("_a") / (F.col("_a") + F.col("_b"))).alias("value"))


def _odds(df: DataFrame, b: Binding) -> DataFrame:
    rows = _labelled(df, b, _slot(b))
    counts = _with_totals(_by_value(rows.filter(F.col("_pos") + F.col("_neg") > 0)), rows)
    tp, fp, p, q = F.col("_p") + 1, F.col("_q") + 1, F.col("_all_p") + 2, F.col("_all_q") + 2
    return rows.join(counts, "_v").select(*b.base, F.log(tp * (q - fp) / (fp * (p - tp))).alias("value"))


#: Classes of a target up to this number are broadcast.
MOST_CLASSES = 10_000


def _are_few(classes: DataFrame) -> bool:
    return classes.select("_t").limit(MOST_CLASSES + 1).count() <= MOST_CLASSES


def _by_class(df: DataFrame, classes: DataFrame, few: bool, salt_of: list[str]) -> DataFrame:
    """df with its class's facts. Few classes are broadcast; of many each has a row for each salt, so that a frequent one is no single task."""
    if few:
        return df.join(F.broadcast(classes), "_t")
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(salts)).cast("int")).join(spread, ["_t", "_salt"]).drop("_salt")


def _one(df: DataFrame, facts: DataFrame) -> DataFrame:
    """df beside the only row of facts, a scalar subquery; no rows if there is none."""
    row = facts.select(F.struct(*facts.columns)).scalar()
    return df.select("*", row.alias("_facts")).filter("_facts IS NOT NULL").select(*df.columns, "_facts.*")


def _direct_nb(df: DataFrame, b: Binding) -> DataFrame:
    """Naive Bayes posterior of the target value given one column; null is a value.

    A pair of value and class never seen counts as zero: with w = prior / (rows + levels) of a
    class, the posterior is w (1 + joint) of the target value over the sum of all w and of w joint
    over the pairs seen. No value meets a class that it wasn't seen with.
    """
    all_rows = df.select(*b.base, _slot(b).alias("_v"))
    rows = df.filter(F.col(b.target).isNotNull()).select(_slot(b).alias("_v"), F.col(b.target).alias("_t"))
    levels = all_rows.select("_v").distinct().agg(F.count("*").alias("_levels"))
    classes = rows.groupBy("_t").agg(F.count("*").alias("_rows"))
    total = classes.agg(F.sum("_rows").alias("_all"))
    classes = _one(_one(classes, total), levels).select("_t", (F.col("_rows") / F.col("_all") / (F.col("_rows") + F.col("_levels"))).alias("_w"))
    is_value = F.col("_t") == F.lit(b.target_value)
    sums = classes.agg(F.sum("_w").alias("_w_all"), F.sum(F.when(is_value, F.col("_w"))).alias("_w_value"))
    pairs = rows.groupBy("_v", "_t").agg(F.count("*").alias("_joint"))
    seen = _by_class(pairs, classes, _are_few(classes), ["_v"]).groupBy("_v").agg(F.sum(F.col("_w") * F.col("_joint")).alias("_seen"), F.sum(F.when(is_value, F.col("_joint")).otherwise(0)).alias("_own"))
    post = _one(seen, sums).select(F.col("_v").alias("_u"), (F.col("_w_value") * (1 + F.col("_own")) / (F.col("_w_all") + F.col("_seen"))).alias("value")).filter("value IS NOT NULL")
    return all_rows.join(post, F.col("_v").eqNullSafe(F.col("_u"))).select(*b.base, "value")


def _aggregate_nb(df: DataFrame, b: Binding) -> DataFrame:
    """Naive Bayes posterior over all of a base row's values; priors are shares of distinct ids.

    A pair of value and class never seen adds log(1 / (rows + levels)), one number a class: a base row
    of n values has log prior - n log(rows + levels) in each class, and n log(1 + joint) more for
    each pair seen. The first part depends on n and the class alone, is summed over kinds of
    classes (of equal rows and ids) for each n, and pairs seen put right what they change.
    """
    all_rows = df.select(*b.base, _slot(b).alias("_v"))
    rows = df.filter(F.col(b.target).isNotNull()).select(*b.ids, _slot(b).alias("_v"), F.col(b.target).alias("_t"))
    pairs = rows.groupBy("_v", "_t").agg(F.count("*").alias("_joint"))
    values = pairs.select(F.col("_v").alias("_u")).distinct()
    levels = values.agg(F.count("*").alias("_levels"))
    total = rows.select(*b.ids).distinct().agg(F.count("*").alias("_all"))
    ids = rows.select(*b.ids, "_t").distinct().groupBy("_t").agg(F.count("*").alias("_ids"))
    classes = _one(_one(rows.groupBy("_t").agg(F.count("*").alias("_rows")).join(ids, "_t"), total), levels)
    few = _are_few(rows.select("_t").distinct())
    classes = classes.select("_t", F.log(F.col("_ids") / F.col("_all")).alias("_prior"), F.log(F.col("_rows") + F.col("_levels")).alias("_size"))
    # Values are counted by base row first: a base row meets each value once.
    own = all_rows.groupBy(*b.base, "_v").agg(F.count("*").alias("_n"))
    lengths = own.join(values, F.col("_v").eqNullSafe(F.col("_u"))).groupBy(*b.base).agg(F.sum("_n").alias("_all_n"))
    lengths = lengths.join(_log_sums(lengths.select("_all_n").distinct(), classes, few), "_all_n")
    lift = pairs.select(F.col("_v").alias("_u"), "_t", F.log1p("_joint").alias("_lift"))
    more = own.join(lift, F.col("_v").eqNullSafe(F.col("_u"))).groupBy(*b.base, "_t").agg(F.sum(F.col("_n") * F.col("_lift")).alias("_more"))
    part = [c for c in b.base if c != b.target]
    scored = _by_class(more, classes, few, part).join(lengths.drop(b.target), part)
    scored = scored.withColumn("_plain", F.col("_prior") - F.col("_all_n") * F.col("_size"))
    top = F.greatest(F.max(F.col("_plain") + F.col("_more")).over(Window.partitionBy(*part)), F.col("_log_sum"))
    scored = scored.withColumn("_top", top)
    # exp(plain + more) - exp(plain), of which no part is negative.
    gain = F.exp(F.col("_plain") + F.col("_more") - F.col("_top")) - F.exp(F.col("_plain") - F.col("_top"))
    is_value = F.col("_t") == F.lit(b.target_value)
    sums = scored.groupBy(*b.base).agg(F.first("_all_n").alias("_all_n"), F.first("_top").alias("_top"), F.first("_log_sum").alias("_log_sum"), F.sum(gain).alias("_gain"), F.coalesce(F.sum(F.when(is_value, F.col("_more"))), F.lit(0.0)).alias("_more"))
    of_value = classes.filter(is_value).select("_prior", "_size")
    score = F.exp(F.col("_prior") - F.col("_all_n") * F.col("_size") + F.col("_more") - F.col("_top"))
    return _one(sums, of_value).select(*b.base, (score / (F.exp(F.col("_log_sum") - F.col("_top")) + F.col("_gain"))).alias("value"))


def _log_sums(lengths: DataFrame, classes: DataFrame, few: bool) -> DataFrame:
    """(_all_n, _log_sum): for each number of values the log of the sum over all classes of exp(prior - n size).

    Classes of one prior and size are one kind, with a weight. Kinds are packed in arrays of
    MOST_CLASSES, mostly one, and a length meets an array, never a class.
    """
    kinds = classes.groupBy("_prior", "_size").agg(F.count("*").alias("_weight"))
    packs = 1 if few else max(1, kinds.count() // max(1, MOST_CLASSES))
    packed = kinds.groupBy(F.pmod(F.xxhash64("_prior", "_size"), F.lit(packs)).alias("_pack")).agg(F.collect_list(F.struct((F.col("_prior") + F.log("_weight")).alias("p"), F.col("_size").alias("s"))).alias("_kinds"))
    each = lengths.withColumn("_pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long")))).join(F.broadcast(packed) if few else packed, "_pack")
    each = each.withColumn("_top", F.expr("array_max(transform(_kinds, k -> k.p - _all_n * k.s))"))
    each = each.withColumn("_sum", F.expr("aggregate(_kinds, 0D, (a, k) -> a + exp(k.p - _all_n * k.s - _top))"))
    top = F.max("_top").over(Window.partitionBy("_all_n"))
    return each.withColumn("_most", top).groupBy("_all_n").agg((F.first("_most") + F.log(F.sum(F.col("_sum") * F.exp(F.col("_top") - F.col("_most"))))).alias("_log_sum"))


def _direct_affinity(df: DataFrame, b: Binding) -> DataFrame:
    """Mean of a numeric target over the other rows of the value, with a little seeded noise; a half where there are none."""
    rows = df.select(*b.base, _slot(b).alias("_v"), F.col(b.target).cast("double").alias("_y"))
    sums = rows.filter("_v IS NOT NULL").groupBy("_v").agg(F.sum("_y").alias("_s"), F.count("_y").alias("_c"))
    noise = (F.pmod(F.xxhash64(*b.part), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * float(b.params["noise"]) + 1
    value = F.coalesce((F.col("_s") - F.col("_y")) / (F.col("_c") - 0.99) * noise, F.lit(0.5))
    return rows.join(sums, "_v").select(*b.base, value.alias("value"))


def _time_woe(df: DataFrame, b: Binding) -> DataFrame:
    """Mean weight of evidence of a part of the time."""
    rows = _labelled(df, b, F.expr(f"{b.params['field']}({quoted(b.columns['time' if 'time' in b.columns else 'date'])})"))
    counts = _with_totals(_by_value(rows), rows)
    return rows.join(_plain_woe(counts), "_v").groupBy(*b.base).agg(F.avg("_woe").alias("value"))


def _snapshot(descending: bool):
    def make(df: DataFrame, b: Binding) -> DataFrame:
        """The value of the row that ranks k-th by the number, ties by id. Ranking keeps k rows of a group."""
        k = int(b.params.get("rank", 1))
        x = F.expr(b.number("numerical"))
        rows = df.select(*b.base, x.alias("_x"), F.col(quoted(b.columns["id"])).alias("_i"), _slot(b).alias("_v")).filter("_x IS NOT NULL")
        place = F.row_number().over(Window.partitionBy(*b.base).orderBy(F.col("_x").desc() if descending else F.col("_x").asc(), "_i"))
        return rows.withColumn("_k", place).filter(F.col("_k") <= k).filter(F.col("_k") == k).select(*b.base, F.col("_v").alias("value"))

    return make


def _child_snapshot(df: DataFrame, b: Binding) -> DataFrame:
    """The value of the row with the greatest number; none where several have it."""
    rows = df.select(*b.base, F.expr(b.number("numerical")).alias("_x"), _slot(b, "any").alias("_v")).filter("_x IS NOT NULL")
    place = F.rank().over(Window.partitionBy(*b.base).orderBy(F.col("_x").desc()))
    first = rows.withColumn("_k", place).filter("_k = 1")
    return first.groupBy(*b.base).agg(F.count("*").alias("_n"), F.first("_v").alias("value")).filter("_n = 1").select(*b.base, "value")


def _tfidf(df: DataFrame, b: Binding) -> DataFrame:
    """How often the value occurs, times the log of how few ids have it."""
    is_value = F.expr(b.sql("{nominal} = {value}"))
    ids = F.struct(*b.ids)
    totals = df.agg(F.countDistinct(ids).alias("_d"), F.countDistinct(F.when(is_value, ids)).alias("_dt")).withColumn("_one", F.lit(1))
    own = df.filter(is_value).groupBy(*b.base).agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    return own.join(F.broadcast(totals), "_one").select(*b.base, (F.col("_n") * F.log(F.col("_d") / F.col("_dt"))).alias("value"))


_TARGET = {"needs_target": True}
_EXTRA = {"needs_target": True, "experimental": True}
frame("WOE", "1", ("nominal",), _woe, **_TARGET)
frame("Aggregate WOE", "n", ("nominal",), _aggregate_woe, **_TARGET)
frame("Affinity", "1", ("nominal",), _affinity, **_EXTRA)
frame("Affinity2", "n", ("nominal",), _affinity2, **_EXTRA)
frame("Affinity weighted", "n", ("nominal",), _affinity_weighted, **_EXTRA)
frame("Affinity cv", "1", ("nominal",), _affinity_cv, needs_fold=True, **_EXTRA)
frame("Affinity loo", "1", ("nominal",), _affinity_loo, **_EXTRA)
frame("Affinity loo em", "1", ("nominal",), _affinity_loo_em, **_EXTRA)
frame("Aggregate NB", "n", ("nominal",), _aggregate_nb, **_EXTRA)
frame("Direct NB", "1", ("nominal",), _direct_nb, **_EXTRA)
frame("Direct affinity LOO", "1", ("nominal",), _direct_affinity, params={"noise": (0.1,)}, experimental=True)
frame("Odds ratio", "1", ("nominal",), _odds, **_EXTRA)
frame("Tfidf", "n", ("nominal",), _tfidf, needs_value=True, experimental=True)
frame("Time date WOE", "n", ("date",), _time_woe, params={"field": ("day", "month", "year")}, **_EXTRA)
frame("Time WOE", "n", ("time",), _time_woe, params={"field": ("hour", "minute")}, **_EXTRA)
frame("WOE limit", "n", ("nominal",), _woe_limit, **_EXTRA)
frame("WOE mod", "1", ("nominal",), _woe_mod, **_EXTRA)
frame("WOE no loo", "1", ("nominal",), _woe_no_loo, **_EXTRA)
frame("Child snapshot", "n", ("any", "numerical"), _child_snapshot, experimental=True)
frame("Child snapshot top", "n", ("id", "nominal", "numerical"), _snapshot(True), params={"rank": (1, 2, 3)}, experimental=True)
frame("Child snapshot bottom", "n", ("id", "nominal", "numerical"), _snapshot(False), params={"rank": (1, 2, 3)}, experimental=True)
