"""Aggregations: counts, conservation, rankings, descriptives, rates, confusion, votes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .ranks import numbered, running_counts


def count_mentions(messages: DataFrame) -> DataFrame:
    """One for each message and distinct symbol in it, per step; ``symbols`` is an array."""
    return messages.select("step", F.explode(F.array_distinct("symbols")).alias("symbol")).groupBy("step", "symbol").agg(F.count("*").alias("n"))


def add_matrices(parts: list[DataFrame]) -> DataFrame:
    """Sums of long matrices; a missing cell is 0."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("step", "symbol").agg(F.sum("n").alias("n"))


def masters(rows: DataFrame, value: str = "n") -> DataFrame:
    """D3: totals by community, by kind, and over all, in one pass."""
    out = rows.groupingSets([[F.col("community")], [F.col("kind")], []], "community", "kind").agg(F.sum(value).alias("total"), F.grouping_id().alias("level"))
    return out.select("community", "kind", F.col("level").cast("long").alias("level"), "total")


def check_conservation(rows: DataFrame, value: str = "n") -> DataFrame:
    """D3: whether communities and kinds both add up to the whole."""
    m = masters(rows, value)
    at = lambda level: F.sum(F.when(F.col("level") == level, F.col("total")).otherwise(0))
    return m.agg(at(1).alias("by_community"), at(2).alias("by_kind"), at(3).alias("whole")).withColumn("holds", (F.col("by_community") == F.col("whole")) & (F.col("by_kind") == F.col("whole")))


def ingest_metrics(rows: DataFrame, file: str, in_month: Column, removed: Column, symbols: Column) -> DataFrame:
    """Read, in the month, removed, and of the rest the mentions and distinct symbols, per file; ``symbols`` is an array."""
    count = lambda c: F.count(F.when(c, 1))
    used = F.when(in_month & ~removed, symbols)
    r = rows.select(file, in_month.alias("_in"), (in_month & removed).alias("_gone"), used.alias("_s"))
    per = r.groupBy(file).agg(F.count("*").alias("n_read"), count(F.col("_in")).alias("n_in_month"), count(F.col("_gone")).alias("n_removed"), F.coalesce(F.sum(F.size("_s")), F.lit(0)).alias("n_mentions"))
    kinds = r.select(F.col(file).alias("_file"), F.explode("_s").alias("_k")).distinct().groupBy("_file").agg(F.count("*").alias("n_symbols"))
    return per.join(kinds, F.col(file).eqNullSafe(F.col("_file")), "left").drop("_file").na.fill(0, ["n_symbols"])


def rank_symbols(series: DataFrame) -> DataFrame:
    """Summary of each symbol."""
    return series.groupBy("symbol").agg(
        F.count("*").alias("steps"), F.sum("n").alias("total"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.min("step").alias("first"), F.max("step").alias("last")
    )


def describe(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact descriptives by group and over all (group null).

    Quantiles come from counts per distinct value, running over ranges of (group, value): no task holds a group.
    """
    plain = rows.rollup(by).agg(F.grouping(by).cast("int").alias("_all"), F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    per = stored(rows.select(by, F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy(by, "_v").agg(F.count("*").alias("_n")), "values")
    whole = per.groupBy("_v").agg(F.sum("_n").alias("_n")).select(F.lit(1).alias("_all"), F.lit(None).cast(per.schema[by].dataType).alias(by), "_v", "_n")
    both = per.select(F.lit(0).alias("_all"), by, "_v", "_n").unionByName(whole)
    counts = stored(running_counts(both, ["_all", by, "_v"], "_n"), "counts")
    sizes = counts.groupBy(F.col("_all").alias("_a"), F.col(by).alias("_b")).agg(F.min(F.col("_upto") - F.col("_n")).alias("_from"), F.sum("_n").alias("_size"))
    same = (F.col("_all") == F.col("_a")) & F.col(by).eqNullSafe(F.col("_b"))
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    place = lambda p: (F.col("_size") - 1) * F.lit(p)
    at = lambda k, name: F.min(F.when(F.col("_upto") - F.col("_from") > k, F.col("_v"))).alias(name)
    ends = [at(f(place(p)), f"{name}_{side}") for name, p in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = counts.join(sizes, same).groupBy("_a", "_b", "_size").agg(*ends)
    quantile = lambda name, p: F.round(F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (place(p) - F.floor(place(p))), 6).alias(name)
    return plain.join(found, same, "left").select(by, "n", "mean", *(quantile(name, p) for name, p in shares.items()))


def top_share(totals: DataFrame, key: str, value: str) -> DataFrame:
    """Cumulative share of the largest, over any number of keys: places and running sums come from ranges of the order."""
    summed = running_counts(totals.select(key, value), [F.desc(value), F.col(key)], value)
    all_ = totals.agg(F.sum(value).alias("_sum"))
    placed = numbered(summed, F.desc(value), F.col(key), name="_at").join(F.broadcast(all_))
    return placed.select(key, value, (F.col("_at") + 1).cast("int").alias("place"), F.round(F.col("_upto") / F.col("_sum"), 6).alias("share"))


def daily_sentiment(messages: DataFrame) -> DataFrame:
    """Counts per label and sums of probabilities by symbol and step."""
    n = lambda label: F.count_if(F.col("label") == label)
    return messages.groupBy("symbol", "step").agg(
        F.count("*").alias("n"), n("bull").alias("m_bull"), n("bear").alias("m_bear"), n("neutral").alias("m_neutral"),
        F.sum("p_bull").alias("s_bull"), F.sum("p_bear").alias("s_bear"), F.sum("p_neutral").alias("s_neutral"),
    )


def latest_and_trailing(rows: DataFrame, key: str, time: list[str], value: str, long: int = 63, short: int = 10) -> DataFrame:
    """The latest value and means of the last so many rows per key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(t) for t in time)))
    n = rows.withColumn("_n", place).filter(F.col("_n") <= long)
    return n.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("latest"), F.avg(F.when(F.col("_n") <= short, F.col(value))).alias("mean_short"), F.avg(value).alias("mean_long"))


def removal_rates(rows: DataFrame, by: list[str], removed: str, n: str) -> DataFrame:
    """Ratio of sums."""
    return rows.groupBy(*by).agg(F.round(F.try_divide(F.sum(removed), F.sum(n)), 6).alias("rate"), F.sum(n).alias("n"))


def weighted_rate(mix: DataFrame, rates: DataFrame, by: list[str], cell: list[str], fallback: float) -> DataFrame:
    """A composition-weighted rate, with a fallback where a cell has none."""
    return mix.join(rates.drop("n"), cell, "left").groupBy(*by).agg(F.round(F.sum(F.col("n") * F.coalesce("rate", F.lit(fallback))) / F.sum("n"), 6).alias("expected_rate"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of label pairs with margins (null: any)."""
    return rows.cube(a, b).agg(F.count("*").alias("n"))


def agreement_summary(rows: DataFrame, a: str, b: str, positive: str, negative: str) -> DataFrame:
    """Share of equal labels and number of inversions."""
    same, turned = F.col(a) == F.col(b), (F.col(a).isin(positive, negative) & F.col(b).isin(positive, negative) & (F.col(a) != F.col(b)))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(same.cast("int")), 6).alias("agreement"), F.count_if(turned).alias("inversions"))


def consensus(rows: DataFrame, key: str, columns: list[str], tie: str, valid: list[str]) -> DataFrame:
    """The most frequent valid vote; with no majority the tie breaker's vote, marked as a tie; votes are per row."""
    votes = F.filter(F.array(*columns), lambda v: v.isin(valid))
    counted = F.transform(F.array(*map(F.lit, valid)), lambda label: F.struct(F.size(F.filter(votes, lambda v: v == label)).alias("n"), label.alias("label")))
    best = F.array_max(counted)
    tied = F.size(F.filter(counted, lambda c: c["n"] == best["n"])) > 1
    own = F.when(F.col(tie).isin(valid), F.col(tie))
    label = F.when(F.size(votes) == 0, None).when(tied, own).otherwise(best["label"])
    return rows.select(key, label.alias("consensus"), F.when(F.size(votes) == 0, 0).otherwise(best["n"]).cast("long").alias("votes"), ((F.size(votes) > 0) & tied).alias("tie"))


def leaderboard(rows: DataFrame, gold: str, models: list[str], by: str) -> DataFrame:
    """Accuracy of each model per stratum and over all (null)."""
    long = rows.select(gold, by, *models).unpivot([gold, by], models, "model", "vote")
    return long.groupingSets([["model", by], ["model"]], "model", by).agg(F.round(F.avg((F.col("vote") == F.col(gold)).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def pairwise_agreement(rows: DataFrame, models: list[str]) -> DataFrame:
    """Share of equal votes of each pair of models, over rows where both voted; one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    found = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both(a, b)).alias("n"), F.round(F.avg((F.col(a) == F.col(b)).cast("int")), 6).alias("agreement")) for a, b in pairs]
    return rows.agg(F.array(*found).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*")


def _class_counts(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """label, hits, given and said rows of each class that occurs on either side."""
    long = rows.select(F.explode(F.array_distinct(F.array(gold, pred))).alias("label"), gold, pred)
    is_gold, is_said = F.col(gold) == F.col("label"), F.col(pred) == F.col("label")
    return long.groupBy("label").agg(F.count_if(is_gold & is_said).alias("tp"), F.count_if(is_gold).alias("support"), F.count_if(is_said).alias("predicted"))


def _f1() -> Column:
    return F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support"))


def classification_report(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    p, r = F.try_divide("tp", "predicted"), F.try_divide("tp", "support")
    return _class_counts(rows, gold, pred).select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_f1(), 6).alias("f1"))


def classification_summary(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Accuracy, macro F1, and balanced accuracy over the classes that occur, from counts; a class never said or never
    given has F1 0."""
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    return _class_counts(rows, gold, pred).agg(
        F.sum("support").alias("n"), F.round(F.try_divide(F.sum("tp"), F.sum("support")), 6).alias("accuracy"), F.round(F.avg(F.coalesce(_f1(), F.lit(0.0))), 6).alias("macro_f1"), F.round(F.avg(recall), 6).alias("balanced_accuracy")
    )


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Rows over classes times the class's rows, so that each class weighs the same."""
    per = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # one row per class
    return per.select(label, "n", (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))


def coverage_curve(rows: DataFrame, gold: str, pred: str, p: str, thresholds: list[float]) -> DataFrame:
    """Coverage and accuracy of the rows above each threshold."""
    long = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    above = F.col(p) >= F.col("threshold")
    hit = F.when(above, (F.col(gold) == F.col(pred)).cast("int"))
    return long.groupBy("threshold").agg(F.round(F.avg(above.cast("int")), 6).alias("coverage"), F.round(F.avg(hit), 6).alias("accuracy"))


def collect_states(rows: DataFrame, key: str, state: str) -> DataFrame:
    """The sorted set of states of a key, and whether there are several; states are few."""
    found = F.array_sort(F.collect_set(state))
    return rows.groupBy(key).agg(F.array_join(found, "|").alias("states"), (F.size(found) > 1).alias("mixed"))


def audit_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, keys that occur more than once."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.max("n").alias("most"))


def stance_ratio(rows: DataFrame, by: list[str], label: str, bull: str, bear: str) -> DataFrame:
    """D17"""
    b, s = F.count_if(F.col(label) == bull), F.count_if(F.col(label) == bear)
    return rows.groupBy(*by).agg(b.alias("n_bull"), s.alias("n_bear"), F.round(F.try_divide(b, s), 6).alias("ratio"), F.round(1 - (b + s) / F.count("*"), 6).alias("neutral_share"))


def coverage(entities: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Of the entities: covered, silent (known without rows of value), missing."""
    per = rows.groupBy(key).agg(F.sum("n").alias("_n"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 0, "silent").otherwise("covered")
    out = entities.select(key).join(per, key, "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def rescale_mass(weighted: DataFrame, original: DataFrame) -> DataFrame:
    """A weighted matrix with the original's total."""
    total = original.agg(F.sum("n").alias("_o"))
    mass = weighted.agg(F.sum("n").alias("_w"))
    return weighted.join(F.broadcast(total)).join(F.broadcast(mass)).select("symbol", "step", (F.col("n") * F.col("_o") / F.col("_w")).alias("n"))


def sample_median(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """The median of the first n values of a key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", place).filter(F.col("_n") <= n).groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count("*").alias("used"))


def source_profile(rows: DataFrame, source: str, day: str, text: str, score: str, link: Column | None = None) -> DataFrame:
    """Rows, days, shares of removed, of links, of empty, of usable and of long texts, median score, rows per day."""
    empty = F.col(text).isNull() | (F.length(text) == 0)
    removed = F.coalesce(F.col(text).isin("[removed]", "[deleted]"), F.lit(False))
    link = F.coalesce(link, F.lit(False)) if link is not None else F.lit(False)
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 6)
    return rows.groupBy(source).agg(
        F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), share(empty).alias("pct_empty"),
        share(removed).alias("pct_removed"), share(link).alias("pct_link"), share(~link & ~removed).alias("pct_usable"), share(F.length(text) >= 500).alias("pct_long"), F.percentile(score, F.lit(0.5)).alias("median_score"),
        F.round(F.count("*") / (F.max(day) - F.min(day) + 1), 6).alias("rows_per_day"),
    )
