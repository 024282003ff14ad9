"""Joins: enrichment, validity and overlap intervals, event windows, lags, one-to-one matching, patches, set comparison."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.cleaning import label_tier, normalize_name
from ..sources.store import stored


def enrich(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with one right row per key (the smallest of several), so the left side never grows."""
    value = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.min(F.struct(*value)).alias("_v")).select(*keys, "_v.*")
    return left.join(one, keys, "left")


def complete_cases(left: DataFrame, right: DataFrame, keys: list[str], covariates: list[str]) -> DataFrame:
    """Inner join, rows with a missing covariate dropped."""
    return left.join(right, keys).dropna(subset=covariates)


def diff_tables(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join with where each key is and which values differ (nulls are equal to nulls)."""
    x = a.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(1).alias("_a"))
    y = b.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(1).alias("_b"))
    side = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    differ = [(~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))).cast("int").alias(f"differs_{v}") for v in values]
    return x.join(y, keys, "full_outer").select(*keys, side.alias("side"), *differ)


def semi(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """C4"""
    return df.join(members.select(*keys), keys, "left_semi")


def anti(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """C4"""
    return df.join(members.select(*keys), keys, "left_anti")


def link_with_fallback(df: DataFrame, first: DataFrame, second: DataFrame, key1: str, key2: str, value: str) -> DataFrame:
    """The link by the first key, else by the second, and which of them gave it."""
    a = first.select(key1, F.col(value).alias("_v1")).dropDuplicates([key1])
    b = second.select(key2, F.col(value).alias("_v2")).dropDuplicates([key2])
    out = df.join(a, key1, "left").join(b, key2, "left")
    how = F.when(F.col("_v1").isNotNull(), key1).when(F.col("_v2").isNotNull(), key2).otherwise("none")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).withColumn("link", how).drop("_v1", "_v2")


def valid_on(df: DataFrame, lives: DataFrame, key: str, day: str, start: str, end: str, horizon: str) -> DataFrame:
    """Rows whose day lies in a life [start, end] of their key (an open end reaches the horizon), the earliest life first.

    The key is an equi-join key and the interval a residual; overlapping lives are settled by one aggregation per row.
    """
    life = lives.withColumn(end, F.coalesce(F.col(end), F.lit(horizon).cast("date")))
    ids = df.columns
    # a number per row, written once: equal rows stay apart, and a task that runs again finds the same numbers
    met = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows").join(life, key).filter(F.col(day).between(F.col(start), F.col(end)))
    others = [c for c in lives.columns if c != key]
    found = F.min(F.struct(start, *[c for c in others if c != start])).alias("_l")
    return met.groupBy("_row").agg(F.first(F.struct(*ids)).alias("_d"), found).select("_d.*", "_l.*")


def overlap_join(a: DataFrame, b: DataFrame, key: str, keep_unmatched: bool = True, bucket: int = 30) -> DataFrame:
    """Intervals [start, end] of the same key that overlap, with the distance of their starts.

    Both sides are listed by the blocks of ``bucket`` steps that they touch, so a key with many intervals is spread over the
    calendar; a pair counts in the block in which the later of the two starts. Rows without a match have nulls.
    """
    blocks = lambda s, e: F.sequence(F.floor(F.col(s) / bucket), F.floor(F.greatest(s, e) / bucket))
    x = a.select(key, F.col("start").alias("a_start"), F.col("end").alias("a_end")).select("*", F.posexplode_outer(blocks("a_start", "a_end")).alias("_at", "_block"))
    y = b.select(F.col(key).alias("_k"), F.col("start").alias("b_start"), F.col("end").alias("b_end")).select("*", F.explode(blocks("b_start", "b_end")).alias("_b"))
    on = (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")) & (F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start"))
    on = on & (F.col("_block") == F.floor(F.greatest("a_start", "b_start") / bucket))
    met = x.join(y, on, "left" if keep_unmatched else "inner")
    if keep_unmatched:
        # a row without any match stays once, with its first block
        some = F.count("b_start").over(Window.partitionBy(key, "a_start", "a_end")) > 0
        met = met.withColumn("_some", some).filter(F.col("b_start").isNotNull() | (~F.col("_some") & (F.coalesce("_at", F.lit(0)) == 0)))
    met = met.select(key, "a_start", "a_end", "b_start", "b_end")
    return met.withColumn("start_delta", F.col("b_start") - F.col("a_start"))


def event_steps(events: DataFrame, pre: int = 0, post: int = 0) -> DataFrame:
    """(symbol, step, event_id, start, end) for each step of each event's window; windows are short, so they are listed."""
    steps = F.explode(F.sequence(F.col("start") - pre, F.col("end") + post)).alias("step")
    return events.select("symbol", "event_id", "start", "end", steps)


def messages_in_windows(messages: DataFrame, events: DataFrame, pre: int = 7, post: int = 7) -> DataFrame:
    """Messages on a step of any event window of their symbol, each once."""
    return messages.join(event_steps(events, pre, post).select("symbol", "step").distinct(), ["symbol", "step"], "left_semi")


def assign_event(messages: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest event that contains a message; one row per key."""
    met = messages.join(event_steps(events), ["symbol", "step"])
    return met.groupBy(*keys).agg(F.min(F.struct("start", "event_id")).alias("_e")).select(*keys, F.col("_e.event_id").alias("event_id"))


def event_rollup(series: DataFrame, events: DataFrame, value: str = "n") -> DataFrame:
    """The sum of a series over each event; an event without rows has 0."""
    sums = event_steps(events).join(series, ["symbol", "step"]).groupBy("event_id").agg(F.sum(value).alias("total"), F.count("*").alias("steps"))
    return events.select("event_id").join(sums, "event_id", "left").na.fill(0, ["total", "steps"])


def _normal(text: Column) -> Column:
    """Upper case, '&' and the word AND as spaces, single spaces, a space at both ends."""
    words = F.regexp_replace(F.upper(text), r"&|\bAND\b", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(words, r"\s+", " ")), F.lit(" "))


def contains_join(texts: DataFrame, names: DataFrame, id_column: str, text: str) -> DataFrame:
    """C11: (id, symbol) where a normalised text contains a normalised name as whole words.

    Distinct words, without their texts, meet the first words of the names in an equi-join; a text is then joined once with
    its candidates and searched for them.
    """
    wanted = names.select("symbol", _normal(F.col("name")).alias("_n")).withColumn("_first", F.element_at(F.split(F.trim("_n"), " "), 1))
    normal = texts.select(id_column, _normal(F.col(text)).alias("_t"))
    words = normal.select(id_column, F.explode(F.array_distinct(F.split(F.trim("_t"), " "))).alias("_first"))
    candidates = words.join(wanted, "_first").groupBy(id_column).agg(F.collect_set(F.struct("symbol", "_n")).alias("_c"))
    met = normal.join(candidates, id_column)
    return met.select(id_column, F.explode(F.filter("_c", lambda c: F.contains("_t", c["_n"]))).alias("_m")).select(id_column, "_m.symbol").distinct()


def asof_value(events: DataFrame, prices: DataFrame) -> DataFrame:
    """The last known close at or before the peak, inside the event."""
    on = (events["symbol"] == prices["symbol"]) & prices["step"].between(events["start"], events["peak"]) & prices["close"].isNotNull()
    met = events.join(prices, on, "left")
    return met.groupBy("event_id").agg(F.max_by("close", prices["step"]).alias("close_at_peak"))


def lagged(panel: DataFrame, key: str, step: str, columns: list[str], k: int = 1) -> DataFrame:
    """Columns of ``k`` steps earlier by the step's number, not by the row's place; rows without them go."""
    past = panel.select(key, (F.col(step) + k).alias(step), *(F.col(c).alias(f"{c}_lag") for c in columns))
    return panel.select(key, step).join(past, [key, step])


def match_catalogs(a: DataFrame, b: DataFrame, by: str = "nearest") -> DataFrame:
    """One-to-one pairs of overlapping events of a symbol, greedily by nearest start or by longest overlap.

    Candidates come from the overlap join; the greedy choice runs per symbol, over that symbol's candidate pairs only.
    """
    pairs = overlap_join(a, b, "symbol", keep_unmatched=False)
    overlap = F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1
    score = F.abs("start_delta") if by == "nearest" else -overlap

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, rows = set(), set(), []
        for row in pdf.sort_values(["score", "a_start", "b_start"]).itertuples(index=False):
            if row.a_start not in left and row.b_start not in right:
                left.add(row.a_start)
                right.add(row.b_start)
                rows.append((row.symbol, row.a_start, row.b_start))
        return pd.DataFrame(rows, columns=["symbol", "a_start", "b_start"])

    scored = pairs.select("symbol", "a_start", "b_start", score.cast("long").alias("score"))
    return scored.groupBy("symbol").applyInPandas(greedy, "symbol string, a_start long, b_start long")


def anchor_facts(facts: DataFrame, events: DataFrame, ahead: int = 10) -> DataFrame:
    """For each fact the event that contains it, else the next ignition within ``ahead`` steps, else none."""
    e = events.select(F.col("symbol").alias("_s"), "event_id", "start", "end")
    inside = F.col("step").between(F.col("start"), F.col("end"))
    near = (F.col("start") > F.col("step")) & (F.col("start") <= F.col("step") + ahead)
    met = facts.join(e, (F.col("symbol") == F.col("_s")) & (inside | near), "left")
    rank = F.when(F.col("event_id").isNull(), 2).when(inside, 0).otherwise(1)
    best = met.groupBy("fact_id").agg(F.min(F.struct(rank.alias("rank"), "start", "event_id")).alias("_b"))
    rule = F.element_at(F.array(F.lit("inside"), F.lit("next"), F.lit("none")), F.col("_b.rank") + 1)
    return best.select("fact_id", F.col("_b.event_id").alias("event_id"), rule.alias("rule"))


def label_announcements(events: DataFrame, dates: DataFrame, within: int = 2) -> DataFrame:
    """C17: whether an announcement of the symbol lies within some steps of the ignition; listed around the dates."""
    near = dates.select("symbol", F.explode(F.sequence(F.col("step") - within, F.col("step") + within)).alias("start")).distinct()
    return events.join(near.withColumn("announced", F.lit(1)), ["symbol", "start"], "left").na.fill(0, ["announced"])


#: Words that say nothing about a company's name.
_COMPANY = r"\b(INC|CORP|CORPORATION|CO|LTD|PLC|LLC|SA|NV|HOLDINGS?|GROUP|COMPANY|THE|CL A|CL B)\b"


def plain_name(name: Column) -> Column:
    """A company's name before the first semicolon, upper case, without legal forms and signs; null is empty."""
    upper = F.upper(F.element_at(F.split(F.coalesce(name, F.lit("")), ";"), 1))
    return F.trim(F.regexp_replace(F.regexp_replace(upper, _COMPANY, ""), "[^A-Z0-9 ]", ""))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, as difflib counts them."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _linked(x: DataFrame, y: DataFrame, key: str, best: DataFrame) -> DataFrame:
    """Of the rows that have one of the most similar names, the one with the nearest value, then the smallest id.

    ``best`` has (key, a_name, b_name, similarity) for the most similar names of each name. Rows meet neighbours only: within a
    name of b, the values of both sides are put in order and each sees the last one below and the first one above. Rows
    without a value on either side come last.
    """
    points = y.groupBy(key, "b_name", F.col("b_value").alias("at")).agg(F.min("b_id").alias("b_id"))
    least = points.groupBy(key, "b_name").agg(F.min("b_id").alias("b_any"))
    asked = x.select(key, "a_name", F.col("a_value").alias("at")).distinct().join(best, [key, "a_name"])
    none = lambda df, *names: [F.lit(None).cast(dict(df.dtypes)[n]).alias(n) for n in names]
    met = asked.select(key, "b_name", "at", "a_name", "similarity", *none(points, "b_id"), F.lit(1).alias("_asks")).unionByName(
        points.filter("at is not null").select(key, "b_name", "at", *none(asked, "a_name", "similarity"), "b_id", F.lit(0).alias("_asks"))
    )
    seen = F.when(F.col("_asks") == 0, F.struct("at", "b_id"))
    w = lambda order: Window.partitionBy(key, "b_name").orderBy(order, "_asks").rowsBetween(Window.unboundedPreceding, 0)
    placed = met.withColumn("_below", F.last(seen, True).over(w(F.asc("at")))).withColumn("_above", F.last(seen, True).over(w(F.desc("at")))).filter("_asks = 1")
    place = lambda c: F.struct(F.abs(F.col("at") - F.col(c)["at"]).isNull().alias("none"), F.abs(F.col("at") - F.col(c)["at"]).alias("d"), F.col(c)["b_id"].alias("b_id"))
    there = placed.join(least, [key, "b_name"]).select(
        key, "a_name", "at", "similarity",
        F.least(*(F.when(F.col(c).isNotNull() & F.col("at").isNotNull(), place(c)) for c in ("_below", "_above")), F.struct(F.lit(True).alias("none"), F.lit(None).cast("double").alias("d"), F.col("b_any").alias("b_id"))).alias("m"),
    )
    chosen = there.groupBy(key, "a_name", F.col("at").alias("_at")).agg(F.min("m").alias("m"), F.first("similarity").alias("_s"))
    left = x.withColumnRenamed(key, "_k").withColumnRenamed("a_name", "_n")
    rows = left.join(chosen, (F.col("_k") == F.col(key)) & (F.col("_n") == F.col("a_name")) & F.col("a_value").eqNullSafe(F.col("_at")))
    s = F.nullif("_s", F.lit(-1.0))
    return rows.select("a_id", F.col("m.b_id").alias("b_id"), s.alias("similarity"), label_tier(s).alias("tier"))


def _best_of(scored: DataFrame, key: str) -> DataFrame:
    """The pairs of names with the highest similarity of a's name."""
    top = scored.groupBy(key, "a_name").agg(F.max("similarity").alias("_top"))
    return scored.join(top, [key, "a_name"]).filter("similarity = _top").select(key, "a_name", "b_name", "similarity")


def fuzzy_link_names(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Within a key (a symbol: few candidates), the most similar plain name, nearest value on ties, in tiers.

    ``a`` and ``b`` have id, name and value. Each distinct pair of names is compared once; rows don't meet in pairs.
    """
    x = a.select(key, F.col("id").alias("a_id"), plain_name(F.col("name")).alias("a_name"), F.col("value").alias("a_value"))
    y = b.filter("name is not null").select(key, F.col("id").alias("b_id"), plain_name(F.col("name")).alias("b_name"), F.col("value").alias("b_value"))
    x, y = stored(x, "left"), stored(y, "right")
    met = x.select(key, "a_name").distinct().join(y.select(key, "b_name").distinct(), key)
    scores = met.select("a_name", "b_name").distinct().repartition("a_name", "b_name").withColumn("similarity", F.round(_ratio("a_name", "b_name"), 6))
    scores = stored(scores, "scores")
    return _linked(x, y, key, stored(_best_of(met.join(scores, ["a_name", "b_name"]), key), "best"))


def _with_one_left_out(name):
    """A name and all that is left of it without one character: names at distance 1 or less have one of these in common."""
    some = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 0, some).otherwise(F.array(name))))


def fuzzy_link(a: DataFrame, b: DataFrame, key: str, parts: int = 8) -> DataFrame:
    """Within a key, the most similar name (edit distance over the longer length), nearest value on ties, in tiers.

    Distinct names are compared, not rows. Names at a distance of 0 or 1 meet by what is left without one character; from three
    characters on nothing further away is as similar. The other names of a key are compared with each of its names, in
    ``parts`` tasks a key. A missing name is less similar than any other.
    """
    coded = F.coalesce(F.concat(F.lit("="), "name"), F.lit(""))  # a missing name is "", so that joins find it
    x = stored(a.select(key, F.col("id").alias("a_id"), coded.alias("a_name"), F.col("value").alias("a_value")), "left")
    y = stored(b.select(key, F.col("id").alias("b_id"), coded.alias("b_name"), F.col("value").alias("b_value")), "right")
    names_a, names_b = x.select(key, "a_name").distinct(), y.select(key, "b_name").distinct()
    distance = F.levenshtein("a_name", "b_name")
    longest = F.greatest(F.length("a_name"), F.length("b_name")) - 1
    known = (F.col("a_name") != "") & (F.col("b_name") != "")
    similarity = F.coalesce(F.when(known, F.round(1 - F.try_divide(distance, longest), 6)), F.lit(-1.0)).alias("similarity")
    out = lambda df, c: df.filter(F.length(c) > 1).select(key, c, F.explode(_with_one_left_out(F.col(c))).alias("_part"))
    near = out(names_a.filter(F.length("a_name") > 3), "a_name").join(out(names_b, "b_name"), [key, "_part"]).filter(distance <= 1)
    close = stored(_best_of(near.select(key, "a_name", "b_name", similarity).distinct(), key), "close")
    rest = anti(names_a, close, [key, "a_name"]).withColumn("_part", F.pmod(F.xxhash64("a_name"), F.lit(parts)))
    everywhere = names_b.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    far = _best_of(rest.join(everywhere, [key, "_part"]).select(key, "a_name", "b_name", similarity), key)
    return _linked(x, y, key, stored(close.unionByName(far), "best"))


def apply_patches(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Values of the patch where it has any; keys that only the patch has are new rows."""
    columns = [c for c in base.columns if c != key]
    p = patches.select(key, *(F.col(c).alias(f"_p_{c}") for c in columns if c in patches.columns))
    fixed = base.join(p, key, "full_outer")
    return fixed.select(key, *(F.coalesce(f"_p_{c}", c).alias(c) if c in patches.columns else F.col(c) for c in columns))


def diff_registry(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """C20: keys that are new and keys that are missing."""
    return anti(new, old, [key]).select(key, F.lit("new").alias("change")).union(anti(old, new, [key]).select(key, F.lit("missing").alias("change")))


def union_blocks(blocks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Blocks of one schema with the number of times that each key occurs (1 everywhere: no overlap)."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out.withColumn("times", F.count("*").over(Window.partitionBy(*keys)))


def name_pairs(registry: DataFrame, words: int = 2) -> DataFrame:
    """pairs (a, b) of symbols whose names are the same once normalised (an equi-join on the name), each pair once."""
    named = registry.select("symbol", normalize_name(F.col("name"), words).alias("_name")).filter("_name <> ''").distinct()
    a, b = named.select(F.col("symbol").alias("a"), "_name"), named.select(F.col("symbol").alias("b"), "_name")
    return a.join(b, "_name").filter("a < b").select("a", "b").distinct()


def densify(series: DataFrame, step: str = "step", value: str = "n", keys: DataFrame | None = None) -> DataFrame:
    """Every step from the first to the last for every symbol, 0 where there was none."""
    ends = series.agg(F.min(step).alias("lo"), F.max(step).alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi")).alias(step))
    symbols = keys if keys is not None else series.select("symbol").distinct()
    # the calendar is one bounded list of steps: every symbol needs each of them
    grid = symbols.select("symbol").join(F.broadcast(spine))
    return grid.join(series, ["symbol", step], "left").na.fill(0, [value])


def pair_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of two pair sets, their intersection, differences and union, and the share of a that b reproduces."""
    x, y = a.distinct().withColumn("_a", F.lit(1)), b.distinct().withColumn("_b", F.lit(1))
    keys = a.columns
    met = x.join(y, keys, "full_outer")
    in_a, in_b = F.count("_a"), F.count("_b")
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return met.agg(in_a.alias("n_a"), in_b.alias("n_b"), both.alias("n_both"), (in_a - both).alias("only_a"), (in_b - both).alias("only_b"), F.count("*").alias("n_union"), F.round(both / in_a, 6).alias("reproduced"))


def recover_ids(wanted: DataFrame, known: DataFrame, keys: list[str], text: str, prefix: int = 50) -> DataFrame:
    """Ids found by keys and the first characters of a text, accepted only where they are unique."""
    k = known.withColumn("_p", F.substring(text, 1, prefix)).groupBy(*keys, "_p").agg(F.count("*").alias("_n"), F.min("id").alias("id")).filter("_n = 1")
    return wanted.withColumn("_p", F.substring(text, 1, prefix)).join(k, [*keys, "_p"], "left").drop("_p", "_n", text)
