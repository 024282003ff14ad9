"""Text detection and rule-based stance: dictionaries, mentions with routes, context gates, quotes, scoring, sampling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..sources.store import stored

#: The lexicon of directions, and what turns them.
BULL = [
    "buy", "bought", "buying", "long", "calls", "call", "yolo", "moon", "rocket", "hodl", "hold", "diamond hands", "bull", "bullish", "squeeze", "to the moon", "dip", "undervalued", "load", "loading",
]
BEAR = ["sell", "sold", "selling", "short", "shorting", "puts", "put", "bear", "bearish", "crash", "dump", "drill", "bagholder", "collapse", "tank", "overvalued", "bubble"]
NEGATIONS = ["don't", "dont", "not", "never", "no way", "won't", "wont", "wouldn't"]
#: Words that make a text financial, as whole words in any case.
FINANCE = """stock stocks shares share earnings trading trade trader market markets invest investor investors investing ipo
    buy sell price nasdaq nyse"""
FINANCE_WORDS = [*FINANCE.split(), "wall street", "squeeze", "short"]
#: The stricter list, for tokens of texts that are not about markets.
STRICT_FINANCE = ["stock", "stocks", "shares", "shareholder", "market", "markets", "invest", "investor", "investment", "wall street", "nasdaq", "dow", "s&p", "ipo", "earnings", "dividend"]
#: Words of company names that say nothing about the company.
STOP_WORDS = """inc incorporated corp corporation ltd limited plc
    co company companies holdings holding group class
    common stock shares share adr adrs ordinary
    trust fund sa nv ag spa the of de and
    new del international technologies technology tech
    investment investments capital financial finance
    industries industrial resources systems solutions
    partners properties brands media digital energy
    enterprises ventures labs pharmaceuticals pharma
    bancorp bancshares bank services
    equity liquidity research markets trading
    strategies strategy acquisition acquisitions
    insurance customers consumer products national
    global western southern northern pacific
    premier worldwide standard
    security healthcare mortgage diversified education
    payments network citizens institutions
    entertainment software airlines banking sports
    equipment drilling homes home merger mergers
    mining
    federal independent associated republic peoples
    heritage pioneer liberty enterprise""".split()
#: Phrases that are no company.
EXCLUDED_PHRASES = ["real estate", "united states", "very good"]


def compile_dictionary(names: DataFrame, excluded: list[str], common: list[str], phrases: list[str] = EXCLUDED_PHRASES) -> DataFrame:
    """G1: (symbol, route, key): cashtags for all, upper-case tokens of 3 to 5 letters, and from the words of the name that have
    three letters or more and say something about the company: a single one of 5 letters or more that isn't common, or the
    first two as a phrase that isn't excluded. A null name gives no words."""
    w = lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS)
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z ]", " "), " +"), w)
    n = names.select("symbol", words.alias("w"))
    one, two = F.get("w", F.lit(0)), F.array_join(F.slice("w", 1, 2), " ")
    upper = F.upper("symbol")
    entry = lambda route, key: F.struct(F.lit(route).alias("route"), key.alias("key"))
    routes = F.array(
        entry("cashtag", upper),
        F.when(upper.rlike("^[A-Z]{3,5}$") & ~upper.isin(excluded), entry("token", upper)),
        F.when((F.size("w") == 1) & (F.length(one) >= 5) & ~one.isin(common), entry("word", one)),
        F.when((F.size("w") >= 2) & ~two.isin(phrases), entry("phrase", two)),
    )
    return n.select("symbol", F.explode(F.filter(routes, lambda r: r.isNotNull())).alias("r")).select("symbol", "r.*").distinct()


#: Keys of texts that a task holds before it passes them on.
_HELD_KEYS = 1 << 16


def _text_keys(ahead: int):
    """For rows (id, cashtags, text): every key that a text has, by route, and for words what follows them (see ``mention_routes``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, routes, keys, follows = [], [], [], []

            def passed() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(places, pa.int64())), pa.array(routes, pa.string()), pa.array(keys, pa.string()), pa.array(follows, pa.string())]
                return pa.RecordBatch.from_arrays(columns, ["_id", "route", "key", "_follow"])

            for place, value in enumerate(batch.column(2)):
                text = value.as_py().decode("utf-8", "replace")
                tokens = {m.group() for m in _CAPITALS.finditer(text) if m.end() - m.start() <= 5 and not _LETTER_OR_DOLLAR.match(text[m.start() - 1 : m.start()]) and not _LETTER.match(text[m.end() : m.end() + 1])}
                words = _LOW_WORDS.findall(text.lower())
                after = _followers(words, ahead)
                for route, found in (("cashtag", set(batch.column(1)[place].as_py())), ("token", tokens), ("word", after)):
                    places += [place] * len(found)
                    routes += [route] * len(found)
                    keys += found
                    follows += found.values() if route == "word" else [None] * len(found)
                if len(keys) >= _HELD_KEYS:
                    yield passed()
                    places, routes, keys, follows = [], [], [], []
            yield passed()

    return run


_CAPITALS, _LOW_WORDS = re.compile("[A-Z]{3,}"), re.compile("[a-z]{3,}")
_LETTER, _LETTER_OR_DOLLAR = re.compile("[A-Za-z]"), re.compile("[A-Za-z$]")


def _followers(words: list[str], ahead: int) -> dict[str, str]:
    """For each distinct word: what stands after it, or after a longer word that ends with it, up to ``ahead`` words joined by
    spaces, each time behind a line break."""
    own = dict.fromkeys(words, "")
    if not ahead:
        return own
    following = words[1:] if ahead == 1 else [" ".join(words[k : k + ahead]) for k in range(1, len(words))]
    for word, rest in set(zip(words, following)):
        own[word] += "\n" + rest
    out, lengths = own.copy(), None
    for word, rests in own.items():
        sizes = range(len(word) - 1, 2, -1)
        if len(word) > 32:
            # of a long run of letters only ends as long as some word
            sizes = lengths = lengths or sorted({len(w) for w in own})
        for n in sizes:
            if n < len(word) and (end := word[-n:]) in out:
                out[end] += rests
    return out


def mention_routes(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, symbol, route). Cashtags, upper-case tokens and words are equi-joins on extracted keys; a phrase is
    looked up by its first word and then searched in the space-joined words (as a substring, not bounded by words).

    Texts are read once and never moved: a word travels with what follows it in its text, which is all that a phrase that
    begins with it needs, so that a match is decided where the keys meet the dictionary.
    """
    t = F.col(text)
    # a phrase is met by its first word, and has so many words more
    is_phrase = F.col("route") == "phrase"
    rest = F.when(is_phrase & F.contains("key", F.lit(" ")), F.expr("substring(key, locate(' ', key) + 1)"))
    wanted = stored(
        dictionary.select(
            F.when(is_phrase, "word").otherwise(F.col("route")).alias("route"),
            F.when(is_phrase, F.element_at(F.split("key", " "), 1)).otherwise(F.col("key")).alias("key"),
            "symbol",
            F.col("route").alias("_route"),
            rest.alias("_rest"),
        ),
        "dictionary",
    )
    ahead = wanted.filter("_rest is not null").agg(F.coalesce(F.max(F.size(F.split("_rest", " "))), F.lit(0))).first()[0]
    cash = F.transform(F.regexp_extract_all(t, F.lit(r"\$([A-Za-z]{1,5})\b"), F.lit(1)), F.upper)
    known = texts.filter(~t.isin("[removed]", "[deleted]")).select(F.col(key).alias("_id"), cash, t.cast("binary"))
    keys = known.mapInArrow(_text_keys(ahead), f"_id {texts.schema[key].dataType.simpleString()}, route string, key string, _follow string")
    met = keys.join(wanted, ["route", "key"])
    there = F.col("_rest").isNull() | ~F.contains("_rest", F.lit("\n")) & F.contains("_follow", F.concat(F.lit("\n"), "_rest"))
    return met.filter(there).select(F.col("_id").alias(key), "symbol", F.col("_route").alias("route")).distinct()


def detect_mentions(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """The set of symbols of each text."""
    return mention_routes(texts, key, text, dictionary).select(key, "symbol").distinct()


def detect_light(texts: DataFrame, key: str, text: str, symbols: list[str]) -> DataFrame:
    """Upper-case tokens of 2 to 5 letters among given symbols."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"(?<![A-Za-z$])([A-Z]{2,5})(?![A-Za-z])"), F.lit(1))
    return texts.select(key, F.explode(F.array_distinct(F.filter(tokens, lambda x: x.isin(symbols)))).alias("symbol"))


def count_occurrences(texts: DataFrame, key: str, text: str, names: DataFrame, most: int = 3) -> DataFrame:
    """Occurrences of names of 1 to ``most`` words, the longest first, each word counted once."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z]+)"), F.lit(1))
    w = texts.select(key, words.alias("_w"))
    placed = w.select(key, F.posexplode("_w").alias("place", "_one"), "_w")
    grams = placed.select(key, "place", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.array_join(F.slice("_w", F.col("place") + 1, n), " ").alias("gram")) for n in range(1, most + 1)))).alias("g")).select(key, "place", "g.*")
    hits = grams.join(names.select("symbol", F.lower("name").alias("gram")), "gram").filter(F.size(F.split("gram", " ")) == F.col("n"))
    # from left to right, the longest at a place first; what begins inside a name that was taken is passed over
    taken = F.expr(
        """aggregate(array_sort(collect_list(struct(place, -n as less, symbol))), cast(struct(0 as free, array() as symbols) as struct<free:int,symbols:array<string>>),
        (t, h) -> if(h.place >= t.free, struct(h.place - h.less as free, concat(t.symbols, array(h.symbol)) as symbols), t), t -> t.symbols)"""
    )
    return hits.groupBy(key).agg(taken.alias("s")).select(key, F.explode("s").alias("symbol")).groupBy(key, "symbol").agg(F.count("*").alias("n"))


#: What words are made of: letters and digits of any script and the underscore. Java's own word boundary has changed its meaning.
_IN_WORD = r"[\p{L}\p{N}_]"


def _whole(words: list[str]) -> str:
    """A pattern for one of some words or phrases with no letter, digit or underscore of any script beside it."""
    return f"(?<!{_IN_WORD})(" + "|".join(map(re.escape, words)) + f")(?!{_IN_WORD})"


def _any_word(words: list[str]) -> str:
    # a look at the first letter spares most places the look behind
    first = "".join(sorted({w[0] for w in words}))
    return f"(?iu)(?=[{re.escape(first)}])" + _whole(words)


def has_finance(text: Column, words: list[str] = FINANCE_WORDS) -> Column:
    return F.coalesce(text.rlike(_any_word(words)), F.lit(False))


def shouts(text: Column, share: float = 0.7) -> Column:
    """Whether more than a share of a text's letters are upper case."""
    # lengths count code points, as letters do; a list of all letters is never made
    without = lambda kind: F.length(text) - F.length(F.regexp_replace(text, rf"\p{{{kind}}}+", ""))
    return F.coalesce(without("Lu") > share * without("L"), F.lit(False))


def context_gate(text: Column) -> list[Column]:
    """Whether a text has finance words, and whether it shouts."""
    return [has_finance(text).alias("finance"), shouts(text).alias("shouts")]


def gated_routes(texts: DataFrame, key: str, text: str, dictionary: DataFrame, guarded: list[str]) -> DataFrame:
    """(key, symbol, route) with one route each: cashtag before token before name. A token among ``guarded`` symbols counts
    in a text with finance words only, as token_ctx."""
    found = mention_routes(texts, key, text, dictionary)
    context = texts.select(F.col(key).alias("_of"), has_finance(F.col(text)).alias("_finance"))
    rows = found.join(context, F.col(key) == F.col("_of"))
    is_guarded = (F.col("route") == "token") & F.upper("symbol").isin(guarded)
    rank = F.when(F.col("route") == "cashtag", 0).when(F.col("route") == "token", 1).otherwise(2)
    name = F.when(is_guarded, "token_ctx").when(F.col("route").isin("word", "phrase"), "name").otherwise(F.col("route"))
    kept = rows.filter(~is_guarded | F.col("_finance"))
    return kept.groupBy(key, "symbol").agg(F.min(F.struct(rank.alias("rank"), name.alias("route"))).alias("_r")).select(key, "symbol", F.col("_r.route").alias("route"))


def strict_routes(texts: DataFrame, key: str, text: str, dictionary: DataFrame, excluded_tokens: list[str] = ()) -> DataFrame:
    """As ``gated_routes`` for texts that are not about markets: no token counts in a text that shouts or has none of the
    strict finance words, nor an excluded one."""
    found = mention_routes(texts, key, text, dictionary)
    open_ = has_finance(F.col(text), STRICT_FINANCE) & ~shouts(F.col(text))
    rows = found.join(texts.select(F.col(key).alias("_of"), open_.alias("_open")), F.col(key) == F.col("_of"))
    kept = rows.filter((F.col("route") != "token") | (F.col("_open") & ~F.upper("symbol").isin(list(excluded_tokens))))
    rank = F.when(F.col("route") == "cashtag", 0).when(F.col("route") == "token", 1).otherwise(2)
    name = F.when(F.col("route").isin("word", "phrase"), "name").otherwise(F.col("route"))
    return kept.groupBy(key, "symbol").agg(F.min(F.struct(rank.alias("rank"), name.alias("route"))).alias("_r")).select(key, "symbol", F.col("_r.route").alias("route"))


def kwic(text: Column, word: str, around: int = 250) -> Column:
    """The text around the first occurrence of a word, or null."""
    at = F.locate(word.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.least(at, F.lit(around + 1)) - 1 + len(word) + around))


def direction_signals(text: Column) -> Column:
    """The distinct directional words of a text, sorted; whole words only, whatever script stands beside them."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_whole(BULL + BEAR)), F.lit(1))))


_WORD_HITS = re.compile(r"\b(" + "|".join(w for w in BULL + BEAR if " " not in w) + r")\b")
_PHRASE_HITS = re.compile(r"\b(" + "|".join(w for w in BULL + BEAR if " " in w) + r")\b")
_OPTIONS = re.compile(r"\bsell(?:ing)? (put|call)s?\b")


def stance(text: str | None) -> tuple[str, float, float, float]:
    """Options first (selling puts is bullish, selling calls bearish), then hits of words and phrases, each turned by a
    negation within the 25 characters before; the label and shares of bull, bear and neutral."""
    low = f" {(text or '').lower()} "
    sides = [m.group(1) == "put" for m in _OPTIONS.finditer(low)]
    low = _OPTIONS.sub(" ", low)
    for pattern in (_WORD_HITS, _PHRASE_HITS):
        for m in pattern.finditer(low):
            before = low[max(0, m.start() - 25) : m.start()]
            sides.append((m.group() in BULL) != any(n in before for n in NEGATIONS))
    bull = sum(sides)
    bear = len(sides) - bull
    total = bull + bear + 1
    label = "bull" if bull > bear else "bear" if bear > bull else "neutral"
    return label, bull / total, bear / total, 1 / total


def score_messages(df: DataFrame, text: str, scorer: Callable[[], Callable[[list[str | None]], list[tuple[str, float, float, float]]]] | None = None, batch: int = 512) -> DataFrame:
    """Label and probabilities from a pluggable scorer, made once per partition; batches are sorted by length.

    The default scorer is ``stance``.
    """
    schema = df.schema.simpleString()[len("struct<") : -1] + ",label:string,p_bull:double,p_bear:double,p_neutral:double"
    make = scorer or (lambda: lambda texts: [stance(t) for t in texts])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for pdf in parts:
            order = np.argsort(pdf[text].fillna("").str.len().to_numpy(), kind="stable")
            found: list = [None] * len(pdf)
            for lo in range(0, len(order), batch):
                mine = order[lo : lo + batch]
                for i, r in zip(mine, score([None if pd.isna(t) else t for t in pdf[text].iloc[mine]])):
                    found[i] = r
            yield pdf.assign(**{name: [f[k] for f in found] for k, name in enumerate(("label", "p_bull", "p_bear", "p_neutral"))})

    return df.mapInPandas(run, schema)


def score_long_text(df: DataFrame, key: str, text: str, words: int = 60) -> DataFrame:
    """Chunks of ``words`` words scored one by one; the majority of the directional ones."""
    # split in a step of its own: inside the lambda it would be done again for every chunk
    split = df.select(key, F.split(F.trim(F.col(text)), r"\s+").alias("_w"))
    w = F.col("_w")
    chunks = split.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / words).cast("int")), lambda i: F.array_join(F.slice(w, i * words + 1, words), " "))).alias("chunk"))
    votes = score_messages(chunks, "chunk").groupBy(key).agg(F.count("*").alias("chunks"), F.count_if(F.col("label") == "bull").alias("n_bull"), F.count_if(F.col("label") == "bear").alias("n_bear"))
    return votes.withColumn("label", F.when(F.col("n_bull") > F.col("n_bear"), "bull").when(F.col("n_bear") > F.col("n_bull"), "bear").otherwise("neutral"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' word sets; null when both are empty."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), "[^a-z]+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def stratified_sample(df: DataFrame, cell: list[str], id_column: str, quota: int, seed: int = 7) -> DataFrame:
    """The same number from each cell, by the order of a seeded hash; cells are cut to the quota per task first."""
    return capped_capture(df, cell, id_column, 1.0, quota, seed)


def capped_capture(df: DataFrame, cell: list[str], id_column: str, rate: float, cap: int, seed: int = 7) -> DataFrame:
    """Each row with a probability (by its hash), at most ``cap`` of a cell: those with the smallest hashes.

    Which rows can be in is decided per task first, by the ``cap`` smallest hashes there, so a cell is no task's burden.
    """
    h = F.xxhash64(F.lit(seed), id_column)
    able = df.withColumn("_h", h).filter(F.pmod("_h", F.lit(1 << 30)) < int(rate * (1 << 30)))
    first = Window.partitionBy(*cell, "_task").orderBy("_h", id_column)
    some = able.withColumn("_task", F.spark_partition_id()).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= cap)
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("_h", id_column))
    return some.withColumn("_n", place).filter(F.col("_n") <= cap).drop("_n", "_h", "_task")


def pick_without_reuse(df: DataFrame, id_column: str, cells: list[tuple[str, str, int]], total: int, seed: int = 7) -> DataFrame:
    """(id, cell) of a sample over cells (name, SQL condition, quota) in turn: each takes its quota from the rows that meet
    its condition and no earlier cell took, in the order of a hash of cell and id, until ``total``; what is left to it comes
    from any rows, as "filler". An id is taken once, however often it occurs.

    As all cells together take ``total`` ids at most, the first ``total`` of each cell hold all that it can take; these lists
    (cells times ``total``, both parameters) are what the driver walks through.
    """
    ids = df.filter(F.col(id_column).isNotNull())
    lists = []
    for name, condition, quota in [*cells, ("filler", "true", total)]:
        best = ids.filter(condition).select(F.col(id_column).alias("id")).distinct().select("id", F.xxhash64(F.lit(seed), F.lit(name), "id").alias("h")).orderBy("h", "id").limit(total)
        lists.append(best.select(F.lit(len(lists)).alias("k"), "id", "h"))
    rows = lists[0]
    for part in lists[1:]:
        rows = rows.unionByName(part)
    by_cell: dict[int, list] = {}
    for k, i, h in rows.collect():
        by_cell.setdefault(k, []).append((h, i))
    used: dict = {}
    for k, (name, _, quota) in enumerate([*cells, ("filler", "true", total)]):
        free = [i for _, i in sorted(by_cell.get(k, [])) if i not in used]
        for i in free[: min(quota, total - len(used))]:
            used[i] = name
    kind = df.schema[id_column].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(used.items()), f"{id_column} {kind}, cell string")


def sample_manifest(df: DataFrame, cell: list[str], id_column: str, fraction: float, seed: int = 7) -> DataFrame:
    """A fixed order in each stratum; a fraction selects a prefix of it, so larger fractions contain smaller ones.

    Rows are numbered by ranges of (stratum, hash); a stratum's places begin at its first number. There is one row per stratum.
    """
    placed = numbered(df.withColumn("_h", F.xxhash64(F.lit(seed), id_column)), *cell, "_h", id_column, name="_at")
    strata = placed.groupBy(*cell).agg(F.min("_at").alias("_first"), F.count("*").alias("_all"))
    same = [placed[c].eqNullSafe(strata[c]) for c in cell]
    out = placed.join(F.broadcast(strata), reduce(and_, same)).select(placed["*"], (F.col("_at") - F.col("_first") + 1).cast("int").alias("place"), "_all")
    return out.withColumn("chosen", F.col("place") <= F.ceil(F.col("_all") * fraction)).drop("_all", "_at", "_h")


def dual_series(df: DataFrame, by: list[str], native: str, scored: str) -> DataFrame:
    """Counts of bulls and bears by a native tag and by the scored label."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return df.groupBy(*by).agg(n(native, "bull").alias("native_bull"), n(native, "bear").alias("native_bear"), n(scored, "bull").alias("scored_bull"), n(scored, "bear").alias("scored_bear"))
