"""Column functions and small transforms for cleaning: tombstones, days, message texts, names, symbols, flags, labels."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Markers of removed texts.
TOMBSTONES = ["[removed]", "[deleted]", ""]
#: Company-name suffixes that carry no meaning: a short list of our own, a parameter of ``normalize_name``.
SUFFIXES = "inc incorporated corp corporation co company ltd limited plc llc lp sa nv ag holdings holding group trust the".split()


def is_tombstone(text: Column) -> Column:
    """B1: null, removed, deleted or empty."""
    return text.isNull() | text.isin(TOMBSTONES)


def drop_tombstones(df: DataFrame, text: str) -> DataFrame:
    return df.filter(~is_tombstone(F.col(text)))


def utc_day(epoch: Column) -> Column:
    """B2: epoch seconds (integer or decimal text) to a UTC day; null when unparsable."""
    return F.to_date(F.timestamp_seconds(epoch.try_cast("double").cast("long")))


def with_utc_day(df: DataFrame, epoch: str, month: str | None = None) -> DataFrame:
    """B2: adds ``day``; rows that can't be parsed, or lie outside the file's month (yyyy-MM), go."""
    out = df.withColumn("day", utc_day(F.col(epoch))).filter("day is not null")
    return out.filter(F.date_format("day", "yyyy-MM") == month) if month else out


def message_text(kind: Column, title: Column, body: Column, limit: int = 800) -> Column:
    """Posts are title, line break, body (a tombstone body is empty); comments are the body; the first ``limit`` characters."""
    own = F.when(is_tombstone(body), "").otherwise(body)
    return F.substring(F.when(kind == "post", F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), own)).otherwise(body), 1, limit)


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities, and UTF-8 that was once read as Latin-1."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = html.unescape(t)
        try:
            return t.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return t  # it was no such text

    return text.map(one)


def strip_html(text: Column) -> Column:
    """Scripts, styles, comments and tags out, white space to single spaces."""
    out = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))


def clean_html(text: Column) -> Column:
    return unescape(strip_html(text))


def normalize_name(name: Column, words: int = 2, suffixes: list[str] = SUFFIXES) -> Column:
    """Lower case, letters only, without corporate suffixes, the first ``words`` words."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z ]", " "), " +"), lambda w: (w != "") & ~w.isin(suffixes))
    return F.array_join(F.slice(parts, 1, words), " ")


def base_symbol(symbol: Column) -> Column:
    """The leading letters and digits, up to the first mark."""
    return F.regexp_extract(F.upper(symbol), r"^([A-Z0-9]+)", 1)


def root_symbol(symbol: Column) -> Column:
    """Five-letter symbols of units, warrants and rights end in U, W or R; their root has four letters."""
    return F.when(symbol.rlike("^[A-Z]{4}[UWR]$"), F.substring(symbol, 1, 4)).otherwise(symbol)


def valid_symbol(symbol: Column) -> Column:
    """B7"""
    return symbol.rlike(r"^[A-Z0-9.\-]{1,10}$")


def equity_code(code: Column) -> Column:
    """Share codes whose units digit is 4 or 5, or whose tens digit is 7, 2 or 4, are no ordinary equity."""
    unit, ten = code % 10, F.floor(code / 10) % 10
    return ~unit.isin(4, 5) & ~ten.isin(7, 2, 4)


#: Symbols of crypto equities, and the patterns of names.
CRYPTO = "RIOT MARA HIVE HVBT HUT BITF CLSK CIFR WULF CORZ IREN BTBT CAN EBON SOS BTCS GREE ARBK COIN MSTR BTDR ABTC BTM SDIG DGHI MIGI BTOG".split()
SPAC_NAME = r"\bACQUISITION\b|\bACQUISITIONS\b|\bSPAC\b"
CRYPTO_NAME = r"\bBITCOIN\b|\bBLOCKCHAIN\b|\bCRYPTO\b|\bETHEREUM\b|\bDIGITAL ASSET"
ADR_NAME = "ADR|AMERICAN DEPOSITARY"
NON_SHARE_NAME = "Warrant|Right|Unit|Preferred|Preference|Depositary|Notes? Due|Debenture|Bond|Trust Preferred|Subordinated"


def flag_instruments(name: Column, symbol: Column, code: Column) -> list[Column]:
    """Flags from the name; a crypto equity is listed or named so, and no fund (share code 7x). A missing name has no flag."""
    upper = F.coalesce(F.upper(name), F.lit(""))
    crypto = F.coalesce(symbol.isin(CRYPTO), F.lit(False)) | upper.rlike(CRYPTO_NAME)
    fund = F.coalesce(F.floor(code / 10) == 7, F.lit(False))
    return [upper.rlike(SPAC_NAME).alias("is_spac"), (crypto & ~fund).alias("is_crypto"), upper.rlike(ADR_NAME).alias("is_adr"), F.coalesce(name, F.lit("")).rlike(f"(?i){NON_SHARE_NAME}").alias("is_non_share")]


def parse_day(text: Column) -> Column:
    """Yyyymmdd, ISO, day first with a two- or four-digit year, or RFC-like."""
    return F.to_date(
        F.coalesce(
            F.try_to_timestamp(F.when(text.rlike("^[0-9]{8}$"), text), F.lit("yyyyMMdd")),
            F.try_to_timestamp(F.when(text.rlike("^[0-9]{4}-"), F.substring(text, 1, 10)), F.lit("yyyy-MM-dd")),
            F.try_to_timestamp(F.when(text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), text), F.lit("d/M/yyyy")),
            F.try_to_timestamp(F.when(text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"), text), F.lit("d/M/yy")),
            F.try_to_timestamp(F.when(text.rlike("^[A-Z][a-z]{2} [A-Z]"), F.concat_ws(" ", F.substring(text, 5, 6), F.substring(text, -4, 4))), F.lit("MMM dd yyyy")),
        )
    )


def parse_iso_duration(text: Column) -> Column:
    """PT#H#M#S in seconds."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"([0-9]+){unit}", 1).try_cast("long"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


def clean_trend(value: Column) -> Column:
    """B11: '<1' is a half, '' is zero."""
    return F.when(F.trim(value) == "<1", 0.5).when(F.coalesce(F.trim(value), F.lit("")) == "", 0.0).otherwise(value.try_cast("double"))


def flatten_subtitles(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines "start --> end | words" as ordered segments; markup goes; consecutive repeats become one, its end extended."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line"))
    cue = r"^([0-9.]+) --> ([0-9.]+) \| (.*)$"
    cues = lines.filter(F.col("line").rlike(cue)).select(
        key,
        "place",
        F.regexp_extract("line", cue, 1).cast("double").alias("start"),
        F.regexp_extract("line", cue, 2).cast("double").alias("end"),
        F.trim(F.regexp_replace(F.regexp_extract("line", cue, 3), "<[^>]*>", "")).alias("words"),
    )
    order = Window.partitionBy(key).orderBy("place")
    change = (F.col("words") != F.lag("words").over(order)) | F.lag("words").over(order).isNull()
    runs = cues.withColumn("run", F.sum(change.cast("int")).over(order))
    return runs.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("words").alias("words"))


def impute_sentiment(df: DataFrame, counts: list[str], d: str, b: str) -> DataFrame:
    """Counts 0, disagreement 0.5 with a dummy, optimism 0."""
    return df.withColumn("no_direction", F.col(d).isNull().cast("int")).na.fill(0, counts).na.fill({d: 0.5, b: 0.0})


def derive_covariates(z: Column, base: Column, amplitude: Column, volume_ratio: Column) -> list[Column]:
    """B14"""
    return [
        F.log1p(F.greatest(z, F.lit(0.0))).alias("log_z"),
        F.log1p(F.greatest(base, F.lit(0.0))).alias("log_base"),
        F.log(F.greatest(amplitude, F.lit(0.1))).alias("log_amplitude"),
        F.log(F.greatest(volume_ratio, F.lit(0.1))).alias("log_volume"),
    ]


def label_coupling(lag: Column) -> Column:
    """The price peak less than two days from the attention peak is synchronous, before it leads, after it trails."""
    return F.when(lag.isNull(), "no_price").when(F.abs(lag) < 2, "synchronous").when(lag < 0, "price_leads").otherwise("price_trails")


def label_phase(day: Column, start: Column, end: Column) -> Column:
    """Days around an event."""
    return F.when(day < start, "pre").when(day > end, "post").otherwise("event")


def label_life(delisted: Column, following: Column) -> Column:
    """How a life of a symbol ended: delisted, renamed (another symbol follows), or not."""
    return F.when(delisted, "delisted").when(following.isNotNull(), "renamed").otherwise("active")


def label_era(year: Column) -> Column:
    """The years to 2021, 2022 and 2023, and those after."""
    # fixed values: the names of the eras
    return F.when(year <= 2021, "2020-2021 meme").when(year <= 2023, "2022-2023").otherwise("2024-2026")


def label_tier(similarity: Column) -> Column:
    """How strong a match of names is."""
    return F.when(similarity >= 0.8, "high").when(similarity >= 0.5, "middle").otherwise("low")


def label_listing(registered: Column, first_filing: Column, since: Column) -> list[Column]:
    """An approximate listing date and how it was found; an old registration is for review, no date is for handwork."""
    by = F.when(registered >= since, "registration").when(registered.isNotNull(), "review_old_registration").when(first_filing >= since, "first_filing").otherwise("manual")
    return [F.coalesce(registered, F.when(first_filing >= since, first_filing)).alias("listed"), by.alias("listing_method")]


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def content_hash(text: Column) -> Column:
    """Identity of a trimmed text."""
    return F.sha2(F.trim(text), 256)


def exclude_overlap(train: DataFrame, gold: DataFrame, text: str) -> DataFrame:
    """Training rows whose text is not in the gold set."""
    seen = gold.select(content_hash(F.col(text)).alias("_hash")).distinct()
    return train.withColumn("_hash", content_hash(F.col(text))).join(seen, "_hash", "left_anti").drop("_hash")


def array_pick(labels: Column, values: Column, prefix: str, earliest: bool = True) -> Column:
    """Of two aligned arrays, the earliest (or latest) value whose label has a prefix."""
    chosen = F.transform(F.filter(F.arrays_zip(labels.alias("l"), values.alias("v")), lambda x: x["l"].startswith(prefix)), lambda x: x["v"])
    return F.array_min(chosen) if earliest else F.array_max(chosen)
