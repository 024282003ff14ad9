"""Sources and sinks: line-JSON posts, strict CSV, listing directories, windowed Parquet, matrices, news facts, snapshots.

Schemas are declared, never inferred. Readers take a path that Spark can open, or a DataFrame of text lines with one
column ``value``, so the same parsing serves batch files and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_utc", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("_bad", T.StringType()),
    ]
)


def parse_posts(lines: DataFrame) -> DataFrame:
    """A1: one JSON object per line; a malformed line is a row with only ``_bad``, so that it counts as read."""
    parsed = F.from_json("value", POST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("p")).select("p.*")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """A1 from files (plain or compressed); land as Parquet before heavy use, one compressed file is one task."""
    return parse_posts(spark.read.text(path))


def split_by_community(posts: DataFrame, names: list[str]) -> DataFrame:
    """A2: posts of the named communities, compared without case; ``community`` is the output partition."""
    return posts.withColumn("community", F.lower("subreddit")).filter(F.col("community").isin([n.lower() for n in names]))


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """A2: one directory per value; a sink for the fan-out."""
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def read_csv_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A3: '' is null and 'NA' is data."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def parse_csv_strict(lines: DataFrame, schema: str) -> DataFrame:
    """A3 for lines: the same rule on a column of text."""
    return lines.select(F.from_csv("value", F.lit(schema), {"nullValue": ""}).alias("c")).select("c.*")


def parse_listing(lines: DataFrame, names: list[str]) -> DataFrame:
    """A4: pipe-delimited rows by position; the footer ("File Creation Time") and test issues go."""
    cells = F.split("value", "\\|")
    rows = lines.filter(~F.col("value").startswith("File Creation Time"))
    rows = rows.select(*(F.trim(F.try_element_at(cells, F.lit(i + 1))).alias(n) for i, n in enumerate(names)))
    return rows.filter(F.coalesce(F.col("test_issue"), F.lit("N")) != "Y")


def union_listings(first: DataFrame, second: DataFrame) -> DataFrame:
    """A4: two directories of one schema; a symbol in both comes from the first (in one of them twice: its smallest row)."""
    both = first.withColumn("_feed", F.lit(0)).unionByName(second.withColumn("_feed", F.lit(1)))
    rest = [c for c in first.columns if c != "symbol"]
    return both.groupBy("symbol").agg(F.min(F.struct("_feed", *rest)).alias("_r")).select("symbol", *(F.col(f"_r.{c}").alias(c) for c in rest))


def keys_from_path(path: Column, pattern: str, names: list[str]) -> list[Column]:
    """A5: columns parsed from a file name by the groups of a pattern."""
    return [F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)]


def read_windowed(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """A5: Parquet files named by symbol and day, with those as columns; files may lack columns."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.select("*", *keys_from_path(F.input_file_name(), pattern, names))


def parse_json_array(lines: DataFrame, element: str) -> DataFrame:
    """A JSON array per value, one row per element, error elements removed."""
    rows = lines.select(F.posexplode(F.from_json("value", f"array<{element}>")).alias("place", "e")).select("place", "e.*")
    return rows.filter("error is null")


def first_per_id(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first record of each id in the order of files and places; records without an id go."""
    rest = [c for c in rows.columns if c != key and c not in order]
    known = rows.filter(F.col(key).isNotNull())
    return known.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def read_json_array(spark: SparkSession, path: str, element: str, key: str) -> DataFrame:
    """Files that hold one JSON array each, over several lines; the first record of an id by file name and place stays."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.from_json("value", f"array<{element}>").alias("_a"))
    rows = files.select("_file", F.posexplode("_a").alias("_place", "e")).select("_file", "_place", "e.*").filter("error is null")
    return first_per_id(rows, key, ["_file", "_place"])


def unpivot_matrix(df: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """A wide matrix as (day, symbol, n); only the named columns are read."""
    return df.select(day, *columns).unpivot(day, columns, "symbol", "n")


def pivot_matrix(df: DataFrame, symbols: list[str]) -> DataFrame:
    """Long to wide, zero-filled, columns in the given order (listing them saves a pass)."""
    return df.groupBy("day").pivot("symbol", symbols).agg(F.sum("n")).na.fill(0)


def scan_facts(df: DataFrame, time: str, low: str, high: str, theme: Column) -> DataFrame:
    """A time range and a theme; both reach the scan where the format allows it."""
    return df.filter((F.col(time) >= F.lit(low).cast("timestamp")) & (F.col(time) < F.lit(high).cast("timestamp")) & theme)


def inventory(rows: DataFrame, file: str, time: str) -> DataFrame:
    """Records, first and last day per file."""
    day = F.to_date(time)
    return rows.groupBy(file).agg(F.count("*").alias("records"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def file_sizes(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """The size of every file below a path, with keys parsed from its path; contents are not read.

    Scans pass over empty files, so the listing that the scan was planned with gives the names (no more than the driver holds
    for any scan of the folder), and those without a length have 0.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(plain("path").alias("path")).distinct()
    sized = files.select(plain("path").alias("path"), "length")
    out = listed.join(sized, "path", "left").na.fill(0, ["length"])
    return out.select("path", "length", *keys_from_path(F.col("path"), pattern, names)).filter(F.col(names[0]) != "")


def file_gaps(expected: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Of the files that there should be: there, empty or missing; files of one key count together."""
    per = sizes.groupBy(*keys).agg(F.sum("length").alias("_bytes"))
    state = F.when(F.col("_bytes").isNull(), "missing").when(F.col("_bytes") == 0, "empty").otherwise("there")
    return expected.select(*keys).join(per, keys, "left").select(*keys, state.alias("state"))


def write_snapshot(df: DataFrame, path: str, date: str) -> None:
    """A dated copy; only that date's partition is replaced."""
    df.withColumn("snapshot_date", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Compressed CSV with a header, for people; Parquet is the format between jobs."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """A10: a filtered projection written once and read back for several queries."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entities(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """An inline table of (symbol, name)."""
    return spark.createDataFrame(rows, "symbol string, name string")
