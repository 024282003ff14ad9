"""Places of rows in an order over a whole table, and permutations of them, without a window that holds the table in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def numbered(df: DataFrame, *order: str | Column, name: str = "_number") -> DataFrame:
    """Rows with their place from 0: ranges of the order are numbered apart, then moved by the sizes of those before."""
    placed = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    # one row per range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = placed.withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    return inside.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


def numbered_median(values: DataFrame, column: str) -> float:
    """The median, from counts per distinct value numbered by ranges."""
    per = values.groupBy(column).agg(F.count("*").alias("_n"))
    n = values.count()
    if not n:
        return math.nan
    middle = running_counts(per, column, "_n")
    at = lambda k: float(middle.filter(F.col("_upto") > k).agg(F.min(column)).first()[0])
    return (at((n - 1) // 2) + at(n // 2)) / 2


def running_counts(per: DataFrame, order: str | list, count: str) -> DataFrame:
    """Rows with the running total of a column up to each (_upto), by ranges of the order."""
    placed = numbered(per, *(order if isinstance(order, list) else [order]), name="_place").withColumn("_block", F.expr("_place div 4096"))
    inside = placed.withColumn("_in", F.sum(count).over(Window.partitionBy("_block").orderBy("_place")))
    blocks = placed.groupBy("_block").agg(F.sum(count).alias("_all")).withColumn("_super", F.expr("_block div 4096"))
    within = Window.partitionBy("_super").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.groupBy("_super").agg(F.sum("_all").alias("_total"))  # a row per 16 million values
    above = tops.select("_super", F.coalesce(F.sum("_total").over(Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    offsets = blocks.select("_block", "_super", F.coalesce(F.sum("_all").over(within), F.lit(0)).alias("_before")).join(above, "_super")
    joined = inside.join(offsets.select("_block", (F.col("_before") + F.col("_above")).alias("_before")), "_block")
    return joined.withColumn("_upto", F.col("_in") + F.col("_before")).drop("_block", "_in", "_before", "_place")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Linearly interpolated quantiles of a column's values, from counts per distinct value numbered by ranges: no task holds
    all values. Empty for a column without values."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    counts = stored(running_counts(values.groupBy("v").agg(F.count("*").alias("_n")), "v", "_n"), "counts")
    n = counts.agg(F.sum("_n")).first()[0]
    if not n:
        return []
    at = [(n - 1) * s for s in shares]
    places = sorted({int(k) for a in at for k in (math.floor(a), math.ceil(a))})
    found = counts.agg(*(F.min(F.when(F.col("_upto") > k, F.col("v"))) for k in places)).first()
    value = dict(zip(places, found))
    return [value[math.floor(a)] + (value[math.ceil(a)] - value[math.floor(a)]) * (a - math.floor(a)) for a in at]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a permutation of 0 to n - 1 puts some numbers: eight Feistel rounds over the next power of two, walked until below n."""
    bits = max(2, (max(n, 2) - 1).bit_length())
    half = bits // 2
    sizes = (bits - half, half)
    out, left = numbers.astype(np.uint64), np.arange(len(numbers))
    while len(left):
        x = out[left]
        for turn in range(8):
            low_bits = sizes[turn % 2]
            high, low = x >> np.uint64(low_bits), x & np.uint64((1 << low_bits) - 1)
            f = _mixed(low + np.uint64((key * 8 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64((1 << (bits - low_bits)) - 1)
            # the halves change places, and with them their sizes
            x = (low << np.uint64(bits - low_bits)) | (high ^ f)
        out[left] = x
        left = left[x >= n]
    return out.astype(np.int64)


def bijection(n: int, replicas: int, seed: int) -> Callable:
    """For rows (number, value): per replica the value under the number that the replica's permutation gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, names = batch.column(0).to_numpy(), ["replica", batch.schema.names[0], batch.schema.names[1]]
            for r in range(1, replicas + 1):
                moved = permute(numbers, n, seed * 1_000_003 + r)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), r, np.int32)), pa.array(moved), batch.column(1)], names)

    return run
