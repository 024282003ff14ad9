"""Shared plumbing: the cluster's shared folder, stored intermediate tables, Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch

#: Most bytes of text that one numpy pass inside a task holds at once; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20


#: What this worker process remembers between tasks, by operator.
_memory: dict[str, object] = {}


def remembered(owner: str, make):
    """An operator's memory in this worker (compiled tables, word caches); the first task of another operator drops it."""
    if owner not in _memory:
        _memory.clear()
        _memory[owner] = make()
    return _memory[owner]


def forget() -> None:
    """Drop what other operators left in this worker."""
    _memory.clear()


def written(df: DataFrame, name: str) -> str:
    """Write a table to the folder that driver and executors share; its path. It goes when the driver ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors, is computed once."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, under fixed names; other columns, whatever their names, play no part."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Values of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(doc_id, text) batches as lists of about ``most`` bytes of text at most; null texts are empty."""
    for batch in batches:
        ids, values = batch.column(0).to_pylist(), as_bytes(batch.column(1))
        lo = size = 0
        for i, value in enumerate(values):
            n = len(value or b"")
            if size and size + n > most:
                yield ids[lo:i], [v or b"" for v in values[lo:i]]
                lo, size = i, 0
            size += n + 1
        if lo < len(ids):
            yield ids[lo:], [v or b"" for v in values[lo:]]


def contents(values: list[bytes]) -> pa.Array:
    """What Spark's xxhash64 gives for the texts."""
    return pa.array(np.array([xxhash.xxh64_intdigest(v, 42) for v in values], np.uint64).view(np.int64))


def slices(value: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in order, cut at white space into slices of about ``size`` bytes; a longer word stays whole."""
    at = 0
    while len(value) - at > size:
        end = at + size
        while end < len(value) and value[end] not in b"\t\n\x0b\x0c\r ":
            end += 1
        yield value[at:end]
        at = end
    yield value[at:]


def crc_remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor
