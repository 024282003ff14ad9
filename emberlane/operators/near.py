"""Entities whose values are near in the same step, counted per pair: blocks of entities meet two at a time, and their pairs never move."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..sources.store import stored

#: Points in a range of entities, points that a block takes before it ends (an entity stays whole), pairs compared at once.
RANGE, BLOCK, STRIP = 1 << 18, 1 << 19, 1 << 20


def _block(rows: pa.Table) -> pa.RecordBatch:
    """One row: the first entity, and all points by (step, value) as an Arrow stream with entities and steps as dictionaries."""
    keys, steps = (rows.column(k).combine_chunks().dictionary_encode() for k in (0, 1))
    values = rows.column(2).to_numpy()
    order = np.lexsort((values, steps.indices.to_numpy()))
    columns = [pa.DictionaryArray.from_arrays(x.indices.take(pa.array(order)), x.dictionary) for x in (keys, steps)]
    points = pa.RecordBatch.from_arrays([*columns, pa.array(values[order])], ["key", "step", "value"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, points.schema) as out:
        out.write_batch(points)
    return pa.RecordBatch.from_arrays([keys.dictionary[:1], pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["first", "points"])


def _blocks(limit: int):
    """Blocks of whole entities from points (key, step, value) in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size > limit:
                rows = pa.Table.from_batches(held).combine_chunks()
                at = np.flatnonzero(np.diff(rows.column(0).chunk(0).dictionary_encode().indices.to_numpy())) + 1
                if not len(at):
                    break
                # the last change of entity up to the limit, the first one where an entity alone is longer
                end = int(at[max(0, np.searchsorted(at, limit, "right") - 1)])
                yield _block(rows[:end])
                held = rows[end:].to_batches()
                size -= end
        if size:
            yield _block(pa.Table.from_batches(held))

    return run


class _Points:
    """A block that was read again: number of entity, number of step and value of each point, by (step, value)."""

    def __init__(self, data: pa.Buffer):
        points = pa.ipc.open_stream(data).read_next_batch()
        self.data, self.keys, self.steps = data, points.column(0).dictionary, points.column(1).dictionary
        self.key, self.step = (points.column(k).indices.to_numpy() for k in (0, 1))
        self.value = points.column(2).to_numpy()
        self.wild = not np.isfinite(self.value).all()

    @cached_property
    def by_key(self) -> np.ndarray:
        return np.argsort(self.key, kind="stable")


def _at(step: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places in the order of (step, value), as complex numbers; what is not a number is as far up as infinity."""
    out = np.empty(len(step), np.complex128)
    out.real, out.imag = step, np.where(np.isnan(value), np.inf, value)
    return out


def _ranges(a: _Points, b: _Points, within: float) -> tuple[np.ndarray, ...]:
    """For each point of a, by entity: entity, value, and where in b's order the points that can be near it begin and end. That
    is a little more than the band, and all infinite values and those that are no numbers."""
    low, high = a.value * ((1 - within) * (1 - 1e-9)), a.value * ((1 + 1e-9) / (1 - within))
    low[a.value < 0] = high[a.value < 0] = np.inf
    unruly = ~np.isfinite(a.value)
    low[unruly], high[unruly] = -np.inf, np.inf
    # a step that b lacks is before all of b's
    step = pc.index_in(a.steps, value_set=b.steps).fill_null(-1).to_numpy()[a.step]
    places = _at(b.step, b.value)
    found = [np.searchsorted(places, _at(step, low), "left"), np.searchsorted(places, _at(step, high), "right")]
    if not b.wild:
        return tuple(x[a.by_key] for x in (a.key, a.value, *found))
    top = _at(step, np.full(len(step), np.inf))
    rest = [np.maximum(found[1], np.searchsorted(places, top, "left")), np.searchsorted(places, top, "right")]
    both = [np.concatenate(x) for x in ((a.key, a.key), (a.value, a.value), *zip(found, rest))]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


def _near(x: np.ndarray, y: np.ndarray, within: float, wild: bool) -> np.ndarray:
    """abs(x - y) <= within * greatest(x, y) as Spark compares doubles: NaN equals itself and is above all others."""
    near = ~(np.abs(x - y) > within * np.maximum(x, y))
    return near & ~((x == y) & np.isinf(x)) if wild else near


def _meet(a: _Points, b: _Points, within: float, strip: int) -> Iterator[pa.RecordBatch]:
    """The pairs of entities of two blocks with their number of steps. Strips of whole entities of the first one are compared
    with the second, so a pair is counted in one strip."""
    same, wild = a.data.equals(b.data), a.wild or b.wild
    key, value, start, stop = _ranges(a, b, within)
    counts = stop - start
    upto = np.cumsum(counts)
    p, n, wide = 0, len(key), len(b.keys)
    while p < n:
        q = int(np.searchsorted(upto, strip + (upto[p - 1] if p else 0), "right"))
        if q < n:
            q = int(np.searchsorted(key, key[q], "left"))
            q = q if q > p else int(np.searchsorted(key, key[p], "right"))
        c = counts[p:q]
        at = np.arange(c.sum()) + np.repeat(start[p:q] - (np.cumsum(c) - c), c)
        other = b.key[at]
        near = _near(np.repeat(value[p:q], c), b.value[at], within, wild)
        if same:
            near &= np.repeat(key[p:q], c) < other
        pairs = np.sort((np.repeat(key[p:q].astype(np.int64) * wide, c) + other)[near])
        p = q
        if not len(pairs):
            continue
        begins = np.concatenate([[0], np.flatnonzero(pairs[1:] != pairs[:-1]) + 1])
        left = pairs[begins] // wide
        columns = [a.keys.take(pa.array(left)), b.keys.take(pa.array(pairs[begins] - left * wide)), pa.array(np.diff(begins, append=len(pairs)))]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "steps"])


def _pairs(within: float, strip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                for x, y in zip(batch.column(0), batch.column(1)):
                    # a block meets many others in turn
                    if a is None or not a.data.equals(x.as_buffer()):
                        a = _Points(x.as_buffer())
                    yield from _meet(a, _Points(y.as_buffer()), within, strip)

    return run


def near_pairs(points: DataFrame, key: str, step: str, value: str, within: float, per_range: int = RANGE, block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """Pairs of keys a < b with the number of steps in which their values, as doubles, are near.

    Points are moved once, into ranges of keys that become packed blocks; the product of the blocks reads each pair of them in
    one task, which finds its pairs by binary search. Disk holds points and blocks, a task two blocks and a strip of pairs.
    """
    known = points.select(F.col(key).alias("_key"), F.col(step).alias("_step"), F.col(value).cast("double").alias("_value"))
    known = stored(known.filter("_key is not null and _step is not null and _value is not null"), "points")
    ranges = max(1, -(-known.count() // per_range))
    named = known.schema["_key"].dataType
    moved = known.repartitionByRange(ranges, "_key").sortWithinPartitions("_key")
    blocks = stored(moved.mapInArrow(_blocks(block), StructType([StructField("first", named), StructField("points", BinaryType())])), "blocks")
    a, b = blocks.toDF("_a", "_x"), blocks.toDF("_b", "_y")
    met = a.join(b.hint("shuffle_replicate_nl"), F.col("_a") <= F.col("_b")).select("_x", "_y")
    return met.mapInArrow(_pairs(within, strip), StructType([StructField("a", named), StructField("b", named), StructField("steps", LongType())]))
