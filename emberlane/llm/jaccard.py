"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct 5-word shingles, hashed to 64 bits. Two sets of sizes x and y with a Jaccard
similarity of at least 0.75 differ in at most (x + y) / 7 elements. Sets are banded by size (powers of two); a set signs
in its own band, and in the next one if a partner there could be large enough. In a band, the feature domain (the hash
space) is cut into the same number of equal partitions for all sets, and a set's projection on a partition is one
signature. Take a set that allows k differences: two similar sets differ in at most k partitions, so of any k + 1 of its
non-empty partitions one is equal in both. The k + 1 may be chosen in any order that both sets share: signatures that
fewer sets have come first, so a set with k + 1 signatures of its own has no partner and is done, and signatures made only of
passages that many documents share are hardly ever needed. A set with too few non-empty partitions also signs with its
single shingles, by the same rule, so no pair is lost.

Sets of equal content are one node from the start. Signatures are shuffled packed: one row per task and bucket. Sets that
share a chosen signature are compared with the one of them whose signatures are the most common (the original among its
near copies), then with the next such one of another component. Only members that are still in different components are
compared with each other, block by block inside tasks, where parities per hash range (they never differ in more places
than the sets) drop nearly all that are not similar. Every pair left is verified on the whole sets. Nothing is capped; pairs inside a component are never listed.

Null texts and texts without words have an empty set and link with nothing; with fewer than five words the whole sequence
is the one shingle. Repeated and null ids stay rows of their own; an empty table gives no rows. Only the id and the text are
read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .words import SPACED_LOWER, Runs, mix, split

SHINGLE = 5
#: Signatures that a bucket holds, about; a flush of the signature pass holds half as many.
FLUSH = 1 << 20
#: Members of a bucket that one block of the cross check holds.
BLOCK = 256
#: Candidate ids that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64


def shingle_sets(values: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = split(values, SPACED_LOWER)
    runs, n = Runs(words.hashes), len(words.start)
    every = runs.of(np.arange(max(0, n - SHINGLE + 1)), np.arange(SHINGLE, max(SHINGLE, n + 1)))
    out, bounds = [], words.bounds.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(every[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(runs.of(np.array([a]), np.array([b])))
        else:
            out.append(np.empty(0, _U))
    return out


def node_of(found: np.ndarray) -> int:
    """One signed 64-bit number for the set's content."""
    h = mix(found + _U(0x51ED270B0A1F39C1)).sum(dtype=_U) + _U(len(found))
    return int(mix(np.array([h], _U)).view(np.int64)[0])


def allowed(x: int, y: int) -> int:
    """The most elements in which similar sets of these sizes differ."""
    return (x + y) // 7


def partitions(band: int) -> int:
    """Partitions of the feature domain for sets of 2**band to 2**(band + 1) - 1 elements."""
    return int(0.62 * (1 << band)) + 4


def signatures(found: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(scheme, k, signatures) of a set: k + 1 of the signatures suffice to meet every similar set of that scheme."""
    size = len(found)
    if not size:
        return []
    own, largest, out = size.bit_length() - 1, size * 4 // 3, []
    for band in (own, own + 1):
        top = min(largest, (2 << band) - 1)
        if top < 1 << band:
            break
        k = allowed(size, top)
        part = ((found >> _U(32)) * _U(partitions(band))) >> _U(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(mix(found + _U(77)), first)
        out.append((band, k, mix(sums + mix((part[first] << _U(8)) + _U(band)))))
        if len(first) <= k:
            out.append((band + 64, k, mix(found + mix(np.array([band + 64], _U)))))
    return out


def sketch(found: np.ndarray) -> bytes:
    """The parity of the number of elements in each equal range of the hash space, two to four ranges for an element."""
    bits = max(6, (2 * len(found)).bit_length())
    counts = np.bincount((found >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(parity: np.ndarray, width: int) -> np.ndarray:
    """Parities of ranges joined two by two until ``width`` bytes are left."""
    while parity.shape[1] > width:
        pairs = np.unpackbits(parity, axis=1).reshape(len(parity), -1, 2)
        parity = np.packbits(pairs[:, :, 0] ^ pairs[:, :, 1], axis=1)
    return np.ascontiguousarray(parity).view(_U)


def possible(na: np.ndarray, a: list[bytes], nb: np.ndarray, b: list[bytes]) -> np.ndarray:
    """Pairs (i, j) of two lists of (size, sketch) that may be similar: the sizes fit and few enough parities differ.

    Every differing parity needs an element in which the sets differ, so no similar pair is refused.
    """
    out = [np.empty((0, 2), np.int64)]
    groups_b = _by_length(b)
    for wa, ia in _by_length(a).items():
        xa = np.frombuffer(b"".join(a[i] for i in ia), np.uint8).reshape(len(ia), wa)
        for wb, ib in groups_b.items():
            if max(wa, wb) > 2 * min(wa, wb):
                continue
            xb = np.frombuffer(b"".join(b[i] for i in ib), np.uint8).reshape(len(ib), wb)
            fa, fb = _folded(xa, min(wa, wb)), _folded(xb, min(wa, wb))
            ma, mb = na[ia], nb[ib]
            for i in range(len(ia)):
                fits = np.flatnonzero(4 * np.minimum(ma[i], mb) >= 3 * np.maximum(ma[i], mb))
                if len(fits):
                    apart = np.bitwise_count(fb[fits] ^ fa[i]).sum(1, dtype=np.int64)
                    fits = fits[apart <= allowed(ma[i], mb[fits])]
                    out.append(np.stack([np.full(len(fits), ia[i]), ib[fits]], 1))
    return np.concatenate(out)


def _by_length(sketches: list[bytes]) -> dict[int, np.ndarray]:
    lengths = np.array([len(s) for s in sketches])
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


# -- passes over the texts


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base.forget()
    for ids, values in base.pieces(batches):
        found = shingle_sets(values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in found], pa.int64()),
                pa.array([sketch(s) if len(s) else None for s in found], pa.binary()),
                base.contents(values),
            ],
            ["doc_id", "n_shingles", "node", "sketch", "content"],
        )


def _signer(buckets: int):
    names = ["bucket", "low", "high", "nodes", "schemes", "counts", "slacks"]

    def flush(sigs: list[np.ndarray], owners: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        sig = np.concatenate(sigs)
        nodes, schemes, slacks, counts = (np.array(x) for x in zip(*owners))
        owner = np.repeat(np.arange(len(owners)), counts)
        bucket = ((sig >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sig, owner, bucket = sig[order], owner[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            lo, hi = edges[b], edges[b + 1]
            if lo < hi:
                own, n = np.unique(owner[lo:hi], return_counts=True)
                s = sig[lo:hi]
                parts = (s.astype("<u4"), ((s >> _U(32)) & _U(0xFFFF)).astype("<u2"), nodes[own].astype("<i8"), schemes[own].astype("u1"), n.astype("<u4"), slacks[own].astype("<i4"))
                rows.append((b, *(x.tobytes() for x in parts)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], names)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base.forget()
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        owners: list[tuple[int, int, int, int]] = []
        size = 0
        for _, values in base.pieces(batches):
            for found in shingle_sets(values):
                if not len(found) or (node := node_of(found)) in seen:
                    continue
                seen.add(node)
                for scheme, k, mine in signatures(found):
                    sigs.append(mine)
                    owners.append((node, scheme, len(mine) - (k + 1), len(mine)))
                    size += len(mine)
            if size >= FLUSH // 2:
                yield flush(sigs, owners)
                sigs, owners, size = [], [], 0
        if size:
            yield flush(sigs, owners)

    return sign


_PACKED = "bucket int, low binary, high binary, nodes binary, schemes binary, counts binary, slacks binary"
_SHARED = "sig long, node long, scheme int, slack int, freq int"


def _shared_of_bucket(table: pa.Table) -> pa.Table:
    base.forget()
    col = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    sig = (col("high", "<u2").astype(_U) << _U(32)) | col("low", "<u4").astype(_U)
    nodes, schemes, slacks = col("nodes", "<i8"), col("schemes", "u1").astype(np.int32), col("slacks", "<i4")
    owner = np.repeat(np.arange(len(nodes)), col("counts", "<u4"))
    order = np.lexsort((schemes[owner], nodes[owner], sig))
    sig, owner = sig[order], owner[order]
    # one node that several tasks signed counts once
    again = np.zeros(len(sig), bool)
    again[1:] = (sig[1:] == sig[:-1]) & (nodes[owner[1:]] == nodes[owner[:-1]]) & (schemes[owner[1:]] == schemes[owner[:-1]])
    sig, owner = sig[~again], owner[~again]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    freq = np.diff(np.append(first, len(sig)))
    freq = np.repeat(freq, freq)
    kept = freq > 1
    owner, bucket = owner[kept], int(table["bucket"][0].as_py())
    full = (sig[kept] | _U((bucket & 0x7FFF) << 48)).view(np.int64)
    return pa.table(
        {
            "sig": pa.array(full),
            "node": pa.array(nodes[owner]),
            "scheme": pa.array(schemes[owner]),
            "slack": pa.array(slacks[owner]),
            "freq": pa.array(freq[kept].astype(np.int32)),
        }
    )


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base.forget()
    for ids, values in base.pieces(batches):
        found = shingle_sets(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "blob"]
        )


# -- pairs


def _filter_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        na, nb = np.asarray(c["na"]), np.asarray(c["nb"])
        sa, sb = c["sa"].to_pylist(), c["sb"].to_pylist()
        ok = [bool(len(possible(na[i : i + 1], sa[i : i + 1], nb[i : i + 1], sb[i : i + 1]))) for i in range(len(sa))]
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([c["a"].filter(keep), c["b"].filter(keep)], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ok = pa.array([similar(np.frombuffer(x, _U), np.frombuffer(y, _U)) for x, y in zip(a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def _cross_check(table: pa.Table) -> pa.Table:
    """Possible pairs of members of one signature that are in different components, for the cells of one group."""
    base.forget()
    cell = np.asarray(table["cell"])
    order = np.argsort(cell, kind="stable")
    node, label, block, size = (np.asarray(table[n])[order] for n in ("node", "label", "side", "n"))
    sketches = table["sketch"].to_pylist()
    sketches = [sketches[i] for i in order.tolist()]
    cell = cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
    found = [np.empty((0, 2), np.int64)]
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(cell)]):
        own = np.arange(lo, hi)
        left = own[block[lo:hi] != 1]
        right = own[block[lo:hi] != 0]
        pairs = possible(size[left], [sketches[i] for i in left], size[right], [sketches[i] for i in right])
        a, b = left[pairs[:, 0]], right[pairs[:, 1]]
        ok = label[a] != label[b]
        a, b = node[a[ok]], node[b[ok]]
        found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
    out = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of an edge reaches. Large-star and small-star rounds to a fixed point."""
    links = base.stored(_canonical(edges), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = _canonical(both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        down = links.toDF("v", "u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.toDF("a", "b"))
        links = base.stored(_canonical(hung), "links")
    return links.select(F.col("b").alias("node"), F.col("a").alias("label")).union(links.select(F.col("a"), F.col("a")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class Join:
    """Sets, links and classes of a table of documents."""

    def __init__(self, docs: DataFrame):
        self.source = base.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.sets = base.stored(self.source.mapInArrow(_describe, "doc_id long, n_shingles long, node long, sketch binary, content long"), "sets")
        self.nodes = base.stored(
            self.sets.filter("node is not null")
            .groupBy("node")
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("r"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
            .select("node", F.col("r.doc_id").alias("rep"), F.col("r.content").alias("content"), "n", "sketch"),
            "nodes",
        )

    def members(self) -> DataFrame:
        """(sig, node, weight, leader, size) of the chosen signatures that two nodes or more share.

        A node's weight is how often its signatures occur in all: the original of a family of near copies weighs most, and
        leads.
        """
        total = self.sets.agg(F.sum("n_shingles")).first()[0] or 0
        buckets = max(48, math.ceil(total / FLUSH))
        packed = self.source.mapInArrow(_signer(buckets), _PACKED)
        shared = packed.groupBy("bucket").applyInArrow(_shared_of_bucket, _SHARED)
        ranked = shared.selectExpr(
            "sig", "node", "slack", "row_number() over (partition by node, scheme order by freq, sig) as place", "count(*) over (partition by node, scheme) as n_shared", "sum(freq) over (partition by node, scheme) as weight"
        )
        chosen = ranked.filter("place <= n_shared - slack").groupBy("sig", "node").agg(F.max("weight").alias("weight"))
        chosen = base.stored(chosen, "chosen")
        heads = chosen.groupBy("sig").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"), F.count("*").alias("size")).filter("size > 1")
        return base.stored(chosen.join(heads, "sig"), "members")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar."""
        pairs = base.stored(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(self.nodes, "node").select("rep", "content")
        wanted = base.stored(wanted, "wanted")
        small = wanted.count() <= BROADCAST_IDS
        # a set's first row, by id and content: ids may be null or stand on several texts
        same = self.source["doc_id"].eqNullSafe(wanted["rep"]) & (F.xxhash64(F.coalesce(self.source["text"], F.lit(""))) == wanted["content"])
        found = self.source.join(F.broadcast(wanted) if small else wanted, same, "left_semi")
        blobs = base.stored(found.mapInArrow(_blobs, "node long, blob binary").dropDuplicates(["node"]), "blobs")
        rows = pairs.join(blobs.toDF("a", "blob_a"), "a").join(blobs.toDF("b", "blob_b"), "b").select("a", "b", "blob_a", "blob_b")
        return base.stored(rows.mapInArrow(_verify, "a long, b long"), "verified")

    def links(self) -> DataFrame:
        """Links between nodes that connect exactly the nodes that similar pairs connect."""
        members = self.members()
        info = self.nodes.select("node", "n", "sketch")
        links = self.verified(self._plausible(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")), info))
        # second leaders: among those that their signature's first leader is not connected with
        placed = self._open(members.filter("size > 2"), links)
        first = placed.filter("node = leader").select("sig", F.col("label").alias("first"))
        others = placed.join(first, "sig").filter("label <> first")
        second = others.groupBy("sig").agg(F.max_by(F.struct("node", "label"), F.struct("weight", "node")).alias("head"))
        star = placed.join(second, "sig").filter("node <> leader and label <> head.label").select(F.col("head.node").alias("a"), F.col("node").alias("b"))
        links = base.stored(links.unionByName(self.verified(self._plausible(star, info))), "links")
        # the rest: members in different components, compared inside tasks; first leaders have met everyone already
        rest = self._open(placed.drop("label"), links).filter("node <> leader").select("sig", "node", "label")
        left = rest.groupBy("sig").agg(F.count("*").alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        # one task for about 4,096 rows of the members' cells
        groups = max(48, math.ceil((left.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0) / 4096))
        rest = rest.join(left, "sig").join(info, "node").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        cells = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.selectExpr(
            "xxhash64(sig, least(block, other), greatest(block, other)) as cell", "case when block = other then 2 when block < other then 0 else 1 end as side", "node", "label", "n", "sketch"
        )
        pairs = cells.withColumn("g", F.expr(f"pmod(cell, {groups})")).groupBy("g").applyInArrow(_cross_check, "a long, b long").distinct()
        return links.unionByName(self.verified(pairs))

    @staticmethod
    def _plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes and sketches allow a link."""
        rows = _canonical(pairs).join(info.toDF("a", "na", "sa"), "a").join(info.toDF("b", "nb", "sb"), "b")
        return rows.filter("4 * least(na, nb) >= 3 * greatest(na, nb)").mapInArrow(_filter_pairs, "a long, b long")

    @staticmethod
    def _open(members: DataFrame, links: DataFrame) -> DataFrame:
        """Members with their component so far, of the signatures that have more than one."""
        placed = base.stored(members.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
        several = placed.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("sig")
        return base.stored(placed.join(several, "sig", "left_semi"), "open")

    def classes(self) -> DataFrame:
        """Every row with its set size and the smallest doc_id of its component."""
        labels = components(self.links())
        placed = self.nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        placed = base.stored(placed, "labels")
        lowest = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
        found = placed.join(lowest, "label").select("node", "component_id")
        return (
            self.sets.select("doc_id", "n_shingles", "node")
            .join(found, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        )


def report(docs: DataFrame) -> DataFrame:
    return Join(docs).classes()


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the smallest doc_id (null ids last), of equal ids the smallest content.

    Rows are told apart by id and content, so rows with a null id or an id that several texts share are judged by their own
    text; of rows that repeat both one stays. Rows without words are linked with nothing and all stay.
    """
    join = Join(docs)
    labels = components(join.links())
    rows = join.sets.filter("node is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "content")).alias("w")
    winners = base.stored(rows.groupBy("label").agg(first).select(F.col("w.doc_id").alias("_win_id"), F.col("w.content").alias("_win")), "winners")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    has_words = text.rlike("[^\\x20\\x09-\\x0D]")
    same = docs["doc_id"].cast("long").eqNullSafe(winners["_win_id"]) & (F.xxhash64(text) == winners["_win"])
    kept = docs.filter(has_words).join(winners, same, "left_semi")
    if kept.count() > winners.count():
        # a winner's row is there more than once
        kept = kept.withColumn("_content", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).dropDuplicates(["doc_id", "_content"]).drop("_content")
    return kept.unionByName(docs.filter(~has_words))
