"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both tokenizers read a space and the text. Byte offsets where tokens of both end cut the tokens into groups; inside a group
every pair of tokens whose bytes overlap is a link. A pair's count is the number of documents that hold it linked.

A space between two characters that are neither white space nor U+2581 begins a new token in both vocabularies, whatever
stands around it (in A every run of white space gives its last space to the word behind it, in B no piece holds a space
behind another character). Between such spaces the tokens depend on nothing else, so a worker remembers each stretch
with its tokens, groups and pairs; a text is a list of remembered stretches.

Texts of over ``CHUNK`` bytes are cut into byte ranges that different tasks align. The ranges end anywhere, also inside
tokens and groups; a chunk's text reaches on both sides to the next stretch border, so that its tokens are right, and it
owns the tokens that end in its range. A chunk gives a fragment: an open prefix (tokens up to the first common end), closed
groups, an open suffix (tokens behind the last one); without a common end everything is prefix. Composing two neighbours
joins the left suffix and the right prefix to one group. This is associative, and levels of groups of ``FAN`` fragments are
composed until one is left for each text; closed groups stay where they are, only open ends travel. A digest streams over a
text's groups in the order of chunks.

Pair counts add up distinct pairs per document. Pairs with over a ``SHARE``-th part of all (document, pair) rows are fewer
than ``SHARE`` and are broadcast; the rows of all other pairs are joined by pair, none of which is hot.

Null and empty texts, and texts that the tokens don't give back byte by byte, have no tokens. Rows that repeat a doc_id are
documents of their own, null ids too. An empty table gives no rows. Only the id and the text are read, whatever other
columns there are.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a chunk of a long text.
CHUNK = 1 << 16
#: Fragments that one task composes to one.
FAN = 16
#: A pair is broadcast if it has more than this part of all (document, pair) rows.
SHARE = 1 << 19
#: Stretches a worker remembers; beyond it the memory starts anew, with the same results.
MEMORY = 200_000
_CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")

_ENDS = "a array<int>, a_end array<long>, b array<int>, b_end array<long>"
_FRAGMENT = f"row long, chunk long, ok boolean, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>, closes long, pre struct<{_ENDS}>, suf struct<{_ENDS}>"
_NODE = f"row long, chunk long, groups string, pairs array<int>, closes long, pre struct<{_ENDS}>, suf struct<{_ENDS}>"
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = special[i] if i in special else bytes(byte[c] for c in token)
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        # ids as text with what may follow them, for each vocabulary: inside a side of a group, or behind its last token
        self.a_text = np.array([f"{i}," for i in range(len(self.a_bytes))] + [f"{i}|" for i in range(len(self.a_bytes))], object)
        self.b_text = np.array([f"{i}," for i in range(self.size_b)] + [f"{i};" for i in range(self.size_b)], object)

    def encode(self, parts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B for a space and each part; both lists are empty where they don't give it back."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)
        want = [b" " + p.encode("utf-8", "surrogatepass") for p in parts]
        same = lambda ids, of, w: b"".join(map(of.__getitem__, ids)) == w
        return [(x, y) if same(x, self.a_bytes, w) and same(y, self.b_bytes, w) else ([], []) for x, y, w in zip(a, b, want)]

    def ends(self, ids: list[int], of: list[bytes]) -> list[int]:
        at, out = 0, []
        for i in ids:
            at += len(of[i])
            out.append(at)
        return out


def groups_of(a: list[int], a_end: list[int], b: list[int], b_end: list[int], size_b: int) -> tuple[list[str], list[int]]:
    """Groups as text and the pair of each link, for tokens that begin and end together."""
    groups, pairs, i, j, i0, j0 = [], [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        pairs.append(a[i] * size_b + b[j])
        x, y = a_end[i], b_end[j]
        if x <= y:
            i += 1
        if y <= x:
            j += 1
        if x == y:
            groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
            i0, j0 = i, j
    return groups, pairs


def align_many(pair: Pair, encoded: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Stretches at once: (n_a, n_b, n_groups, given back) of each, its groups as text (each with a closing sign), the pairs
    of all links, and how many each stretch has. Stretches that are not given back have no tokens."""
    n = len(encoded)
    counts = np.array([(len(a), len(b)) for a, b in encoded], np.int64).reshape(n, 2)
    a, b = (np.fromiter((i for e in encoded for i in e[k]), np.int64, counts[:, k].sum()) for k in (0, 1))
    # ends in the bytes of all stretches one after the other
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    ends = np.union1d(a_end, b_end)
    # each stretch of bytes between neighbouring ends is the overlap of one token of A and one of B
    of_a, of_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    owner = np.repeat(np.arange(n), counts[:, 0])
    links = np.bincount(owner[of_a], minlength=n)
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[np.searchsorted(a_end, common)] = True
    last_b[np.searchsorted(b_end, common)] = True
    groups = np.bincount(owner[last_a], minlength=n)
    # tokens in the order in which they are written: by group, those of A before those of B
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    written = np.empty(len(a) + len(b), object)
    written[place_a] = pair.a_text[a + last_a * len(pair.a_bytes)]
    written[place_b] = pair.b_text[b + last_b * pair.size_b]
    written, upto = written.tolist(), np.concatenate([[0], np.cumsum(counts.sum(1))]).tolist()
    texts = ["".join(written[lo:hi]) for lo, hi in zip(upto, upto[1:])]
    return np.stack([counts[:, 0], counts[:, 1], groups, groups > 0], 1), texts, (a[of_a] * pair.size_b + b[of_b]).astype(np.int32), links


class Memory:
    """Stretches by number: token counts, groups as text, pairs in one flat array. Of a full memory what was used twice stays."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.uses = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def tidy(self) -> None:
        if len(self.number) <= MEMORY:
            return
        kept = np.flatnonzero(self.uses > 1)
        kept = kept[np.argsort(-self.uses[kept], kind="stable")[: MEMORY // 2]]
        pairs, counts = self.pairs_of(kept)
        place = dict(zip(kept.tolist(), range(len(kept))))
        self.number = {p: place[k] for p, k in self.number.items() if k in place}
        self.text = [self.text[k] for k in kept.tolist()]
        self.sizes, self.uses, self.pairs = self.sizes[kept], self.uses[kept] // 2, pairs
        self.offsets = np.concatenate([[0], np.cumsum(counts)])

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of the stretches; sizes have n_a, n_b, n_groups and 1 for those that are given back."""
        found = list(map(self.number.get, parts))
        new = list(dict.fromkeys(p for p, n in zip(parts, found) if n is None))
        if new:
            sizes, texts, flat, counts = align_many(self.pair, self.pair.encode(new))
            self.number.update(zip(new, range(len(self.text), len(self.text) + len(new))))
            self.text += texts
            self.sizes = np.concatenate([self.sizes, sizes])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.pairs = np.concatenate([self.pairs, flat])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
            found = list(map(self.number.get, parts))
        numbers = np.array(found, np.int64)
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        return numbers

    def pairs_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of all these stretches one after the other, and how many each has."""
        counts = self.offsets[numbers + 1] - self.offsets[numbers]
        shift = np.repeat(self.offsets[numbers] - (np.cumsum(counts) - counts), counts)
        return self.pairs[np.arange(counts.sum()) + shift], counts


def _memory(a_path: str, b_path: str) -> Memory:
    return base.remembered(f"align {a_path} {b_path}", lambda: Memory(Pair(a_path, b_path)))


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _distinct(owner: np.ndarray, pairs: np.ndarray, n: int) -> tuple[pa.ListArray, pa.ListArray]:
    """The distinct pairs of each of n owners, and how often each occurs."""
    both, times = np.unique(owner << 32 | pairs.astype(np.int64), return_counts=True)
    counts = np.bincount(both >> 32, minlength=n)
    return _lists(counts, both & 0xFFFFFFFF), _lists(counts, times)


def _aligner(a_path: str, b_path: str):
    """Whole texts."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(a_path, b_path)
        for batch in batches:
            for ids, values in base.pieces(iter([batch])):
                memory.tidy()
                texts = [_CUT.split(v.decode("utf-8", "surrogatepass")) if v else [] for v in values]
                n = len(texts)
                sizes = np.array([len(t) for t in texts])
                numbers = memory.numbers([p for t in texts for p in t])
                owner = np.repeat(np.arange(n), sizes)
                bad = np.bincount(owner[memory.sizes[numbers, 3] == 0], minlength=n) > 0
                kept = ~bad[owner]
                owner, numbers = owner[kept], numbers[kept]
                sums = [np.bincount(owner, memory.sizes[numbers, k], n).astype(np.int64) for k in range(3)]
                pairs, counts = memory.pairs_of(numbers)
                at, shas = 0, []
                plain = numbers.tolist()
                for size, wrong in zip(sizes.tolist(), bad.tolist()):
                    size = 0 if wrong else size
                    shas.append(hashlib.sha256("".join(map(memory.text.__getitem__, plain[at : at + size]))[:-1].encode()).hexdigest() if size else "")
                    at += size
                links = np.bincount(owner, counts, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *map(pa.array, sums), pa.array(links), pa.array(shas, pa.string()), *_distinct(np.repeat(owner, counts), pairs, n)],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return align


# -- long texts in chunks


def chunk_ranges(text: str, size: int) -> list[tuple[int, int, int, str]]:
    """(first byte, last byte + 1, byte where the context begins, context without its first space) of the space and the text.

    Ranges end at multiples of ``size`` bytes; a range without a stretch border goes on to the next multiple.
    """
    parts = _CUT.split(text)
    border = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts], out=border[1:])
    end, out, lo = int(border[-1]), [], 0
    for hi in [*range(size, end, size), end]:
        first, last = int(np.searchsorted(border, lo, "right")) - 1, int(np.searchsorted(border, hi, "left"))
        if hi < end and not lo < border[last - 1] < hi:
            continue
        out.append((lo, hi, int(border[first]), " ".join(parts[first:last])))
        lo = hi
    return out


def _chunker(size: int):
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k, (lo, hi, at, context) in enumerate(chunk_ranges(value, size)):
                    columns = [[row], [doc_id], [k], [lo], [hi], [at], [context]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns], ["row", "doc_id", "chunk", "lo", "hi", "at", "text"]
                    )

    return chunk


def _ends(a, a_end, b, b_end) -> dict:
    return {"a": list(a), "a_end": list(a_end), "b": list(b), "b_end": list(b_end)}


def _join(x: dict, y: dict) -> dict:
    return {k: [*x[k], *y[k]] for k in ("a", "a_end", "b", "b_end")}


_NONE = _ends([], [], [], [])


def _fragment(pair: Pair, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, lo: int, chunk: int) -> dict:
    """The fragment of the tokens that end behind ``lo`` (which all these do)."""
    common = np.intersect1d(a_end, b_end)
    if lo == 0:  # both begin with the text
        common = np.concatenate([[0], common])
    if not len(common):
        return {"closes": None, "pre": _ends(a.tolist(), a_end.tolist(), b.tolist(), b_end.tolist()), "suf": _NONE, "groups": [], "links": []}
    cut = [np.searchsorted(e, [common[0], common[-1]], "right") for e in (a_end, b_end)]
    (a0, a1), (b0, b1) = cut
    groups, links = groups_of(a[a0:a1].tolist(), a_end[a0:a1].tolist(), b[b0:b1].tolist(), b_end[b0:b1].tolist(), pair.size_b)
    return {
        "closes": chunk,
        "pre": _ends(*(x.tolist() for x in (a[:a0], a_end[:a0], b[:b0], b_end[:b0]))),
        "suf": _ends(*(x.tolist() for x in (a[a1:], a_end[a1:], b[b1:], b_end[b1:]))),
        "groups": groups,
        "links": links,
    }


def _fragments(a_path: str, b_path: str, schema: pa.Schema):
    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _memory(a_path, b_path).pair
        for batch in batches:
            for row in batch.to_pylist():
                parts = _CUT.split(row["text"])
                encoded = pair.encode(parts)
                ok = all(a for a, _ in encoded)
                a, b = (np.array([i for e in encoded for i in e[k]] if ok else [], np.int64) for k in (0, 1))
                a_end = row["at"] + np.cumsum([len(pair.a_bytes[i]) for i in a], dtype=np.int64)
                b_end = row["at"] + np.cumsum([len(pair.b_bytes[i]) for i in b], dtype=np.int64)
                mine = [(e > row["lo"]) & (e <= row["hi"]) for e in (a_end, b_end)]
                a, a_end, b, b_end = a[mine[0]], a_end[mine[0]], b[mine[1]], b_end[mine[1]]
                found = _fragment(pair, a, a_end, b, b_end, row["lo"], row["chunk"])
                pairs, times = np.unique(np.array(found["links"], np.int32), return_counts=True)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "row": row["row"], "chunk": row["chunk"], "ok": ok, "n_a": len(a), "n_b": len(b),
                            "n_groups": len(found["groups"]), "n_links": len(found["links"]), "groups": ";".join(found["groups"]),
                            "pairs": pairs.tolist(), "times": times.tolist(), "closes": found["closes"], "pre": found["pre"], "suf": found["suf"],
                        }
                    ],
                    schema,
                )

    return fragments


def compose(left: dict, right: dict) -> tuple[dict, tuple[int, dict] | None]:
    """Two neighbouring fragments as one (open ends only), and the group that closes between them with the chunk it closes in."""
    if right["closes"] is None:
        side = "pre" if left["closes"] is None else "suf"
        return left | {side: _join(left[side], right["pre"])}, None
    if left["closes"] is None:
        return right | {"pre": _join(left["pre"], right["pre"])}, None
    return left | {"suf": right["suf"]}, (right["closes"], _join(left["suf"], right["pre"]))


def _composer(size_b: int, schema: pa.Schema):
    """Fragments of one text in order to one fragment and the groups closed on the way (with ``groups`` and ``pairs``)."""

    def composed(key, table):
        rows = table.sort_by("chunk").to_pylist()
        node, out = rows[0], []
        for right in rows[1:]:
            node, closed = compose(node, right)
            if closed:
                at, tokens = closed
                groups, pairs = groups_of(*(tokens[k] for k in ("a", "a_end", "b", "b_end")), size_b)
                if groups:
                    out.append({"row": node["row"], "chunk": at, "groups": ";".join(groups), "pairs": pairs, "closes": None, "pre": _NONE, "suf": _NONE})
        out.append({"row": node["row"], "chunk": key[1].as_py(), "groups": None, "pairs": [], "closes": node["closes"], "pre": node["pre"], "suf": node["suf"]})
        return pa.Table.from_pylist(out, schema)

    return composed


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per text over its groups, which come in order and may go on in the next batch."""
    row, sha, begun = None, None, False
    for batch in batches:
        for r, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if r != row:
                if sha:
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([sha.hexdigest()])], ["row", "groups_sha256"])
                row, sha, begun = r, hashlib.sha256(), False
            if groups:
                sha.update((";" if begun else "").encode() + groups.encode())
                begun = True
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([sha.hexdigest()])], ["row", "groups_sha256"])


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _long(docs: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """The aligned rows of long texts, chunk by chunk."""
    spark = docs.sparkSession
    chunks = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(
        _chunker(chunk), "row long, doc_id long, chunk long, lo long, hi long, at long, text string"
    )
    chunks = base.stored(chunks, "chunks")
    leaves = chunks.repartition("row", "chunk").mapInArrow(_fragments(a_path, b_path, _arrow(spark, _FRAGMENT)), _FRAGMENT)
    leaves = base.stored(leaves, "fragments")
    top = leaves.agg(F.max("chunk")).first()[0] or 0
    size_b = Pair(a_path, b_path).size_b
    nodes, closed = leaves.select("row", "chunk", "closes", "pre", "suf"), []
    while top > 0:
        level = nodes.withColumn("parent", F.expr(f"chunk div {FAN}")).groupBy("row", "parent").applyInArrow(_composer(size_b, _arrow(spark, _NODE)), _NODE)
        level = base.stored(level, "level")
        closed.append(level.filter("groups is not null").select("row", "chunk", "groups", "pairs"))
        nodes, top = level.filter("groups is null").select("row", "chunk", "closes", "pre", "suf"), top // FAN
    between = reduce(DataFrame.unionByName, closed) if closed else None
    own = leaves.select("row", "chunk", F.lit(1).alias("part"), "groups", F.arrays_zip("pairs", "times").alias("p"))
    sums = leaves.groupBy("row").agg(F.min("ok").alias("ok"), *(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")))
    if between is not None:
        ones = F.transform("pairs", lambda p: F.struct(p.alias("pairs"), F.lit(1).alias("times")))
        own = own.unionByName(between.select("row", "chunk", F.lit(0).alias("part"), "groups", ones.alias("p")))
        more = between.groupBy("row").agg(F.count(F.lit(1)).alias("g"), F.sum(F.size("pairs")).alias("l"))
        sums = sums.join(more, "row", "left").withColumns({"n_groups": F.col("n_groups") + F.coalesce("g", F.lit(0)), "n_links": F.col("n_links") + F.coalesce("l", F.lit(0))})
    shas = own.select("row", "groups", "chunk", "part").repartition("row").sortWithinPartitions("row", "chunk", "part").select("row", "groups")
    shas = shas.mapInArrow(_digests, "row long, groups_sha256 string")
    pairs = own.select("row", F.explode("p").alias("p")).groupBy("row", F.col("p.pairs").alias("pair")).agg(F.sum("p.times").cast("int").alias("times"))
    lists = pairs.groupBy("row").agg(F.collect_list(F.struct("pair", "times")).alias("p"))
    ids = chunks.filter("chunk = 0").select("row", "doc_id")
    rows = ids.join(sums, "row").join(shas, "row", "left").join(lists, "row", "left")
    zero = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(0).alias(c)
    none = F.array().cast("array<int>")
    return rows.select(
        "doc_id",
        *(zero(c) for c in ("n_a", "n_b", "n_groups", "n_links")),
        F.when(F.col("ok"), F.col("groups_sha256")).otherwise("").alias("groups_sha256"),
        *(F.when(F.col("ok") & F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(none).alias(to) for c, to in (("pair", "pairs"), ("times", "times"))),
    )


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Every document's tokens, groups and links, with its distinct pairs (A id times B's size plus B id) and how often each is linked."""
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path(MODEL_A), b_path or public_tokenizers.path(MODEL_B)
    rows = base.texts(docs).select(F.col("doc_id").cast("long"), "text")
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    short = rows.filter(~is_long).mapInArrow(_aligner(a_path, b_path), _ALIGNED)
    found = short.unionByName(_long(rows.filter(is_long), a_path, b_path, chunk))
    return base.stored(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair, n = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    for batch in batches:
        new = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        new, counts = np.unique(new, return_counts=True)
        pair, inverse = np.unique(np.concatenate([pair, new]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n, counts]), len(pair)).astype(np.int64)
        if len(pair) > 1 << 20:
            yield rows()
            pair, n = pair[:0], n[:0]
    yield rows()


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """Per pair the number of documents that hold it, and whether that is the highest of its A id (at most size_b pairs each)."""
    counts = found.select("pairs").mapInArrow(_sum_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.expr(f"pair div {size_b}")))
    return counts.select("pair", "n", (F.col("n") == highest).alias("best"))


def _scorer(shared):
    """Sums over frequent pairs, and the other pairs as rows; a text's own row has a negative pair that nothing joins."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            row = batch.column(0).to_numpy()
            pairs, times = batch.column(1), batch.column(2)
            lengths = np.diff(pairs.offsets.to_numpy())
            owner = np.repeat(np.arange(len(row)), lengths)
            p, t = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
            known = pair[at] == p if len(pair) else np.zeros(len(p), bool)
            k, rare = at[known], ~known
            n_best = np.zeros(len(row), np.int64)
            total = np.zeros(len(row), np.int64)
            np.add.at(n_best, owner[known], t[known] * best[k])
            np.add.at(total, owner[known], t[known] * n[k])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([row, row[owner[rare]]])),
                    pa.array(np.concatenate([-1 - row % (1 << 30), p[rare]]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(row), np.int64), t[rare]])),
                    pa.array(np.concatenate([n_best, np.zeros(rare.sum(), np.int64)])),
                    pa.array(np.concatenate([total, np.zeros(rare.sum(), np.int64)])),
                ],
                ["row", "pair", "times", "n_best", "count_sum"],
            )

    return score


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """Per row: tokens, groups, links, links whose pair is the most widespread of its A id, and the sum of the pairs' counts."""
    import sentencepiece

    if b_path is None:
        import public_tokenizers

        b_path = public_tokenizers.path(MODEL_B)
    size_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    found = aligned(docs, a_path, b_path, chunk)
    counts = base.stored(pair_counts(found, size_b), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # fewer than ``share`` rows, as each has more than a share-th part of the total
    frequent = counts.filter(F.col("n") * share > total).orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        (frequent["pair"].to_numpy(), frequent["n"].to_numpy(), frequent["best"].to_numpy().astype(np.int64))
    )
    rows = found.select("row", "pairs", "times").mapInArrow(_scorer(shared), "row long, pair int, times long, n_best long, count_sum long")
    joined = rows.join(counts, "pair", "left").groupBy("row").agg(
        F.sum(F.col("n_best") + F.coalesce(F.when(F.col("best"), F.col("times")), F.lit(0))).alias("n_best"),
        F.sum(F.col("count_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"),
    )
    return found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(joined, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
