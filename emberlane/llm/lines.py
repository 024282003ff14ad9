"""Line dedup with DataFrame functions only: lines that several documents share stay in one of them.

Texts are cut at line breaks and the lines exploded. A line's key is the line without white space at both ends and with A-Z
in lower case; keys of fewer than ``MIN_LENGTH`` code points never count. Keys are grouped by 16 bytes of a SHA-256 digest,
with partial sums inside map tasks; a key that at least ``MIN_DOCS`` distinct documents hold is dropped everywhere but in the
smallest doc_id. Dropped positions are gathered per document, and the text is put together again from the positions that are
left, in order.

A line that a third of all documents hold is no hot key of the join back: keys are dealt to as many salts as they have
2,000ths of all repeated lines. Fewer than 2,000 keys have more than one (their lines would else be more than there are), so
the table of salts that is broadcast is bounded whatever the input, and the salted copies of keys are fewer than 4,000.

Null and empty texts are one empty line. A null doc_id stands for one document behind all others: it keeps a line only if no
other document has it. Rows that repeat a doc_id are one document for the count, each with its own text; an empty table gives
no rows. Only the id and the text are read, whatever other columns there are. Long texts cost one array of lines per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

MIN_LENGTH = 10
MIN_DOCS = 2
#: A key with more than this part of all repeated lines is salted.
SHARE = 2000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_SPACE))
    # lower() of ASCII text changes A-Z only and is the faster one
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a content number that tells rows of one doc_id apart."""
    return base.texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))


def _keyed(docs: DataFrame, min_length: int) -> DataFrame:
    """Lines that count: doc_id, content, position and the digest of the key."""
    lines = _rows(docs).select("doc_id", "content", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "content", "pos", _key(F.col("line")).alias("key")).filter(F.length("key") >= min_length)
    return keys.select("doc_id", "content", "pos", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("digest"))


def repeated(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Keys (as digests) that at least ``min_docs`` documents hold: the one that keeps them, documents and lines."""
    found = _keyed(docs, min_length).groupBy("digest").agg(
        F.min("doc_id").alias("keeper"),
        F.count_distinct("doc_id").alias("n_docs"),
        F.max(F.col("doc_id").isNull().cast("long")).alias("nameless"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    return found.select("digest", "keeper", (F.col("n_docs") + F.col("nameless")).alias("n_docs"), "n_lines").filter(F.col("n_docs") >= min_docs)


def dropped(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, content and the positions of dropped lines, for documents that lose any."""
    keys = base.stored(repeated(docs, min_docs, min_length), "lines")
    total = keys.agg(F.sum("n_lines")).first()[0] or 0
    salts = F.greatest(F.lit(1), F.ceil(F.col("n_lines") * SHARE / F.lit(max(total, 1)))).cast("long")
    hot = keys.filter(F.col("n_lines") * SHARE > total).select("digest", salts.alias("salts"))
    dealt = keys.select("digest", "keeper", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    lines = _keyed(docs, min_length).join(F.broadcast(hot), "digest", "left")
    lines = lines.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "content", "pos"), "salts")))
    gone = lines.join(dealt, ["digest", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "content").agg(F.collect_set("pos").alias("gone"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Every row's doc_id and its text without the lines that another document keeps, with the lines before and the lines dropped."""
    rows, gone = _rows(docs).alias("r"), dropped(docs, min_docs, min_length).alias("g")
    same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.content") == F.col("g.content"))
    cut = rows.join(gone, same, "left").select("r.doc_id", "r.text", F.split("r.text", "\n").alias("lines"), "g.gone")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    return cut.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame) -> DataFrame:
    return drop_lines(docs).select("doc_id", "n_lines", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
