"""Multi-party perspective rotation with DataFrame functions only.

Every dialogue is rendered once for each of its participants: that speaker becomes the assistant, every other speaker a
named user, and the mask marks the characters that the speaker says, each turn's end mark included. System turns are
context for everyone and no participant's.

A dialogue is taken in blocks of ``BLOCK_TURNS`` turn numbers, so that no dialogue, however long, has to fit into one row.
``rotate`` renders each block by itself, for the participants who speak in it. ``rotate_whole`` renders every block for every
participant of the dialogue, with masks that count from the dialogue's begin: a participant's blocks in order are the whole
rendering. Both are the same for dialogues of one block. Turns are ordered by number, then role, then text; a row that is
repeated exactly is one turn (in ``rotate_whole``, where it has a number: turns without one are as many as there are). A turn without a role comes from a user named "unknown", who is no participant; without a
text it is empty; without a number it comes first in block 0 (behind blocks of negative numbers). A dialogue without participants
has no rows, nor has an empty table. The marks' opening "<|"
inside a text is written "< |", so a text can't speak for someone else. Only the four named columns are read, whatever
other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
SYSTEM = "system"
UNKNOWN = "unknown"
END = "<|end|>\n"


def _safe(column: str) -> Column:
    return F.replace(F.coalesce(F.col(column), F.lit("")), F.lit("<|"), F.lit("< |"))


def _header(turn: Column, speaker: Column) -> Column:
    return (
        F.when(turn["role"] == speaker, "<|assistant|>\n")
        .when(turn["role"] == SYSTEM, "<|system|>\n")
        .otherwise(F.concat(F.lit("<|user name="), turn["role"], F.lit("|>\n")))
    )


def _add(state: Column, turn: Column, speaker: Column) -> Column:
    """Append one turn: where it ends, and the span of what the speaker says."""
    begin = state["at"] + F.length(_header(turn, speaker))
    end = begin + F.length(turn["text"]) + len(END)
    span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
    return F.struct(end.alias("at"), F.when(turn["role"] == speaker, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))


def _blocks(conversations: DataFrame, block_turns: int, all_unnumbered: bool) -> DataFrame:
    """conv_id, block and its turns in order; repeated rows are one, except, if wanted, those without a number."""
    role = F.coalesce(_safe("role"), F.lit(UNKNOWN))
    turns = conversations.select(
        F.col("conv_id"),
        F.floor(F.coalesce(F.col("turn"), F.lit(0)) / block_turns).cast("long").alias("block"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.when(F.col("role").isNull(), UNKNOWN).otherwise(role).alias("role"), _safe("text").alias("text")).alias("said"),
    )
    found = F.collect_set("said")
    if all_unnumbered:
        has = F.col("said.turn").isNotNull()
        found = F.concat(F.collect_list(F.when(~has, F.col("said"))), F.collect_set(F.when(has, F.col("said"))))
    return turns.groupBy("conv_id", "block").agg(F.array_sort(found).alias("turns"))


def _rendered(rows: DataFrame, at: Column) -> DataFrame:
    """Blocks with a speaker as text and mask; the mask's first character is number ``at``."""
    speaker = F.col("speaker")
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(_header(t, speaker), t["text"], F.lit(END))), "")
    start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("spans"))
    spans = F.aggregate("turns", start, lambda s, t: _add(s, t, speaker), lambda s: s["spans"])
    return rows.select(
        "conv_id",
        "block",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["role"] == speaker)).cast("long").alias("n_spoken"),
        rendered.alias("text"),
        F.array_join(spans, ",").alias("mask"),
    )


def rotate(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per dialogue, block and participant who speaks in it: the text, the mask's spans (start:end in characters) and counts."""
    blocks = _blocks(conversations, block_turns, False)
    roles = F.array_distinct(F.transform("turns", lambda t: t["role"]))
    return _rendered(blocks.withColumn("speaker", F.explode(F.array_sort(F.filter(roles, lambda r: ~r.isin(SYSTEM, UNKNOWN))))), F.lit(0))


def rotate_whole(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per dialogue, block and participant of the dialogue, like ``rotate``; masks count from the dialogue's begin."""
    blocks = _blocks(conversations, block_turns, True)
    # lengths only: each turn as nobody's own, and what a turn of one's own is longer or shorter by
    nobody = F.lit(None).cast("string")
    length = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.length(_header(t, nobody)) + F.length(t["text"]) + len(END))
    said = F.transform("turns", lambda t: t["role"])
    light = blocks.select("conv_id", "block", length.alias("length"), said.alias("said"))
    speakers = light.select("conv_id", F.explode(F.array_distinct("said")).alias("speaker")).filter(~F.col("speaker").isin(SYSTEM, UNKNOWN)).distinct()
    own = F.size(F.filter("said", lambda r: r == F.col("speaker"))) * (len("<|assistant|>") - F.length("speaker") - len("<|user name=|>"))
    order = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    grid = light.alias("l").join(speakers.alias("s"), F.col("l.conv_id").eqNullSafe(F.col("s.conv_id"))).select("l.conv_id", "block", "speaker", (F.col("length") + own).alias("length"))
    at = grid.select("conv_id", "block", "speaker", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("at"))
    rows = blocks.alias("b").join(at.alias("a"), F.col("b.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("b.block") == F.col("a.block")))
    return _rendered(rows.select("b.conv_id", "b.block", "speaker", "turns", "at"), F.col("at").cast("long"))
