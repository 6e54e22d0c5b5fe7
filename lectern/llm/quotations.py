"""Linking quotations in conversations and putting messages in reply order, without the quotes.

A line's quote level is the number of ``>`` before its text. A passage is a run of lines of one level; lines are normalised
(markers off, blanks collapsed, lower case) and hashed, and a passage's hash is that of its lines' hashes. A quoted passage
is joined to the message that first wrote the same passage: in the same conversation if that was earlier, else in any other. Where no
message wrote the whole passage, its lines are joined one by one. A message replies to the message that most lines of its
shallowest linked level come from. A message that replies to one of its own conversation opens a thread there; those after it,
up to the next such reply, continue it. ``position`` numbers a conversation's messages in reply order: by (thread_parent,
thread_start, turn), the opening stretch first.

Own passages and lines are grouped to one row for each conversation before the joins, so a line that a third of all messages share
is few rows; running values over a conversation take two steps (blocks of turns, then turns), and positions are counted in sorted
ranges, so a very long conversation isn't one task's.

Cases: null text has no lines and an empty clean text; a null conv_id or turn links with nothing by its own conversation;
repeated rows are one message; blank lines are never linked and don't part a passage; ties go to the same conversation, then to the
latest turn, then the smallest conversation; very long messages are read whole; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parallelism

BLOCK_TURNS = 256
#: Ends of lines that announce a quotation.
ANNOUNCES = r"(?i)(wrote|writes|schrieb|écrit|escribió) ?: *\r?$"
_MARKERS = "^[ \\t>]*"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKERS, 0), "[^>]", ""))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _MARKERS, ""), "[ \\t\\r]+", " ")))


def _running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """The greatest value so far in a conversation, by turn."""
    rows = rows.withColumn("_block", F.expr(f"(turn - pmod(turn, {BLOCK_TURNS})) div {BLOCK_TURNS}"))
    step = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "_block").agg(F.max(value).alias("_m")).withColumn("_before", F.max("_m").over(step))
    inner = Window.partitionBy("conv_id", "_block").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_in", F.max(value).over(inner)).alias("r")
    on = F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("r._block").eqNullSafe(F.col("b._block"))
    return rows.join(blocks.alias("b"), on).select("r.*", F.greatest("_in", "_before").alias(out)).drop("_block", "_in")


def _positions(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with their place in their conversation, by thread and turn; ranges of the sorted rows are counted apart."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("thread.parent").asc_nulls_first(), F.col("thread.turn").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = scratch.save(rows.repartitionByRange(parallelism(rows.sparkSession), *keys).withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range of a conversation
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*keys[1:]))
    d, c = dealt.withColumn("place", place).alias("d"), counts.alias("c")
    return d.join(c, F.col("d.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("d.part") == F.col("c.part"))).select("d.*", (F.col("c.before") + F.col("d.place")).alias("position")).drop("part", "place")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, n_quoted, max_level, n_passages, n_lines, reply_conv, reply_turn, thread_start, thread_parent, position, clean_text) for every message.

    ``n_passages`` counts the quoted passages that are linked whole, ``n_lines`` the lines that are linked singly.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = messages.select("conv_id", "turn", "role", "text").distinct().withColumn("key", F.md5(F.concat_ws("\x01", "role", "text").cast("binary")))
    rows = scratch.save(rows, "messages")
    lines = rows.select("conv_id", "turn", "key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("conv_id", "turn", "key", "at", _level(F.col("line")).alias("level"), _normal(F.col("line")).alias("norm")).filter("norm <> ''")
    message = Window.partitionBy("conv_id", "turn", "key").orderBy("at")
    lines = lines.withColumn("hash", F.md5(F.col("norm").cast("binary"))).drop("norm")
    lines = lines.withColumn("opens", (F.col("level") != F.lag("level", 1, -1).over(message)).cast("int")).withColumn("run", F.sum("opens").over(message)).drop("opens")
    lines = scratch.save(lines, "lines")
    # A message's passages: the lists are bounded by the message.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])
    passages = lines.groupBy("conv_id", "turn", "key", "run", "level").agg(F.md5(F.concat_ws("\n", listed).cast("binary")).alias("hash"), F.count(F.lit(1)).alias("c"))
    units = passages.withColumn("whole", F.lit(True)).unionByName(lines.select("conv_id", "turn", "key", "run", "level", "hash", F.lit(1).cast("bigint").alias("c"), F.lit(False).alias("whole")))
    units = scratch.save(units, "units")
    own = units.filter("level = 0 and turn is not null").groupBy("whole", "conv_id", "hash").agg(F.min("turn").alias("own_turn"))
    # The two smallest conversations of each passage or line, so that one of them isn't the quoting one; cut inside each task before the shuffle.
    first = own.filter("conv_id is not null").withColumn("_r", F.row_number().over(Window.partitionBy("whole", "hash").orderBy("conv_id"))).filter("_r <= 2")
    first = first.groupBy(F.col("whole").alias("w"), F.col("hash").alias("h")).agg(*(f(F.struct("conv_id", "own_turn")).alias(a) for f, a in ((F.min, "first"), (F.max, "second"))))
    quoted = units.filter("level > 0").groupBy("conv_id", "turn", "key", "run", "level", "whole", "hash").agg(F.sum("c").alias("c"))
    found = quoted.join(own, ["whole", "conv_id", "hash"], "left").join(first, (F.col("whole") == F.col("w")) & (F.col("hash") == F.col("h")), "left")
    found = found.withColumn("first", F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first")))
    here, there = F.col("own_turn") < F.col("turn"), F.col("first.conv_id").isNotNull() & ~F.col("first.conv_id").eqNullSafe(F.col("conv_id"))
    source = F.when(here, F.struct(F.col("conv_id").alias("conv"), F.col("own_turn").alias("turn"))).when(there, F.struct(F.col("first.conv_id").alias("conv"), F.col("first.own_turn").alias("turn")))
    found = found.withColumn("source", source).filter("source is not null")
    # Lines count only where their passage isn't linked whole.
    passage = Window.partitionBy("conv_id", "turn", "key", "run")
    found = scratch.save(found.withColumn("linked", F.max("whole").over(passage)).filter("whole or not linked").select("conv_id", "turn", "key", "run", "level", "whole", "source", "c"), "found")
    votes = found.groupBy("conv_id", "turn", "key", "level", "source").agg(F.sum("c").alias("c"))
    rank = F.struct(-F.col("level"), F.col("c"), F.coalesce(F.col("source.conv") == F.col("conv_id"), F.lit(False)), F.col("source.turn"), -F.col("source.conv"))
    reply = votes.groupBy("conv_id", "turn", "key").agg(F.max_by("source", rank).alias("source"))
    linked = found.groupBy("conv_id", "turn", "key").agg(F.count(F.when(F.col("whole"), 1)).alias("n_passages"), F.sum(F.when(~F.col("whole"), F.col("c"))).alias("n_lines"))
    counts = lines.groupBy("conv_id", "turn", "key").agg(F.count(F.when(F.col("level") > 0, 1)).alias("n_quoted"), F.max("level").alias("max_level"))
    for extra in (reply, linked, counts):
        on = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("conv_id", "turn", "key")]
        rows = rows.alias("r").join(extra.alias("e"), on, "left").select("r.*", *(f"e.{c}" for c in extra.columns[3:]))
    inside = F.col("source.conv").eqNullSafe(F.col("conv_id")) & F.col("source.turn").isNotNull()
    rows = rows.withColumn("opens", F.when(inside, F.struct(F.col("turn"), F.col("source.turn").alias("parent"))))
    rows = _positions(_running(rows, "opens", "thread"), scratch)
    scratch.keep("ranges")
    array = F.split("text", "\n")
    clean = F.filter(array, lambda x, i: (_level(x) == 0) & ~(x.rlike(ANNOUNCES) & (F.coalesce(_level(F.get(array, i + 1)), F.lit(0)) > 0)))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        "conv_id", "turn", "role", number("n_quoted"), F.coalesce("max_level", F.lit(0)).cast("int").alias("max_level"), number("n_passages"), number("n_lines"),
        F.col("source.conv").alias("reply_conv"), F.col("source.turn").alias("reply_turn"), F.col("thread.turn").alias("thread_start"), F.col("thread.parent").alias("thread_parent"), "position",
        F.coalesce(F.array_join(clean, "\n"), F.lit("")).alias("clean_text"),
    )


def with_quotes(messages: DataFrame) -> DataFrame:
    """Messages made replies: each quotes one before it in its conversation (the last, or every third time the last but one), whole, or every fourth time but for its first line.

    So a plain log of conversations becomes one with nested quotations, whose sources are known.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    back = F.when(F.col("turn") % 3 == 0, F.lag("text", 2).over(order)).otherwise(F.lag("text", 1).over(order))
    source = F.when(F.col("turn") % 4 == 0, F.regexp_replace(back, r"^[^\n]*\n", "")).otherwise(back)
    older = F.when(F.col("turn") % 2 == 0, F.lag("text", 3).over(order))
    marked = lambda x, marks: F.concat(F.lit(marks), F.regexp_replace(x, "\n", "\n" + marks))
    text = F.concat_ws("\n", marked(older, ">> "), marked(source, "> "), "text")
    return messages.select("conv_id", "turn", "role", text.alias("text"))
