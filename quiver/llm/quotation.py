"""Quotations in messages linked to the messages they come from, and conversations in the order of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiver.llm.common import materialise, text_of

#: Marks of quotation in front of a line, and the line that announces a quotation.
_MARKS = r"^(?:[ \t]{0,3}>)++[ \t]?"
_ANNOUNCES = r"(?i)^[ \t]*on .+ wrote:[ \t\r]*$"


def quoted_lines(text: Column) -> Column:
    """Lines as (level, body): the number of marks in front, and what follows them."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]+", "")).alias("level"), F.substr(line, F.length(marks) + 1, F.length(line)).alias("body"))

    return F.transform(F.split(text, "\n"), one)


def _announces(lines: str, x: Column, i: Column) -> Column:
    """The line announces a quotation that begins within two lines; a line inside a quotation announces one of a higher level."""
    level = lambda j: F.coalesce(F.get(lines, j)["level"], F.lit(0))
    return x["body"].rlike(_ANNOUNCES) & ((level(i + 1) > x["level"]) | (level(i + 2) > x["level"]))


def _plain(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def passages(lines: str) -> Column:
    """Runs of lines of one level that are neither blank nor announce a quotation, as (level, key, lines): the key is the run in lower case with single spaces; lines has the like of each line with a letter or digit."""
    body, level = (lambda i: F.get(lines, i)["body"]), (lambda i: F.coalesce(F.get(lines, i)["level"], F.lit(-1)))
    out = lambda i: F.coalesce((F.trim(F.regexp_replace(body(i), r"\s+", " ")) == "") | _announces(lines, F.get(lines, i), i), F.lit(True))
    index = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(index, lambda i: ~out(i) & ((i == 0) | out(i - 1) | (level(i) != level(i - 1))))
    ends = F.filter(index, lambda i: ~out(i) & (out(i + 1) | (level(i) != level(i + 1))))

    def run(start: Column, end: Column) -> Column:
        bodies = F.transform(F.slice(lines, start + 1, end - start + 1), lambda x: x["body"])
        each = F.transform(F.filter(bodies, lambda x: x.rlike(r"[\p{L}\p{N}]")), lambda x: F.xxhash64(_plain(x)))
        return F.struct(level(start).alias("level"), F.md5(_plain(F.array_join(bodies, " ")).cast("binary")).alias("key"), each.alias("lines"))

    return F.zip_with(starts, ends, run)


def own_text(lines: str) -> Column:
    """The message without quotations and without lines that announce one."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~_announces(lines, x, i))
    return F.trim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), F.lit(" \t\n\x0b\f\r"))


def _origins(units: DataFrame) -> DataFrame:
    """Quoted passages (conv_id, turn, level, key) with the earlier turn they come from, or null."""
    own = units.filter("level = 0")
    whole = own.groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    single = own.select("conv_id", "turn", F.explode("lines").alias("line")).groupBy("conv_id", "line").agg(F.min("turn").alias("line_origin"))
    earlier = lambda c: F.when(F.col(c) < F.col("turn"), F.col(c))
    quotes = units.filter("level > 0").distinct().join(whole, ["conv_id", "key"], "left").withColumn("origin", earlier("origin"))
    # one row a line where the run as a whole is not found, one row in all where it is
    by_line = quotes.withColumn("line", F.explode_outer(F.when(F.col("origin").isNull(), F.col("lines")))).join(single, ["conv_id", "line"], "left").withColumn("line_origin", earlier("line_origin"))
    found = by_line.groupBy("conv_id", "turn", "level", "key", "lines").agg(F.max("origin").alias("origin"), F.count("line").alias("n"), F.count("line_origin").alias("n_found"), F.max("line_origin").alias("line_origin"))
    origin = F.coalesce("origin", F.when((F.col("n") > 0) & (F.col("n") == F.col("n_found")), F.col("line_origin")))
    return found.groupBy("conv_id", "turn", "level", "key").agg(F.max(origin).alias("origin"))


def _roots(parents: DataFrame) -> DataFrame:
    """Root and depth of every message that has a parent, by pointer jumping: rounds grow as the logarithm of the depth."""
    state = materialise(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "up")
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = state.join(above, ["conv_id", "up"], "left")
        state = materialise(joined.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "up")
        if state.filter("moved").isEmpty():
            return state.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Each message with the message it replies to, its place in the conversation in reply order, and its own text.

    A passage is a run of lines of one level. The normalised passages of own text and each of their lines are indexed by
    conversation and hash, the first turn winning; quoted passages look themselves up there. One that is not found as a
    whole comes from the latest of the turns of its lines, if all of its lines with a letter or digit are found. A message replies to the latest of the earlier
    turns that its passages of level 1 come from; without one it begins a thread. A parent is always earlier, so
    threads have no cycles. Threads stand in the order of their first turns, messages of a thread in the order of turns.

    Places are numbered in ranges of (conversation, thread, turn), so that no task holds a conversation.

    Null text: empty. Null conv_id or turn: linked with nothing. Rows that share conversation and turn share a parent.
    Empty table: no rows. Columns besides conv_id, turn, role and text are ignored. Returns conv_id, turn, role,
    parent_turn, root_turn, depth, position, n_quotes, n_linked, text.
    """
    parsed = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", quoted_lines(text_of()).alias("lines"))
    rows = materialise(parsed.select("conv_id", "turn", "role", own_text("lines").alias("text"), passages("lines").alias("passages")), "messages")
    units = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.key", "p.lines")
    linked = _origins(units)
    per_message = materialise(
        linked.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent_turn"), F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked")), "replies"
    )
    roots = _roots(per_message.filter("parent_turn IS NOT NULL"))
    threads = rows.drop("passages").join(per_message, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    placed = threads.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "text",
    )
    # written before it is numbered, as the ranges of a second evaluation could differ
    ranged = materialise(placed.repartitionByRange("conv_id", "root_turn", "turn", F.xxhash64("text")).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = ranged.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("root_turn", "turn", F.xxhash64("text"))) - 1)
    joined = numbered.alias("m").join(offsets.alias("o"), F.col("m.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("m.range") == F.col("o.range")))
    return joined.select("m.conv_id", "turn", "role", "parent_turn", "root_turn", "depth", (F.col("at") + F.col("offset")).alias("position"), "n_quotes", "n_linked", "text")
