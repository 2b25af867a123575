"""Chat formatting from an event log, in DataFrame functions only.

Events (conv_id, seq, turn, kind, role, text) are partitioned by conversation and folded in the order of seq:
`message` sets a turn's text, `delta` adds to it, `edit` replaces it, and `regenerate` empties it and voids all later
turns written so far. A turn's role is the last one given. The final messages are rendered by a template that marks
turns; control strings inside texts get one more backslash after their first character, so that no text can end a turn
and every text can be read back. The loss mask lists the assistant texts as spans of code points.

All windows and the last aggregate share one partitioning by conversation, so the log moves once. A conversation is
one value of the result: its length, as of any string, is what a task must hold.

Nulls, empty and repeated rows: null texts are empty texts, null roles empty roles, null kinds `message`; events
without a turn belong to the null turn, which sorts first; events without a seq come before all others, so that a regeneration with
one voids them and one without it voids nothing; events without a conversation form the null conversation;
exactly repeated events count once, and other events with equal seq apply in the order kind, role, text; a
conversation whose turns are all void has no row; an empty log gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other templates, with any number of backslashes after the first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role also must not hold a line break; a backslash becomes \\e."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\e")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of every final message."""
    log = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id")
    # rows of one turn are peers, so the frame up to the peers before it holds the earlier turns only
    turns = in_order.orderBy(F.col("turn").asc_nulls_first(), F.col("seq").asc_nulls_first(), "kind", "role", "text")
    same = Window.partitionBy("conv_id", "seq", "turn", "kind", "role", "text").orderBy(F.lit(0))
    log = log.withColumn("__again", F.row_number().over(same)).filter("__again = 1").drop("__again")
    number = F.dense_rank().over(in_order.orderBy(F.col("turn").asc_nulls_first()))
    log = log.withColumn("__turn", number)
    earlier = in_order.orderBy("__turn").rangeBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("__void", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
    log = log.filter(F.col("__void").isNull() | (F.col("seq") > F.col("__void")))
    order = F.struct("seq", "kind", "role", "text")
    at_turn = Window.partitionBy("conv_id", "__turn")
    log = log.withColumn("__reset", F.max(F.when(F.col("kind") != "delta", order)).over(at_turn))
    live = F.when((F.col("kind") != "regenerate") & (F.col("__reset").isNull() | (order >= F.col("__reset"))), F.struct(order.alias("order"), F.col("text").alias("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(live)), lambda x: x["text"]), "")
    return log.groupBy("conv_id", "__turn").agg(F.first("turn").alias("turn"), F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), order)), F.lit("")).alias("role"), text.alias("text")).drop("__turn")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask (start, from 0, and length in code points) of every conversation."""
    line = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.withColumn("__head", line).withColumn("__body", escape(F.col("text")))
    parts = parts.withColumn("__line", F.concat("__head", "__body", F.lit(CLOSE)))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    upto = Window.partitionBy("conv_id").orderBy(*order)
    parts = parts.withColumn("__n", F.row_number().over(upto)).withColumn("__end", F.sum(F.length("__line").cast("long")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("__end") - F.length("__line") + F.length("__head")
    turns = F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__line").alias("line"), start.alias("start"), F.length("__body").cast("long").alias("length"), (F.col("role") == LEARNED).alias("learned"))))
    return parts.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_mask"),
    )


def read_back(formatted: str = "formatted") -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(CLOSE))).alias("text"),
        ),
    )


def learned_text(formatted: str = "formatted", mask: str = "loss_mask") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """What each formatted conversation says when it is read back; rows are messages in the order of turn."""
    row = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    events = conversations.select("conv_id", F.row_number().over(row).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text").withColumn("turn", F.col("seq"))
    out = render(fold(events)).withColumn("turns", read_back()).withColumn("learned", learned_text())
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
