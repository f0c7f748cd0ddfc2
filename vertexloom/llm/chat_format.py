"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn is exploded into one training example: all preceding turns are its context and
only that reply is trainable, as a span of the example's text. Turns after the last reply form a
closing example without a target, so that nothing of a conversation is lost. All examples of a
conversation are prefixes of one transcript: `transcripts` stores that with the spans, at the cost of
the turns, and `examples` explodes it into the examples' own texts.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. `&` becomes `&amp;` and `<|`
becomes `&lt;|` inside roles and texts, and a role's line breaks become `&#10;`, so no text can
hold a control string and the way back is exact.

Cases: a null role or text counts as empty; turns are ordered by (turn, role, text), so ties and
repeated rows stay, in a fixed order; turns after the last reply form a closing example without a
target; a conversation without a reply has only that one; an empty table gives no rows; further
columns of the input are ignored. A null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, REPLY = "<|im_start|>", "<|im_end|>", "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def render(role: Column, text: Column) -> Column:
    head = F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))
    return F.concat(F.lit(OPEN), head, F.lit("\n"), escape(text), F.lit(CLOSE + "\n"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, transcript, examples: array of (target, loss_start, loss_end, end), as code points.

    `end` is the length of the transcript's prefix that is the example's text, `target` the place
    of its reply among the turns (null for the closing example), and [loss_start, loss_end) the
    trainable span. One shuffle, by conversation, serves the running lengths and the grouping.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("out", render(F.col("role"), F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ended = turns.select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        (F.col("role") == REPLY).alias("reply"),
        F.sum(F.char_length("out").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.char_length(escape(F.col("text"))).cast("long").alias("body"),
        "out",
    )
    grouped = ended.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "reply", "end", "body", "out"))).alias("t"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x.out), "").alias("transcript"),
        F.transform(F.filter("t", lambda x: x.reply | (x.at == F.size("t"))), _span).alias("examples"),
    )


def _span(x: Column) -> Column:
    stop = x.end - len(CLOSE + "\n")
    return F.struct(
        F.when(x.reply, x.at).alias("target"),
        F.when(x.reply, stop - x.body).alias("loss_start"),
        F.when(x.reply, stop).alias("loss_end"),
        x.end.alias("end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row an example: conv_id, example (from 0), last, text, loss_start, loss_end; code points, the span is null without a target.

    Exploding keeps the rows where the conversations are; what follows by conv_id needs no further shuffle.
    """
    each = formatted.select("conv_id", "transcript", F.size("examples").alias("n"), F.posexplode("examples").alias("example", "x"))
    return each.select(
        "conv_id",
        "example",
        (F.col("example") == F.col("n") - 1).alias("last"),
        F.col("transcript").substr(F.lit(1), F.col("x.end").cast("int")).alias("text"),
        "x.loss_start",
        "x.loss_end",
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text), parsed from an example's text alone."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda b: b != "")
    bare = F.transform(blocks, lambda b: F.substr(b, F.lit(len(OPEN) + 1)))
    return F.transform(
        bare,
        lambda b: F.struct(
            unescape(F.replace(F.substr(b, F.lit(1), F.call_function("instr", b, F.lit("\n")) - 1), F.lit("&#10;"), F.lit("\n"))).alias("role"),
            unescape(F.substr(b, F.call_function("instr", b, F.lit("\n")) + 1)).alias("text"),
        ),
    )


def trainable(text: Column, start: Column, end: Column) -> Column:
    """What stands under the loss mask, unescaped; null without a target."""
    return unescape(text.substr((start + 1).cast("int"), (end - start).cast("int")))


def digests(formatted: DataFrame) -> DataFrame:
    """The figures of the query for each conversation, read back from its examples: turns from the last one's text, the loss from the masks."""
    each = examples(formatted).select(
        "conv_id",
        F.struct("example", trainable(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss")).alias("masked"),
        F.char_length("text").cast("long").alias("chars"),
        F.when(F.col("last"), F.col("text")).alias("whole"),
    )
    back = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("masked")).alias("masked"), F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"))
    read = back.select("conv_id", "formatted_chars", read_turns(F.col("whole")).alias("turns"), F.array_join(F.col("masked.loss"), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
