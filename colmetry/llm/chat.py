"""Chat formatting: one training text per conversation, with a loss mask, from Spark expressions alone.

Turns of a conversation are collected as structs, sorted, and runs of one role are merged into one block:

    <|im_start|>role LF text<|im_sep|>text ...<|im_end|>LF

``<|im_sep|>`` keeps the turns of a merged block apart, so that every turn can be read back. Control strings inside roles and texts
are escaped: ``\\`` becomes ``\\\\``, then ``<|`` becomes ``<\\p``; in roles a line feed becomes ``<\\l``. After the doubling a single
backslash only occurs behind a ``<`` that escaping put there, so undoing the steps in reverse order gives the text back.

Defined cases: null text and null role are empty; null conversation ids form one conversation; turns with equal numbers (null first)
go by role, then text; repeated rows are repeated turns; an empty table gives no rows; other columns of the table are ignored.
A conversation is one value of the result, so its text has to fit into a row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmetry.llm.texts import plain

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\l"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\l"), F.lit("\n")))


def format_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Columns conversation id, ``formatted`` (the text) and ``segments`` (array of text, loss: the formatted text in pieces, with
    loss true on the escaped texts of ``loss_role``)."""
    rows = turns.select(
        F.col(conversation).alias("id"),
        F.struct(F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text")).alias("item"),
    )
    sorted_turns = rows.groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("turns"))
    places = F.transform("turns", lambda t, i: F.when(
        (i == 0) | (t.role != F.get("turns", F.greatest(i - 1, F.lit(0))).role), i))
    runs = sorted_turns.withColumn("starts", F.filter(places, lambda p: p.isNotNull()))

    def block(start: Column, k: Column) -> Column:
        following = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        return F.struct(F.get("turns", start).role.alias("role"),
                        F.transform(F.slice("turns", start + 1, following - start), lambda t: t.text).alias("texts"))

    blocks = runs.withColumn("blocks", F.transform("starts", block))

    def pieces(b: Column) -> Column:
        head = F.concat(F.lit(START), escape_role(b.role), F.lit("\n"))
        return F.flatten(F.transform(b.texts, lambda t, i: F.array(
            _segment(F.when(i == 0, head).otherwise(F.lit(SEP)), F.lit(False)),
            _segment(escape(t), b.role == loss_role),
            _segment(F.when(i == F.size(b.texts) - 1, F.lit(END + "\n")).otherwise(F.lit("")), F.lit(False)),
        )))

    parts = blocks.select("id", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return parts.select(
        F.col("id").alias(conversation),
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments",
    )


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Turns (array of role, text) read back from a formatted text."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape_role(F.substring_index(b, "\n", 1))
        body = F.substr(b, F.instr(b, "\n") + 1)
        body = F.substr(body, F.lit(1), F.length(body) - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
