"""Chat formatting by prefix-target expansion, in native expressions.

Every assistant turn becomes an example of its own: all preceding turns are the context
and only that reply is trainable.  Turns behind the last reply (or a conversation
without one) go into a last example that trains nothing, so no turn is lost.

Template, one piece per turn:  ``<|turn|>role<|text|>text<|end|>``.  Control strings
inside roles and texts are escaped: a backslash is doubled, and one is put behind
the first character of each control string, so no reader or tokenizer can take
them for marks; removing each escaping backslash restores the text.

Defined results: NULL role and text count as empty; turns that share a number are
ordered by role and text, repeated rows stay; a NULL conv_id is one conversation; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Beginnings of the control strings of this and other common templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand_prefix_targets(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                          text: str = "text", reply: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example, text, target_start, target_end (code points; NULL: nothing trains)."""
    rows = turns.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said"))
    rows = rows.select("conv_id", "turn", "role", "said", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
                       escape(F.col("said")).alias("body"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "said")
    piece = F.concat("head", "body", F.lit(END))
    rows = rows.select("conv_id", "role", piece.alias("piece"), F.length("body").alias("body_length"),
                       F.row_number().over(order).alias("at"),
                       F.sum(F.length(piece)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("end"))
    # The grouping keeps the window's partitioning: one shuffle for both.
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "piece", "body_length", "end"))).alias("turns"))
    last = F.element_at("turns", -1)
    grouped = grouped.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("whole"),
        F.filter(F.transform("turns", lambda t: F.struct(t["at"].alias("at"), t["role"].alias("role"), t["body_length"].alias("body_length"), t["end"].alias("end"))),
                 lambda t: (t["role"] == reply) | (t["at"] == last["at"])).alias("stops"))
    examples = grouped.select("conv_id", "whole", F.posexplode("stops").alias("example", "stop"))
    trains = F.col("stop.role") == reply
    target_end = F.col("stop.end") - len(END)
    return examples.select(
        "conv_id", "example", F.substring(F.col("whole"), F.lit(1), F.col("stop.end").cast("int")).alias("text"),
        F.when(trains, target_end - F.col("stop.body_length")).alias("target_start"), F.when(trains, target_end).alias("target_end"))


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.filter(F.split(text, r"<\|turn\|>", -1), lambda p: p != "")
    def parse(p: Column) -> Column:
        return F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"),
                        unescape(F.substring_index(F.substring_index(p, END, 1), TEXT, -1)).alias("text"))
    return F.transform(pieces, parse)


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the examples hold of each conversation, read back from their texts and masks."""
    masked = unescape(F.substring(F.col("text"), (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int")))
    parts = examples.select("conv_id", "example", "text", F.length("text").cast("long").alias("size"), F.coalesce(masked, F.lit("")).alias("loss"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("size").alias("formatted_chars"),
        F.max_by("text", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"))
    whole = whole.select("conv_id", "formatted_chars", "loss", read_turns(F.col("longest")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
