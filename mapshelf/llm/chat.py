"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Each assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. A turn is written as
``<s>role[INST]text</s>``. In roles and texts the backslash, ``<`` and ``[`` are escaped, so no control string can come from them, and the
examples can be read back exactly. What follows a conversation's last assistant turn gives one last example without a trainable part, so the
examples hold every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEPARATE, CLOSE = "<s>", "[INST]", "</s>"
#: Characters that are escaped, and what stands for them. The backslash goes first and comes back last.
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")]
_REST = 2**31 - 1


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv_id, position, formatted, loss_start, loss_length): one row per assistant turn, and one for turns after the last of them.

    ``position`` counts the turns that ``formatted`` holds; its characters from ``loss_start`` (from 1) on, ``loss_length`` of them, are the
    trainable reply as it is written, escaped. The last row of a conversation that does not end with an assistant turn has a length of 0.

    Turns come in the order of their number, nulls first; equal numbers by role, then text. Null roles and texts are empty ones. A null id is a
    conversation of its own. Repeated rows are turns each. An empty table gives no examples; other columns are left out. A conversation is one row
    while it is formatted, so it has to fit a task; a digest of it needs that anyway.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = conversations.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct((t["role"] == trained).alias("trained"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SEPARATE)).alias("head"), escape(t["text"]).alias("body")))
    split = whole.select("conv_id", pieces.alias("pieces")).select("conv_id", "pieces", F.size("pieces").alias("n"))
    kept = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == F.col("n")) | F.element_at("pieces", i)["trained"])
    each = split.select("conv_id", "pieces", F.explode(kept).alias("position")).withColumn("last", F.element_at("pieces", F.col("position")))
    context = F.array_join(F.transform(F.slice("pieces", F.lit(1), F.col("position") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    each = each.select("conv_id", "position", "last", context.alias("context"))
    return each.select("conv_id", "position", F.concat("context", "last.head", "last.body", F.lit(CLOSE)).alias("formatted"),
                       (F.length("context") + F.length("last.head") + 1).alias("loss_start"), F.when(F.col("last.trained"), F.length("last.body")).otherwise(0).alias("loss_length"))


def turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(part: Column) -> Column:
        two = F.split(F.substring(part, len(OPEN) + 1, _REST), r"\[INST\]")
        return F.struct(unescape(two[0]).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(parts, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its examples: ``turns``, ``loss_text`` (all trainable text in order, unescaped) and ``formatted_chars`` of all examples."""
    loss = F.substring(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))
    rows = formatted.select("conv_id", "position", "formatted", F.when(F.col("loss_length") > 0, F.struct("position", unescape(loss).alias("text"))).alias("loss"))
    whole = rows.groupBy("conv_id").agg(F.max_by("formatted", "position").alias("whole"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum(F.length("formatted")).alias("formatted_chars"))
    return whole.select("conv_id", turns(F.col("whole")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss_text"), "formatted_chars")


def digests(read: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars); a turn is hashed as its role, a line feed, its text and a line feed."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       sha(F.col("loss_text")).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
