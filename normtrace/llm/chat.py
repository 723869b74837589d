"""Chat formatting with column expressions only: turns in, one training string and its loss mask out.

The turns of a conversation are collected as structs and sorted; a turn with the role of the one
before continues its block, so adjacent turns of a role share one header. A block reads

    ### role: text</turn>text</turn>

and ends with a line break. In roles and texts a backslash is doubled, and the marks are broken by
backslashes (``###`` as ``\\#\\#\\#``, ``</turn>`` as ``<\\/turn>``, the end of a role as ``:\\ ``), so no
text can hold a mark, and dropping each backslash before a character restores every text. The output
is a list of segments and a parallel list of flags that tells which of them the loss covers: the texts
of the assistant, nothing else.

Defined results: a null text or role is empty; a null turn sorts first, equal turns by role, then
text; repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = "### "
ROLE_END = ": "
TURN_END = "</turn>"
BLOCK_END = "\n"
TRAINED = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\#\\#\\#")), F.lit(TURN_END), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(ROLE_END), F.lit(":\\ ")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``(conv_id, formatted, segments, trained)`` of ``rows(conv_id, turn, role, text)``."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column, i: Column) -> Column:
        new = (i == 0) | (t["role"] != F.get("turns", i - 1)["role"])
        last = (i == F.size("turns") - 1) | (t["role"] != F.get("turns", i + 1)["role"])
        head = F.when(new, F.concat(F.lit(HEAD), escape(t["role"], role=True), F.lit(ROLE_END))).otherwise("")
        tail = F.when(last, F.lit(TURN_END + BLOCK_END)).otherwise(F.lit(TURN_END))
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("trained"))
        return F.array(piece(head, F.lit(False)), piece(escape(t["text"]), t["role"] == trained), piece(tail, F.lit(False)))

    cut = chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("s"))
    return cut.select("conv_id", F.array_join("s.text", "").alias("formatted"), F.col("s.text").alias("segments"), F.col("s.trained").alias("trained"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, read back from ``formatted`` alone."""
    blocks = F.slice(F.split("formatted", F.lit(HEAD)), 2, F.greatest(F.size(F.split("formatted", F.lit(HEAD))) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, ROLE_END, 1)
        texts = F.split(F.substr(block, F.length(role) + len(ROLE_END) + 1), F.lit(TURN_END))
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def loss_text(formatted: DataFrame) -> Column:
    """The text under the loss mask, as it was."""
    covered = F.filter(F.arrays_zip("segments", "trained"), lambda s: s["trained"])
    return F.array_join(F.transform(covered, lambda s: unescape(s["segments"])), "")
