"""Chat formatting by Spark expressions only.

The turns of a conversation are collected as structs, sorted, and adjacent turns of one role are merged into
a block. A block is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line break; texts of a merged block are
parted by ``<|turn|>``. Control strings inside roles and texts get one more backslash behind their first
character, so that no text can end its turn, and taking one away gives the text back: ``<|`` becomes ``<\\|``
and ``<\\|`` becomes ``<\\\\|``; ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>`` alike. ``loss_spans`` are the code
point ranges of the assistant texts in the output.

A conversation is one output row by definition and is put together in one task; conversations are hashed
over all tasks.

Defined results:

* Turns are sorted by turn number (NULL first), then role, then text. Repeated rows stay as turns.
* NULL texts are empty; a NULL role is the empty role. Empty texts are turns. A NULL ``conv_id`` is one conversation.
* Very long texts are escaped by one regular expression pass. An empty table gives an empty result.
* Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|turn|>", "<|im_end|>\n"
_CONTROL = r"\||/?s>|/?INST\]|<SYS>>|</SYS>>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start:int,end:int>>) from (conv_id, turn, role, text)."""
    entry = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    # A turn opens a block where its role differs from that of the turn before it, and closes one before a turn of another.
    def other(t: Column, i: Column) -> Column:
        return F.coalesce(F.get("turns", i)["role"] != t["role"], F.lit(True))

    pieces = F.transform("turns", lambda t, i: F.struct(
        F.when(other(t, i - 1), F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP))).otherwise(F.lit(TURN)).alias("head"),
        escaped(t["text"]).alias("body"), F.when(other(t, i + 1), F.lit(END)).otherwise("").alias("tail"),
        (t["role"] == ASSISTANT).alias("loss")))
    placed = ordered.select("conv_id", pieces.alias("pieces")).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), F.length(p["tail"]).alias("t"),
                                                 p["loss"].alias("loss"))).alias("lengths"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + p["h"]
        span = F.array(F.struct(start.alias("start"), (start + p["b"]).alias("end")))
        return F.struct((start + p["b"] + p["t"]).alias("at"), F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return placed.select("conv_id", "formatted", F.aggregate("lengths", zero, step, lambda s: s["spans"]).alias("loss_spans"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted) read back from the formatted text."""
    blocks = F.filter(F.split("formatted", F.lit(r"<\|im_start\|>")), lambda b: b != "")

    def of_block(block: Column) -> Column:
        inner = F.substring(block, F.lit(1), F.length(block) - len(END))
        role = F.substring_index(inner, SEP, 1)
        texts = F.substring(inner, F.length(role) + len(SEP) + 1, F.length(inner))
        return F.transform(F.split(texts, F.lit(r"<\|turn\|>"), -1), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return chats.select("conv_id", F.flatten(F.transform(blocks, of_block)).alias("turns"), loss.alias("loss_text"), "formatted")


