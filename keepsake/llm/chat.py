"""Chat formatting: turns of conversations as one training text each, with a loss mask.

Relational and native: turn structs are collected and sorted, adjacent turns of one role
are merged by array functions, and the text is concatenated by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Control strings. ``<`` and ``#`` never occur in an escaped text, so none can be forged.
OPEN, END_ROLE, BETWEEN, CLOSE = "### ", ":#", "<part>", "</turn>"
TRAINED_ROLE = "assistant"
# Arrays are worked on in blocks of this many items: appending copies what is there, and
# finding a character counts from the start.
BLOCK = 256


def _in_blocks(items: Column) -> Column:
    """An array as arrays of ``BLOCK`` items in order."""
    count = F.ceil(F.size(items) / BLOCK).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def escaped(text: Column) -> Column:
    """Text without ``<`` and ``#``, reversibly: every backslash starts one of three marks."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One formatted text per conversation, with the spans a loss is taken over.

    Reads ``conv_id, ordinal, role, text`` of conversation messages and returns per
    conversation: conv_id, ``formatted`` and ``loss_spans`` (array of ``start, length`` in
    code points of ``formatted``: the texts of the assistant). Adjacent turns of one role
    share one role mark; the texts inside stay apart, so reading back gives every turn.

    Turns are ordered by ordinal, then role and text; null ordinals come first, ties and
    repeated rows are turns of their own. Null text and null role count as empty. Rows
    without conv_id form one conversation. No rows give no conversations. Other columns
    are not read. A conversation is one output row, so it has to fit into one.
    """
    turn = F.struct(
        F.col("ordinal"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def merged(turns: Column) -> Column:
        """Runs of one role: ``role`` and the texts in order."""
        starts = F.filter(
            F.sequence(F.lit(0), F.size(turns) - 1),
            lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, F.greatest(i - 1, F.lit(0)))["role"]),
        )
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(
            F.get(turns, at)["role"].alias("role"),
            F.transform(
                F.slice(turns, at + 1, F.coalesce(F.get(s, k + 1), F.size(turns)) - at), lambda t: escaped(t["text"])
            ).alias("parts"),
        )))

    def pieces(runs: Column) -> Column:
        """Consecutive strings of the formatted text, and whether a loss is taken over them."""
        piece = lambda text, trained: F.struct(text.alias("text"), trained.alias("trained"))
        plain = lambda text: piece(text, F.lit(False))
        return F.flatten(F.transform(runs, lambda run: F.concat(
            F.array(plain(F.concat(F.lit(OPEN), escaped(run["role"]), F.lit(END_ROLE)))),
            F.flatten(F.transform(run["parts"], lambda part, i: F.array(
                plain(F.when(i > 0, F.lit(BETWEEN)).otherwise(F.lit(""))), piece(part, run["role"] == TRAINED_ROLE)
            ))),
            F.array(plain(F.lit(CLOSE))),
        )))

    def placed(pieces: Column) -> Column:
        """Spans of trained pieces, place by place within blocks, then moved by the lengths before."""
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p["text"]))
        told = F.transform(_in_blocks(pieces), lambda block: F.struct(placed_in_block(block).alias("spans"), length(block).alias("length")))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda state, block: F.struct((state["at"] + block["length"]).alias("at"), F.array_append(state["starts"], state["at"]).alias("starts"))

        def moved(blocks: Column) -> Column:
            starts = F.aggregate(blocks, first, step, lambda state: state["starts"])
            return let(starts, lambda s: F.flatten(F.transform(blocks, lambda block, k: F.transform(
                block["spans"], lambda span: F.struct((span["start"] + F.get(s, k)).alias("start"), span["length"].alias("length"))))))

        return let(told, moved)

    def placed_in_block(pieces: Column) -> Column:
        """Spans of trained pieces; places are running sums of lengths."""
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

        def step(state: Column, p: Column) -> Column:
            span = F.struct(state["at"].alias("start"), F.length(p["text"]).alias("length"))
            return F.struct(
                (state["at"] + F.length(p["text"])).alias("at"),
                F.when(p["trained"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
            )

        return F.aggregate(pieces, first, step, lambda state: state["spans"])

    out = let(let(F.col("turns"), merged), lambda runs: let(pieces(runs), lambda ps: F.struct(
        F.array_join(F.transform(ps, lambda p: p["text"]), "").alias("formatted"), placed(ps).alias("loss_spans")
    )))
    return turns.select("conv_id", out.alias("out")).select("conv_id", "out.formatted", "out.loss_spans")


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of ``role, text``), read back from ``formatted`` alone."""
    runs = F.filter(F.split(F.col("formatted"), CLOSE), lambda run: run != "")
    body = lambda run: F.substring_index(run, END_ROLE, -1)
    head = lambda run: F.substring_index(run, END_ROLE, 1)
    role = lambda run: unescaped(F.substring(head(run), F.lit(len(OPEN) + 1), F.length(run)))
    turns = F.flatten(F.transform(runs, lambda run: F.transform(
        F.split(body(run), BETWEEN), lambda part: F.struct(role(run).alias("role"), unescaped(part).alias("text"))
    )))
    return formatted.withColumn("turns", turns)


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss is taken over: the marked spans, unescaped, with nothing between."""
    cut = lambda text, span, origin: unescaped(F.substring(text, span["start"] - origin + 1, span["length"]))

    def told(block: Column) -> Column:
        first, last = F.get(block, 0), F.get(block, F.size(block) - 1)
        stretch = F.substring(formatted, first["start"] + 1, last["start"] + last["length"] - first["start"])
        return let(stretch, lambda text: F.array_join(F.transform(block, lambda span: cut(text, span, first["start"])), ""))

    return F.array_join(F.transform(_in_blocks(spans), told), "")
