"""Conversation exports: JSON documents with a mapping of nodes per conversation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rows of a batch are ordered as they were written: by document, conversation, node
# and kind. Hot keys are cut into chunks of this many documents.
DOCS_PER_CHUNK = 4096

# A VARIANT ends at 128 MiB, and its parser at strings of 20 million characters. No
# document below this size meets either limit; larger ones are cut into conversations.
WHOLE_BYTES = 20_000_000
# Texts of cut documents are passed on in batches of about this many characters.
BATCH_CHARS = 16_000_000

BLANK = re.compile(r"[ \t\n\r]*")


def read_exports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``doc_id, raw_uri, body`` of export files (and their ``size``): one document per file, or one per line.

    Files are numbered in the order of their paths. Lines are numbered as they are read:
    those of a file in their order, files as Spark takes them. A file that is one
    document is read by one task; lines split like any text.
    """
    uri = F.col("_metadata.file_path").alias("raw_uri")
    size = F.col("_metadata.file_size").alias("size")
    text = spark.read.text(path, wholetext=not lines).select(uri, size, F.col("value").alias("body"))
    if lines:
        return text.select(F.monotonically_increasing_id().alias("doc_id"), "raw_uri", "body")
    # The listing carries no content, and is sorted over many tasks.
    files = spark.read.format("binaryFile").load(path).select(uri).repartitionByRange("raw_uri").sortWithinPartitions("raw_uri")
    return text.join(files.select("raw_uri", F.monotonically_increasing_id().alias("doc_id")), "raw_uri").select("doc_id", "raw_uri", "size", "body")


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _text(value: Column) -> Column:
    """Text of a scalar; empty text counts as absent."""
    return F.nullif(_get(value, "$", "string"), F.lit(""))


def _members(value: Column) -> Column:
    """Members of a JSON object, null for anything else."""
    return _get(value, "$", "map<string,variant>")


def _list_bounds(body: str, at: int, decoder: json.JSONDecoder) -> tuple[list[tuple[int, int]], int]:
    """Where the items of the list that opens at ``at`` begin and end, and where it ends."""
    bounds = []
    at = BLANK.match(body, at + 1).end()
    while body[at] != "]":
        _, end = decoder.raw_decode(body, at)
        bounds.append((at, end))
        at = BLANK.match(body, end).end()
        if body[at] == ",":
            at = BLANK.match(body, at + 1).end()
            if body[at] == "]":
                raise ValueError("comma before the end")
        elif body[at] != "]":
            raise ValueError("list is not closed")
    return bounds, at + 1


def _no_constant(name: str) -> None:
    """NaN and infinities are no JSON, though Python's parser takes them."""
    raise ValueError(name)


def conversation_bounds(body: str) -> list[tuple[int, int]] | None:
    """Where the conversations of a document begin and end; None if it is no export.

    One conversation is decoded at a time, so memory follows the largest of them. What
    follows the end is not looked at, as in ``try_parse_json``.
    """
    decoder = json.JSONDecoder(parse_constant=_no_constant)
    found = None
    try:
        at = BLANK.match(body).end()
        if body[at] == "[":
            return _list_bounds(body, at, decoder)[0]
        if body[at] != "{":
            return None
        at = BLANK.match(body, at + 1).end()
        while body[at] != "}":
            name, end = decoder.raw_decode(body, at)
            at = BLANK.match(body, end).end()
            if not isinstance(name, str) or body[at] != ":":
                return None
            at = BLANK.match(body, at + 1).end()
            listed = name == "conversations" and body[at] == "["
            bounds, end = _list_bounds(body, at, decoder) if listed else (None, decoder.raw_decode(body, at)[1])
            found = bounds if name == "conversations" else found
            at = BLANK.match(body, end).end()
            if body[at] == ",":
                at = BLANK.match(body, at + 1).end()
                if body[at] == "}":
                    return None
            elif body[at] != "}":
                return None
    except (ValueError, IndexError, RecursionError):
        return None
    return found


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "raw_uri", "conv_pos", "text"]
    rows, size = [], 0
    for frame in frames:
        for doc_id, raw_uri, body in zip(frame["doc_id"], frame["raw_uri"], frame["body"]):
            bounds = conversation_bounds(body)
            if bounds is None:
                rows.append((doc_id, raw_uri, None, None))
            for position, (start, end) in enumerate(bounds or []):
                rows.append((doc_id, raw_uri, position, body[start:end]))
                size += end - start
                if size >= BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=names).astype({"conv_pos": "Int32"})
                    rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names).astype({"conv_pos": "Int32"})


def scan_conversations(documents: DataFrame, strict: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Conversations of export documents (``doc_id, raw_uri, body``), in order.

    A document is a list or an object with the list ``conversations``; items that are no
    objects are skipped. Any other document is an error, or, where not ``strict``, one row
    without position whose ``mapping_state`` is ``unreadable``. So is, at its position, a
    conversation that is itself beyond the limits of VARIANT. For JSON lines, one
    conversation each, use ``scan_lines``.

    Documents up to ``whole_bytes`` are parsed as one value, larger ones cut first. Where the
    documents bring the ``size`` of their files, each file is opened by one of the two only.
    """
    size = F.col("size") if "size" in documents.columns else F.octet_length("body")
    documents = documents.withColumn("size", size).select("doc_id", "raw_uri", "size", "body")
    large = F.coalesce(F.col("size") > whole_bytes, F.lit(False))
    parsed = documents.filter(~large).select("doc_id", "raw_uri", F.try_parse_json("body").alias("doc"))
    listed = F.coalesce(
        _get(F.col("doc"), "$", "array<variant>"), _get(F.col("doc"), "$.conversations", "array<variant>")
    )
    whole = parsed.select("doc_id", "raw_uri", listed.alias("listed")).select(
        "doc_id", "raw_uri", F.col("listed").isNull().alias("unreadable"), F.posexplode_outer("listed").alias("conv_pos", "conv")
    ).filter("unreadable OR conv_pos IS NOT NULL")
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, raw_uri string, conv_pos int, text string"
    cut = documents.filter(large).select("doc_id", "raw_uri", "body").mapInPandas(_cut, schema).select(
        "doc_id", "raw_uri", "conv_pos", F.try_parse_json("text").alias("conv")
    ).select("doc_id", "raw_uri", F.col("conv").isNull().alias("unreadable"), "conv_pos", "conv")
    items = whole.unionByName(cut)
    if strict:
        problem = F.raise_error(F.concat(F.lit("not a conversation export: "), "raw_uri")).cast("boolean")
        items = items.withColumn("unreadable", F.when(F.col("unreadable") & F.col("conv_pos").isNull(), problem).otherwise(F.col("unreadable")))
    return _described(items)


def scan_lines(documents: DataFrame) -> DataFrame:
    """Conversations of JSON lines: every document is one conversation.

    Blank lines are skipped; a line that cannot be parsed is ``unreadable``.
    """
    filled = documents.filter(F.trim("body") != "").select("doc_id", "raw_uri", F.try_parse_json("body").alias("conv"))
    return _described(filled.select("doc_id", "raw_uri", F.col("conv").isNull().alias("unreadable"), F.lit(0).alias("conv_pos"), "conv"))


def _described(items: DataFrame) -> DataFrame:
    fields = items.select("*", _members(F.col("conv")).alias("f")).filter("unreadable OR f IS NOT NULL")
    named = lambda name: F.try_element_at("f", F.lit(name))
    rows = fields.select(
        "doc_id", "raw_uri", "conv_pos", "unreadable",
        F.coalesce(_text(named("conversation_id")), _text(named("id"))).alias("conv_id"),
        _get(named("create_time"), "$", "string").alias("create_time"),
        F.sha2(F.to_json("conv"), 256).alias("content_hash"),
        named("mapping").alias("m"),
    )
    kinds = rows.select(
        "*", _members(F.col("m")).alias("mapping"),
        F.size(_get(F.col("m"), "$", "array<variant>")).alias("items"),
        _get(F.col("m"), "$", "string").alias("scalar"),
    )
    # Whatever counts as false (null, empty, zero) is an empty mapping, not an invalid one.
    state = (
        F.when(F.col("unreadable"), "unreadable")
        .when(F.col("mapping").isNotNull(), "object")
        .when(F.col("items") > 0, "invalid")
        .when(~F.coalesce("scalar", F.lit("")).isin("", "0", "false"), "invalid")
        .otherwise("empty")
    )
    return kinds.withColumn("mapping_state", state).drop("m", "items", "scalar", "unreadable")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """One row per mapping entry; conversations without entries keep one row with null node.

    Nodes of a conversation come in key order. A node that is no object counts as empty.
    The columns of the conversation are kept, so this one table says all there is to know
    about a batch of exports.
    """
    kept = [name for name in conversations.columns if name != "mapping"]
    entries = conversations.select(*kept, F.posexplode_outer(F.map_entries("mapping")).alias("node_pos", "entry"))
    opened = entries.select(
        *kept, "node_pos", F.col("entry.key").alias("node_id"), F.col("entry.value").alias("value"),
        _members(F.col("entry.value")).alias("node"),
    )
    inner = opened.select(
        *kept, "node_pos", "node_id", F.col("node").isNotNull().alias("is_object"),
        F.when(F.col("node_id").isNotNull(), F.sha2(
            F.when(F.col("node").isNotNull(), F.to_json("value")).otherwise(F.lit("{}")), 256
        )).alias("node_hash"),
        _get(F.try_element_at("node", F.lit("parent")), "$", "string").alias("parent_key"),
        F.try_element_at("node", F.lit("message")).alias("message"),
        _members(F.try_element_at("node", F.lit("message"))).alias("f"),
    )
    named = lambda name: F.try_element_at("f", F.lit(name))
    attachments = F.coalesce(F.to_json(_get(named("metadata"), "$.attachments", "variant")), F.lit("null"))
    has_message = F.coalesce(F.size("f") > 0, F.lit(False))
    return inner.select(
        *kept, "node_pos", "node_id", "is_object", "node_hash", "parent_key",
        has_message.alias("has_message"),
        _text(named("id")).alias("message_id"),
        F.coalesce(F.nullif(_get(named("author"), "$.role", "string"), F.lit("")), F.lit("unknown")).alias("role"),
        F.coalesce(F.nullif(_get(named("content"), "$.content_type", "string"), F.lit("")), F.lit("unknown")).alias("content_type"),
        _get(named("create_time"), "$", "string").alias("message_time"),
        F.when(has_message, F.sha2(F.to_json("message"), 256)).alias("message_hash"),
        (~attachments.isin("null", "[]", "{}", '""', "0", "false")).alias("has_attachments"),
    )


def ordinal(doc_id: Column, conv_pos: Column, node_pos: Column, kind: int) -> Column:
    """Place of a row in its batch; compares part by part, document first."""
    return F.struct(
        doc_id.cast("long").alias("doc_id"), conv_pos.cast("long").alias("conv_pos"),
        node_pos.cast("long").alias("node_pos"), F.lit(kind).alias("kind"),
    )
