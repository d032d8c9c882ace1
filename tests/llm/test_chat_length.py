"""Conversations of very many turns are formatted and read back in time that follows their length."""

import time

from pyspark.sql import functions as F

from keepsake.llm import chat


def test_many_turns(spark):
    turns = 40_000
    text = F.concat(F.lit("say <"), F.col("id").cast("string"), F.lit("> ö # "))
    frame = spark.range(turns).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("ordinal"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    chat.format_conversations(frame.limit(10)).collect()
    began = time.perf_counter()
    formatted = chat.format_conversations(frame)
    row = chat.read_conversations(formatted).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    spent = time.perf_counter() - began
    said = [f"say <{k}> ö # " for k in range(turns)]
    assert [t.text for t in row.turns] == said and row.loss == "".join(said[1::2])
    assert len(row.loss_spans) == turns // 2 and spent < 30, spent
    print(f"{turns} turns in {spent:.1f} s")


def test_blocks_meet_at_every_length(spark):
    sizes = [0, 1, chat.BLOCK - 1, chat.BLOCK, chat.BLOCK + 1, 3 * chat.BLOCK]
    rows = [(n, k, "assistant", f"t{k}ß") for n in sizes for k in range(n)]
    frame = spark.createDataFrame(rows, "conv_id long, ordinal long, role string, text string")
    out = chat.format_conversations(frame)
    got = {r.conv_id: r for r in out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for n in sizes[1:]:
        assert got[n].loss == "".join(f"t{k}ß" for k in range(n))
        assert [got[n].formatted[s.start : s.start + s.length] for s in got[n].loss_spans] == [f"t{k}ß" for k in range(n)]
