"""The corpus pipeline: documents in, packed token sequences out, one stage after the other.

Every stage maps the table of documents to the records its operator reads, applies the
operator to all its predecessor kept, and maps the decisions back. All but the last return
the columns of documents. A stage's result is written below the shared folder and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake import configure
from keepsake.llm.common import SPACES, Scratch
from keepsake.llm.languages import UNKNOWN, identify_languages
from keepsake.llm.lines import remove_similar_lines
from keepsake.llm.near import near_duplicates
from keepsake.llm.packing import pack_results
from keepsake.llm.passages import remove_repeated_passages
from keepsake.llm.queries import as_results, learned_languages

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A document goes if no language holds at least this share of its letters.
LEAST_SHARE = 0.4


def _kept_columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _as_records(docs: DataFrame) -> DataFrame:
    """Records keyed by all columns but the text, which ride along as the key of the record.

    The doc_id leads, so records are ordered as documents are; the rest tells rows apart.
    """
    key = F.struct("doc_id", F.col("lang"), F.col("source"), F.col("n_chars"))
    return docs.select(key.alias("object_id"), F.col("text").alias("result_text"))


def _as_documents(records: DataFrame, text: str) -> DataFrame:
    """Documents back from records: new text, and its length where the text is not null."""
    return records.select("object_id.doc_id", F.col(text).alias("text"), "object_id.lang", "object_id.source", F.length(text).cast("long").alias("n_chars"))


def _apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with doc_id, and those without, which stand outside the order of documents."""
    docs = _kept_columns(docs)
    return docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the language found. Documents without one, or with none that holds
    ``LEAST_SHARE`` of the letters, go."""
    configure(spark)
    docs = _kept_columns(docs)
    key = F.struct(*[F.col(c) for c in COLUMNS])
    found = identify_languages(docs.select(key.alias("object_id"), F.col("text").alias("result_text")), learned_languages(spark, sf_dir))
    kept = found.filter((F.col("language") != UNKNOWN) & (F.col("confidence") >= LEAST_SHARE))
    return kept.select("object_id.doc_id", "object_id.text", F.col("language").alias("lang"), "object_id.source", "object_id.n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out of texts that an earlier line resembles; every document stays.

    Rows without doc_id take nothing from others and lose nothing. A document that has no
    words left is let go by jaccard_join.
    """
    configure(spark)
    known, others = _apart(docs)
    return _as_documents(remove_similar_lines(_as_records(known)), "kept_text").unionByName(others)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest doc_id.

    A row without doc_id stays only if no other of its group has one. Of rows that share the
    doc_id the first by hash of the text and by the other columns stays, of equal rows one.
    Documents without words go: language_id passes none, so theirs were lines that earlier
    documents hold, and line_dedup took them all.
    """
    configure(spark)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.md5("text").alias("text_key"), "lang", "source", "n_chars")
    docs = _kept_columns(docs).withColumn("row", row)
    filled = docs.filter(F.btrim("text", F.lit(SPACES)) != "")
    judged = near_duplicates(filled.select(F.col("row").alias("object_id"), F.col("text").alias("result_text")))
    first = judged.filter(F.col("object_id") == F.col("class_id")).select(F.col("object_id").alias("row"))
    # Equal rows are folded before they meet, so that many of them are one.
    return _kept_columns(filled.dropDuplicates(["row"]).join(first, "row", "left_semi"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more out of texts that a smaller doc_id has too.

    Texts that lose nothing stay as they are, with their white space; null stays null. Of
    others the remaining words are joined by one space. Rows without doc_id take nothing from
    others and lose nothing.
    """
    configure(spark)
    known, others = _apart(docs)
    return _as_documents(remove_repeated_passages(_as_records(known), as_is=True), "kept_text").unionByName(others)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining texts, packed into sequences of 1024 tokens."""
    import public_tokenizers

    configure(spark)
    packed = pack_results(as_results(_kept_columns(docs)), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        F.col("object_id").alias("doc_id"), "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing),
]

# Classifier, similarity join and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    configure(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
