"""Registered queries of the operators: each maps given tables to an operator and its results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_results(documents: DataFrame) -> DataFrame:
    """Documents as the records the operators read: texts of semantic results."""
    return documents.select(F.col("doc_id").alias("object_id"), F.col("text").alias("result_text"))


def results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_results(table(spark, sf_dir, "documents"))


def doc_id() -> Column:
    return F.col("object_id").alias("doc_id")


def fold(count: int) -> Column:
    """crc32 of the id as text, modulo ``count``."""
    return F.crc32(F.col("object_id").cast("string").cast("binary")) % count


@query("op6_quality_rules")
def op6_quality_rules(spark, d):
    from .rules import apply_quality_rules

    out = apply_quality_rules(results_of(spark, d))
    return out.select(doc_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, d):
    import public_tokenizers

    from .packing import pack_results

    packed = pack_results(results_of(spark, d), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(doc_id(), "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op8_chat_formatting")
def op8_chat_formatting(spark, d):
    from .chat import format_conversations, loss_text, read_conversations

    said = r"\### Assistant: </turn> ok"
    given = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, ordinal long, role string, text string")
    formatted = format_conversations(given.unionByName(added))
    turns = read_conversations(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = turns.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op10_bpe_round_trip")
def op10_bpe_round_trip(spark, d):
    import public_tokenizers

    from .bpe import encode_results

    out = encode_results(results_of(spark, d), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(doc_id(), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_substring_dedup")
def op4_substring_dedup(spark, d):
    from .passages import remove_repeated_passages

    out = remove_repeated_passages(results_of(spark, d))
    return out.select(doc_id(), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def learned_languages(spark: SparkSession, d: str):
    """A model from texts and known languages of the documents outside the held-out fold."""
    from .languages import learn_languages

    known = table(spark, d, "documents").select(
        F.col("doc_id").alias("object_id"), F.col("text").alias("result_text"), F.col("lang").alias("language"))
    return learn_languages(known.filter(fold(4) != 2))


@query("op1_language_id")
def op1_language_id(spark, d):
    from .languages import identify_languages

    out = identify_languages(results_of(spark, d), learned_languages(spark, d))
    return out.select(doc_id(), (fold(4) == 2).alias("held_out"), F.col("language").alias("lang_pred"), F.col("confidence").alias("score"), F.size("spans").alias("n_spans"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark, d):
    from .quality import learn_quality, score_quality

    results = results_of(spark, d)
    known = results.filter(fold(5) != 0)
    trusted = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("object_id")).filter(fold(5) != 0)
    model = learn_quality(known, trusted)
    out = score_quality(results, model)
    return out.select(
        doc_id(), (fold(5) == 0).alias("held_out"), F.col("confidence").alias("score"), (F.col("confidence") >= 0.3).cast("int").alias("predicted"))


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, d):
    from .near import near_duplicates

    return near_duplicates(results_of(spark, d)).select(doc_id(), "class_id", "n_links")


@query("op5_line_dedup")
def op5_line_dedup(spark, d):
    from .lines import remove_similar_lines

    out = remove_similar_lines(results_of(spark, d))
    return out.select(doc_id(), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark, d):
    from .vectors import near_vectors

    out = near_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("object_id"), "embedding"))
    return out.select(
        F.col("object_id").alias("vec_id"), "n_links", "component_id", F.col("object_id").eqNullSafe(F.col("component_id")).alias("kept"))


FIM_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents),
drawn AS (
  SELECT doc_id, t, tokens, len(tokens) AS n,
         CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(tokens) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(tokens) + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 AS d3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 AS d4
  FROM cut),
parts AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d3 >= 50 THEN 'plain'
              WHEN d4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(tokens[1 : least(c1, c2)], '') AS prefix,
         array_to_string(tokens[least(c1, c2) + 1 : greatest(c1, c2)], '') AS middle,
         array_to_string(tokens[greatest(c1, c2) + 1 : n], '') AS suffix
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", FIM_SQL)
def op13_fill_in_middle(spark, d):
    from .fim import fill_in_middle, restore_texts

    out = restore_texts(fill_in_middle(results_of(spark, d)))
    return out.select(
        doc_id(), F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", F.col("text_sha256").alias("restored_sha256"))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f1 AS (SELECT lang, phrase, count(*) AS c FROM (SELECT lang, unnest(w) AS phrase FROM cut) GROUP BY ALL),
f2 AS (SELECT lang, p.a || ' ' || p.b AS phrase, p.a AS w1, p.b AS w2, count(*) AS c
       FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) AS p FROM cut) GROUP BY ALL),
f3 AS (SELECT lang, p.a || ' ' || p.b || ' ' || p.c AS phrase, p.a AS w1, p.b AS w2, p.c AS w3, count(*) AS c
       FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {'a': w[i], 'b': w[i + 1], 'c': w[i + 2]})) AS p FROM cut) GROUP BY ALL),
totals AS (SELECT lang, sum(c) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT f2.lang, f2.phrase, 1 AS k, f2.c AS a, x.c AS l, y.c AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.phrase = w1 JOIN f1 y ON y.lang = f2.lang AND y.phrase = w2 WHERE f2.c >= 10
  UNION ALL
  SELECT f3.lang, f3.phrase, 1, f3.c, x.c, y.c
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.phrase = w1 JOIN f2 y ON y.lang = f3.lang AND y.phrase = f3.w2 || ' ' || w3 WHERE f3.c >= 10
  UNION ALL
  SELECT f3.lang, f3.phrase, 2, f3.c, x.c, y.c
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.phrase = f3.w1 || ' ' || f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.phrase = w3 WHERE f3.c >= 10),
scored AS (
  SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
  SELECT lang, phrase, max(c) AS c FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, c FROM f3 WHERE c >= 10 UNION ALL SELECT lang, w2 || ' ' || w3, c FROM f3 WHERE c >= 10)
  GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank, s.phrase,
       a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM scored s JOIN totals USING (lang) LEFT JOIN covered c ON c.lang = s.lang AND c.phrase = s.phrase
WHERE c.c IS NULL OR 100 * c.c < 50 * a
QUALIFY rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11_collocations(spark, d):
    from .collocations import mine_collocations

    found = mine_collocations(table(spark, d, "documents").select(F.col("text").alias("result_text"), F.col("lang").alias("language")))
    return found.withColumnRenamed("language", "lang")


@query("op12_suffix_array_dedup")
def op12_suffix_array_dedup(spark, d):
    from .suffixes import remove_repeated_strings

    out = remove_repeated_strings(results_of(spark, d))
    return out.select(doc_id(), "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
