"""Quality rules: a short-circuit cascade ordered by rejection per cost.

All of it is column expressions over one scan: measures need only their own text, so
nothing is shuffled and a row of any key costs the same.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, result_texts, words_of

SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH = 5
# Rows on which cost and selectivity are estimated; they decide the order, never a verdict.
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class QualityRule:
    """``rejects`` gets the text and the base measures and says whether the rule rejects."""

    name: str
    rejects: Callable[[Column, dict[str, Column]], Column]


def _share_of(pattern: str, text: Column, least: float) -> Column:
    """Whether characters of ``pattern`` make up at least this share of the letters."""
    found = F.length(F.regexp_replace(text, f"[^{pattern}]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (letters > 0) & (found >= least * letters)


DEFAULT_RULES = (
    QualityRule("symbols", lambda text, m: m["n_symbols"] * 5 > m["n_words"]),
    QualityRule("word_length", lambda text, m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    QualityRule("repeated_lines", lambda text, m: m["n_dup_lines"] * 2 > F.size(F.split(text, "\n"))),
    QualityRule("capitals", lambda text, m: _share_of(r"\p{Lu}", text, 0.6)),
    QualityRule("shouting", lambda text, m: F.length(text) - F.length(F.translate(text, "!", "")) > m["n_words"]),
    QualityRule("few_distinct_words", lambda text, m: let(words_of(text), lambda w: F.size(F.array_distinct(w)) * 4 < F.size(w))),
    QualityRule("few_letters", lambda text, m: F.length(F.regexp_replace(text, r"[^\p{L}]", "")) * 2 < m["word_chars"]),
)


def _repeated_words(words: Column) -> Column:
    """Words inside windows of five words that the text holds at least twice.

    Windows are compared by 64-bit hash. Only texts with a repeated hash are sorted.
    """

    def from_windows(windows: Column) -> Column:
        def marked(placed: Column) -> Column:
            """Places of repeated windows, from windows sorted by hash."""
            twin = lambda x, i: (F.get(placed, i - 1)["h"] == x["h"]) | (F.get(placed, i + 1)["h"] == x["h"])
            places = F.sort_array(F.transform(F.filter(placed, lambda x, i: F.coalesce(twin(x, i), F.get(placed, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"]))
            # A window adds five words, or fewer if it overlaps the one before.
            added = lambda ps: F.transform(ps, lambda p, i: F.least(F.lit(REPEAT_WIDTH), p - F.get(ps, i - 1)))
            return let(places, lambda ps: F.aggregate(added(ps), F.lit(0), lambda a, x: a + x))

        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(placed, marked))

    def from_hashes(hashes: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(REPEAT_WIDTH)])
        count = F.size(hashes) - REPEAT_WIDTH + 1
        windows = F.transform(F.sequence(F.lit(0), count - 1), window)
        return F.when(count < 2, F.lit(0)).otherwise(let(windows, from_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)


def quality_measures(results: DataFrame) -> DataFrame:
    """``object_id, result_text`` and the base measures every verdict starts from.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line), n_repeat_words (words within repeated five-word windows).
    Null text counts as empty: all measures are 0.
    """
    text = F.coalesce(F.col("result_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")

    def measured(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeated_words(words).cast("long").alias("n_repeat_words"))

    return result_texts(results).select(
        "object_id", text.alias("result_text"), let(words_of(text), measured).alias("_m"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        "object_id", "result_text", F.col("_m.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("_m.n_repeat_words").alias("n_repeat_words"),
    )


def _measures() -> dict[str, Column]:
    return {n: F.col(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}


def order_rules(results: DataFrame, rules: tuple[QualityRule, ...] = DEFAULT_RULES, sample_rows: int = SAMPLE_ROWS) -> list[QualityRule]:
    """Rules by rejected rows per second on a sample of about ``sample_rows`` rows.

    Each rule is timed alone over the measured sample. The order changes what a verdict
    costs, not which texts are kept. It does change which of several rejecting rules is
    met first: ``rejected_by`` of ``apply_quality_rules`` hangs on the sample and the clock.
    """
    total = results.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = quality_measures(results.sample(share, seed=1) if share < 1 else results).cache()
    try:
        sample.count()
        rates = []
        for rule in rules:
            rejected = F.count_if(F.coalesce(rule.rejects(F.col("result_text"), _measures()), F.lit(False)))
            began = time.perf_counter()
            n = sample.agg(rejected.alias("n")).first()["n"]
            rates.append((n / max(time.perf_counter() - began, 1e-6), rule))
    finally:
        sample.unpersist()
    return [rule for _, rule in sorted(rates, key=lambda r: -r[0])]


def apply_quality_rules(results: DataFrame, rules: tuple[QualityRule, ...] = DEFAULT_RULES) -> DataFrame:
    """Quality verdict for the text of every semantic result.

    Reads ``object_id, result_text`` of ``results`` and returns one row per input row:
    object_id, the measures of ``quality_measures``, ``base_failed`` (under 10 words, or
    more than a fifth of the words inside repeated windows), ``kept`` and ``rejected_by``
    (``base``, the first rule of the cascade that rejects, or null). The cascade has the order
    that ``order_rules`` finds, so where several rules reject a text, the one named can
    differ between runs.

    Null and empty texts have zero words and fail the base. Repeated rows are judged each
    for itself; a null object_id is carried through; an empty table gives no rows; other
    columns of ``results``, whatever their names, are not read.
    """
    ordered = order_rules(results, rules)
    measured = quality_measures(results)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.when(base_failed, F.lit("base"))
    for rule in ordered:
        verdict = verdict.when(F.coalesce(rule.rejects(F.col("result_text"), _measures()), F.lit(False)), F.lit(rule.name))
    return measured.select(
        "object_id", *_measures(), base_failed.alias("base_failed"), verdict.alias("rejected_by")
    ).withColumn("kept", F.col("rejected_by").isNull())
