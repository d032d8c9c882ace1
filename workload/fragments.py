"""DuckDB fragments the oracles share."""

from __future__ import annotations

from keepsake.functions.text import STOP_WORDS, VOCABULARY

from .dialects import Duck

DUCK = Duck()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


STOPS = "[" + ", ".join(quoted(word) for word in STOP_WORDS) + "]"


def toks(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '' AND NOT list_contains({STOPS}, w))"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def clean(x: str) -> str:
    return rf"nullif(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '')"


def slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


def found_in(normal: str, alias: str) -> str:
    """A word starts some word of the text; a phrase is a run of whole words."""
    return (
        f"(CASE WHEN {alias} = '' THEN false WHEN contains({alias}, ' ') THEN contains(' ' || {normal} || ' ', ' ' || {alias} || ' ') "
        f"ELSE contains(' ' || {normal}, ' ' || {alias}) END)"
    )


ISO = r"'^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?([.,]\d{1,9})?(Z|[+-]\d{2}:?\d{2})?)?$'"


def iso_us(x: str) -> str:
    """Microseconds of ISO text, through DuckDB's own zoned time stamps."""
    return f"CASE WHEN regexp_matches({x}, {ISO}) THEN epoch_us(try_cast({x} AS TIMESTAMPTZ)) END"


VOCABULARY_ROWS = ", ".join(
    f"({rank}, {quoted(concept)}, {quoted(alias)})"
    for rank, (concept, aliases) in enumerate(VOCABULARY.items()) for alias in aliases
)

# Requested concepts per query: q_terms(query_id, concept_rank, concept, needle).
CONCEPT_CTES = f"""vocab(crank, concept, alias) AS (VALUES {VOCABULARY_ROWS}),
q_norm AS (SELECT query_id, {norm('query')} AS n, {toks('query')} AS toks FROM v_queries),
q_fired AS (SELECT query_id, crank, v.concept, v.alias FROM q_norm JOIN vocab v ON contains(q_norm.n, v.alias)),
q_used AS (SELECT query_id, unnest(string_split(alias, ' ')) AS w FROM q_fired),
q_free AS (SELECT query_id, pos, w FROM (SELECT query_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM q_norm) t
  WHERE NOT EXISTS (SELECT 1 FROM q_used u WHERE u.query_id = t.query_id AND u.w = t.w)),
q_all AS (SELECT query_id, 0 AS grp, crank AS pos, concept FROM q_fired UNION ALL SELECT query_id, 1, pos, w FROM q_free),
q_once AS (SELECT query_id, concept, min(grp * 100000 + pos) AS o FROM q_all GROUP BY ALL),
q_concepts AS (SELECT query_id, concept, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS INT) AS concept_rank FROM q_once),
q_terms AS (SELECT DISTINCT c.query_id, c.concept_rank, c.concept, coalesce(v.alias, c.concept) AS needle
  FROM q_concepts c LEFT JOIN vocab v ON v.concept = c.concept)"""
