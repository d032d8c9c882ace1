"""Text normalisation, tokens, aliases, slugs and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning, in English and Russian.
STOP_WORDS = (
    "a", "an", "and", "find", "in", "of", "on", "photo", "photos", "the", "with",
    "в", "где", "и", "на", "найди", "с", "со", "фото", "фотографии",
)

# Concept -> words that stand for it in queries and in evidence.
VOCABULARY = {
    "snow": ("snow", "snowy", "снег", "снегу", "снегом", "снеж"),
    "person": ("person", "people", "man", "men", "woman", "women", "boy", "girl", "human",
               "человек", "люди", "мужчина", "женщина", "меня"),
    "swimwear": ("swimwear", "swimsuit", "swimming trunks", "bathing suit", "trunks",
                 "плавки", "плавках", "купальник"),
    "signboard": ("sign", "signboard", "signage", "board", "billboard", "text", "lettering",
                  "вывеска", "вывеской", "табличка"),
    "car": ("car", "automobile", "vehicle", "машина", "машиной", "автомобиль"),
    "sea": ("sea", "ocean", "seaside", "море", "морем", "океан"),
}

SNIPPET_CHARS = 320


def normalize(text: Column) -> Column:
    """Lower case; every run of characters other than letters, digits, ``_`` is one space."""
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


def words(text: Column) -> Column:
    """All normalised words; an empty text has none."""
    normal = normalize(text)
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    stops = F.array(*[F.lit(word) for word in stop_words])
    return F.filter(words(text), lambda word: ~F.array_contains(stops, word))


def contains_alias(normal_text: Column, normal_alias: Column) -> Column:
    """One word matches the start of any word, a phrase only whole words."""
    haystack = F.concat(F.lit(" "), normal_text, F.lit(" "))
    phrase = normal_alias.contains(" ")
    needle = F.when(phrase, F.concat(F.lit(" "), normal_alias, F.lit(" "))).otherwise(
        F.concat(F.lit(" "), normal_alias)
    )
    return (normal_alias != "") & haystack.contains(needle)


def collapse(text: Column) -> Column:
    """Every run of Unicode white space becomes one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def clean(text: Column) -> Column:
    """Trimmed text without NULs at the ends; null when nothing is left."""
    stripped = F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    stripped = F.regexp_replace(stripped, r"^\x00+|\x00+$", "")
    return F.when(stripped != "", stripped)


def slug(text: Column) -> Column:
    ascii_only = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(ascii_only, "^-+|-+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("unknown")).otherwise(trimmed)


def snippet(text: Column, payload: Column, semantic_type: Column) -> Column:
    """What to show of a result: its text, else labels, else place list, else JSON."""
    labels = F.from_json(payload, "detections array<struct<label string>>")["detections"]["label"]
    listed = F.filter(F.coalesce(labels, F.array()), lambda label: F.coalesce(label, F.lit("")) != "")
    places = F.coalesce(F.get_json_object(payload, "$.candidates"), F.lit("[]"))
    return (
        F.when(F.coalesce(text, F.lit("")) != "", F.substring(collapse(text), 1, SNIPPET_CHARS))
        .when(semantic_type == "detected_objects",
              F.concat(F.lit("detected objects: "), F.array_join(listed, ", ")))
        .when(semantic_type == "detected_places", F.concat(F.lit("place candidates: "), places))
        .otherwise(F.substring(F.coalesce(payload, F.lit("{}")), 1, SNIPPET_CHARS))
    )


def decode_json(text: Column, schema: str, default: Column) -> Column:
    """Parsed document, or ``default`` for text that is empty or no JSON of that shape."""
    return F.coalesce(F.from_json(F.when(text != "", text), schema), default)
