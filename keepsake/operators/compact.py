"""Public, path-safe views of hits, evidence and media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import DEFAULT_IDS, IdSpace
from ..functions.redact import METADATA_PLACEHOLDER, redact_paths, safe_evidence_value
from .hotkeys import latest, top_rows
from .metadata import latest_metadata
from .search import usable_results

# Semantic type -> public evidence type; anything else is metadata.
EVIDENCE_TYPES = {
    "image_caption": "caption", "ocr_text": "ocr", "detected_objects": "object", "detected_places": "place",
    "media_metadata": "metadata", "canonical_metadata": "metadata", "object_relation": "metadata",
}
MAX_CONCEPTS, MAX_PLACES, MAX_CAPTION, MAX_LABEL = 20, 5, 1000, 100


def public_hits(hits: DataFrame, evidence: DataFrame, ids: IdSpace = DEFAULT_IDS) -> DataFrame:
    """Hits as outsiders see them: candidate or match, never a fact.

    Provenance is the sorted distinct content hashes and the number of results; the
    result ids themselves stay rows of the evidence table.
    """
    sources = evidence.groupBy("query_id", "object_id").agg(
        F.array_sort(F.collect_set("source_content_hash")).alias("source_content_hashes"),
        F.count_if(F.col("evidence_kind") == "semantic_result").alias("n_results"),
        F.min(F.when(F.col("evidence_kind") == "semantic_result", F.col("evidence_id"))).alias("first_result_id"),
    )
    return hits.join(sources, ["query_id", "object_id"], "left").select(
        "query_id", "rank", "object_id", "score", "occurred_at", "object_type",
        redact_paths(F.col("reason")).alias("reason"),
        ids.safe_ref(F.col("object_id")).alias("safe_ref"),
        F.when(F.size("missing") > 0, "candidate").otherwise("derived_evidence_match").alias("assessment"),
        F.col("missing").alias("missing_evidence"),
        F.lit(False).alias("is_fact"), "source_content_hashes", "n_results", "first_result_id",
    )


def evidence_type(semantic_type: Column) -> Column:
    names = F.create_map(*[F.lit(text) for pair in EVIDENCE_TYPES.items() for text in pair])
    return F.coalesce(F.try_element_at(names, semantic_type), F.lit("metadata"))


def compact_evidence(rows: DataFrame) -> DataFrame:
    """Evidence reduced to type, safe value, confidence and assessment.

    Needs ``semantic_type, snippet, confidence, assertion``; rows without type or value
    are dropped.
    """
    is_fact = F.coalesce(F.col("assertion") == "canonical_fact", F.lit(False))
    value = F.when(F.col("semantic_type") == "canonical_metadata", F.lit(METADATA_PLACEHOLDER)).otherwise(
        safe_evidence_value(redact_paths(F.col("snippet")))
    )
    usable = rows.filter(F.col("semantic_type").isNotNull() & F.col("snippet").isNotNull())
    kept = [name for name in rows.columns if name not in ("semantic_type", "snippet", "confidence", "assertion")]
    return usable.select(
        *kept,
        evidence_type(F.col("semantic_type")).alias("type"),
        value.alias("value"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"),
        is_fact.alias("is_fact"),
        F.when(is_fact, "fact").otherwise("candidate").alias("assessment"),
    )


def unconfirmed(hits: DataFrame) -> DataFrame:
    """One inference row per concept a hit has no evidence for."""
    rows = hits.select("query_id", "object_id", F.explode("missing").alias("concept"))
    return rows.select(
        "query_id", "object_id",
        F.when(F.col("concept") == "swimwear", "object").otherwise("metadata").alias("type"),
        F.concat(F.lit("unconfirmed: "), "concept").alias("value"),
        F.lit(0.0).alias("confidence"), F.lit(False).alias("is_fact"), F.lit("inference").alias("assessment"),
    )


def compact_hits(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """Compact evidence of every hit, missing concepts included."""
    known = compact_evidence(evidence.withColumn("assertion", F.lit("derived_evidence")))
    columns = ["query_id", "object_id", "type", "value", "confidence", "is_fact", "assessment"]
    return known.select(*columns).unionByName(unconfirmed(hits).select(*columns))


def warnings(summary: DataFrame) -> DataFrame:
    """Explanation and unsupported concepts of each query, as warning rows."""
    listed = F.filter(
        F.array(
            F.col("explanation"),
            F.when(F.size("unsupported") > 0,
                   F.concat(F.lit("No direct semantic evidence for: "), F.array_join("unsupported", ", "))),
        ),
        lambda text: text.isNotNull(),
    )
    return summary.select("query_id", F.posexplode(F.array_distinct(listed)).alias("nth", "warning"))


def compact_objects(records: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compact object views and their compact evidence."""
    views = records.select(
        "object_id", F.col("object_type").alias("media_type"), "occurred_at", "captured_at", "mime_type", "safe_ref"
    )
    shown = current.withColumn("snippet", F.coalesce("result_text", "result_json", F.lit("null")))
    return views, compact_evidence(
        shown.select("object_id", "semantic_result_id", "semantic_type", "snippet", "confidence", "assertion")
    )


def media_details(tables: dict[str, DataFrame]) -> DataFrame:
    """Display details of photos: time, coordinates, caption, labels, place candidates.

    Lists are cut to their fixed sizes per task before they are gathered.
    """
    photos = tables["objects"].filter("object_type = 'photo'")
    newest = latest_metadata(tables["metadata_extractions"]).select("object_id", F.col("metadata_json").alias("derived"))
    results = usable_results(tables["semantic_results"])

    captions = results.filter("semantic_type = 'image_caption' AND result_text <> ''")
    # Texts are cut before they move.
    captions = captions.withColumn("result_text", F.substring("result_text", 1, MAX_CAPTION))
    caption = latest(captions, ["object_id"], F.col("semantic_result_id"), ["result_text"])

    found = F.from_json("result_json", "detections array<struct<label string>>")["detections"]
    labels = results.filter("semantic_type = 'detected_objects'").select(
        "object_id", "semantic_result_id", F.posexplode(found).alias("nth", "item")
    ).filter("item.label <> ''")
    first = labels.groupBy("object_id", F.substring("item.label", 1, MAX_LABEL).alias("label")).agg(
        F.min(F.struct("semantic_result_id", "nth")).alias("seen")
    )
    concept = top_rows(first, ["object_id"], [F.col("seen")], MAX_CONCEPTS, "nth_label").groupBy("object_id").agg(
        F.array_sort(F.collect_list(F.struct("nth_label", "label"))).alias("labels")
    )

    listed = F.from_json("result_json", "candidates array<struct<kind string, latitude double, longitude double, confidence double>>")
    places = results.filter("semantic_type = 'detected_places'").select(
        "object_id", "semantic_result_id", F.posexplode(listed["candidates"]).alias("nth", "place")
    ).filter("place IS NOT NULL")
    place = top_rows(places, ["object_id"], [F.col("semantic_result_id"), F.col("nth")], MAX_PLACES, "nth_place")
    place = place.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("nth_place", "place"))).alias("places"))

    joined = photos
    for side in (newest, caption, concept, place):
        joined = joined.join(side, "object_id", "left")
    latitude = F.get_json_object("derived", "$.gps.latitude").try_cast("double")
    longitude = F.get_json_object("derived", "$.gps.longitude").try_cast("double")
    both = latitude.isNotNull() & longitude.isNotNull()
    empty = F.array().cast("array<string>")
    return joined.select(
        "object_id",
        F.coalesce(F.when(F.col("occurred_at") != "", F.col("occurred_at")), F.col("captured_at")).alias("occurred_at"),
        F.when(both, latitude).alias("latitude"), F.when(both, longitude).alias("longitude"),
        F.col("result_text").alias("caption"),
        F.coalesce(F.col("labels")["label"], empty).alias("concepts"),
        F.col("places")["place"].alias("place_candidates"),
    )


def enrich(hits: DataFrame, details: DataFrame) -> DataFrame:
    """Hits with the details of the object, where it is a photo."""
    extra = details.withColumnRenamed("occurred_at", "shown_at")
    return hits.join(extra, "object_id", "left")
