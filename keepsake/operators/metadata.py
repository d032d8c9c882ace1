"""Photo and video tag records to normalised metadata with explicit diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import DEFAULT_IDS, IdSpace, canonical_json
from ..functions.redact import error_name
from ..functions.text import clean
from ..functions.timegeo import (
    exif_datetime, gps_coordinate, iso6709, milliseconds_to_seconds, valid_coordinate, video_datetime,
)
from .hotkeys import latest

PHOTO_EXTRACTOR = "photo.tags@1"
VIDEO_EXTRACTOR = "video.tracks@1"
DATE_KEYS = ("encoded_date", "tagged_date", "recorded_date", "mastered_date")
GROUPS = ("capture_time", "gps", "camera", "orientation", "dimensions")


def _diagnostic(condition: Column, code: str, detail: str) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail")))


def _diagnostics(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda item: item.isNotNull())


def photo_metadata(records: DataFrame) -> DataFrame:
    """Normalise tag records; a time is only taken when it is certain.

    Differing original and digitised times, a missing offset and invalid coordinates
    become diagnostics; any diagnostic makes the record partial.
    """
    original = clean(F.col("date_time_original"))
    digitized = clean(F.col("date_time_digitized"))
    offset = clean(F.col("offset_time"))
    make, model = clean(F.col("make")), clean(F.col("model"))
    latitude = gps_coordinate(F.col("gps.lat"), F.col("gps.lat_ref"))
    longitude = gps_coordinate(F.col("gps.lon"), F.col("gps.lon_ref"))
    has_gps = F.col("gps").isNotNull()
    gps_ok = has_gps & valid_coordinate(latitude, longitude)

    conflict = original.isNotNull() & digitized.isNotNull() & (original != digitized)
    dated = original.isNotNull() & offset.isNotNull() & ~conflict
    moment = F.when(dated, exif_datetime(original, offset))

    diagnostics = _diagnostics(
        _diagnostic(has_gps & ~gps_ok, "photo.gps_invalid", "GPS coordinate is unreadable or out of range"),
        _diagnostic(~has_gps, "photo.gps_missing", "No GPS tags are present"),
        _diagnostic(~F.col("has_exif"), "photo.exif_missing", "No tags are present"),
        _diagnostic(conflict, "photo.capture_time_conflict", "Original and digitised times differ"),
        _diagnostic(dated & moment.isNull(), "photo.capture_time_invalid", "Time or offset is invalid"),
        _diagnostic(original.isNotNull() & offset.isNull() & ~conflict,
                    "photo.timezone_missing", "Original time has no offset"),
        _diagnostic(original.isNull(), "photo.capture_time_missing", "Original time is absent"),
        _diagnostic(make.isNull() & model.isNull(), "photo.camera_missing", "Camera make and model are absent"),
    )
    typed = records.select(
        *records.columns,
        original.alias("_original"), digitized.alias("_digitized"), offset.alias("_offset"),
        make.alias("_make"), model.alias("_model"),
        F.when(gps_ok, latitude).alias("latitude"), F.when(gps_ok, longitude).alias("longitude"),
        moment.alias("occurred_at"), diagnostics.alias("diagnostics"),
    )
    document = canonical_json(
        F.struct(F.col("_make").alias("make"), F.col("_model").alias("model")).alias("camera"),
        F.col("_digitized").alias("date_time_digitized"),
        F.col("_original").alias("date_time_original"),
        F.struct("height", "width").alias("dimensions"),
        F.when(F.col("latitude").isNotNull(), F.struct("latitude", "longitude")).alias("gps"),
        F.lit("photo").alias("kind"),
        F.col("orientation"),
        F.col("_offset").alias("timezone_offset"),
    )
    return typed.select(
        *records.columns, "latitude", "longitude", "occurred_at",
        F.when(F.col("occurred_at").isNotNull(), F.lit("exif.DateTimeOriginal+OffsetTimeOriginal")).alias("occurred_at_source"),
        F.when(F.size("diagnostics") > 0, "partial").otherwise("complete").alias("status"),
        "diagnostics", document.alias("metadata_json"), F.lit(PHOTO_EXTRACTOR).alias("extractor_id"),
    )


def video_metadata(records: DataFrame) -> DataFrame:
    """Normalise track maps (``general``, ``video``).

    All embedded dates must agree on one zoned instant; coordinates come from the first
    location-like key that parses. A width or height that is no whole number fails the
    record.
    """
    general, video = F.col("general"), F.col("video")
    candidates = F.filter(
        F.array(*[
            F.struct(F.lit(key).alias("key"), clean(F.try_element_at(general, F.lit(key))).alias("raw"))
            for key in DATE_KEYS
        ]),
        lambda item: item["raw"].isNotNull(),
    )
    parsed = F.filter(
        F.transform(F.col("_dates"), lambda item: F.struct(item["key"].alias("key"), video_datetime(item["raw"]).alias("iso"))),
        lambda item: item["iso"].isNotNull(),
    )
    located = F.filter(
        F.transform(
            F.filter(
                F.map_entries(general),
                lambda entry: F.lower(entry["key"]).rlike("location|gps") & clean(entry["value"]).isNotNull(),
            ),
            lambda entry: F.struct(entry["value"].alias("raw"), iso6709(entry["value"]).alias("place")),
        ),
        lambda item: item["place"].isNotNull(),
    )
    width = F.try_element_at(video, F.lit("width"))
    height = F.try_element_at(video, F.lit("height"))
    broken = F.lit(False)
    for size in (width, height):
        broken = broken | F.coalesce((size != "") & ~size.rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False))
    duration = F.try_element_at(general, F.lit("duration"))

    step = records.withColumn("_dates", candidates)
    step = step.withColumn("_parsed", parsed).withColumn("_place", F.try_element_at(located, F.lit(1)))
    instants = F.array_distinct(F.col("_parsed")["iso"])
    one = F.size(instants) == 1
    seconds = milliseconds_to_seconds(duration)
    failed = F.array(F.struct(
        F.lit("video.extraction_failed").alias("code"), F.lit("ValueError: dimension is not a whole number").alias("detail")
    ))
    diagnostics = _diagnostics(
        _diagnostic(F.size(instants) > 1, "video.creation_time_conflict", "Embedded creation times differ"),
        _diagnostic((F.size(instants) == 0) & (F.size("_dates") > 0),
                    "video.creation_timezone_missing", "Embedded creation time has no zone"),
        _diagnostic(F.size("_dates") == 0, "video.creation_time_missing", "No embedded creation time is present"),
        _diagnostic(F.col("_place").isNull(), "video.gps_missing", "No supported GPS metadata is present"),
        _diagnostic(F.size(video) <= 0, "video.track_missing", "No video track is present"),
        _diagnostic(duration.isNotNull() & seconds.isNull(), "video.duration_invalid", "Duration is not numeric"),
    )
    raw_dates = F.array_distinct(F.col("_dates")["raw"])
    whole = lambda size: F.when(size != "", F.trim(size).try_cast("int"))
    document = canonical_json(
        F.struct(clean(F.try_element_at(video, F.lit("codec_id"))).alias("codec_id"),
                 clean(F.try_element_at(video, F.lit("format"))).alias("format")).alias("codec"),
        F.struct(clean(F.try_element_at(general, F.lit("codec_id"))).alias("codec_id"),
                 clean(F.try_element_at(general, F.lit("format"))).alias("format"),
                 clean(F.try_element_at(general, F.lit("internet_media_type"))).alias("mime_type"),
                 clean(F.try_element_at(general, F.lit("format_profile"))).alias("profile")).alias("container"),
        F.try_element_at(raw_dates, F.lit(1)).alias("creation_time"),
        raw_dates.alias("creation_time_candidates"),
        F.struct(whole(height).alias("height"), whole(width).alias("width")).alias("dimensions"),
        seconds.alias("duration_seconds"),
        F.col("_place.place").alias("gps"),
        F.col("_place.raw").alias("gps_raw"),
        F.lit("video").alias("kind"),
    )
    bare = canonical_json(F.lit("video").alias("kind"))
    usable = ~broken
    return step.select(
        *records.columns,
        F.when(usable, F.col("_place.place.latitude")).alias("latitude"),
        F.when(usable, F.col("_place.place.longitude")).alias("longitude"),
        F.when(usable, seconds).alias("duration_seconds"),
        F.when(usable, whole(width)).alias("width"),
        F.when(usable, whole(height)).alias("height"),
        F.when(usable & one, instants[0]).alias("occurred_at"),
        F.when(usable & one, F.concat(F.lit("mediainfo."), F.col("_parsed")[0]["key"])).alias("occurred_at_source"),
        F.when(broken, "failed").when(F.size(diagnostics) > 0, "partial").otherwise("complete").alias("status"),
        F.when(broken, failed).otherwise(diagnostics).alias("diagnostics"),
        F.when(broken, bare).otherwise(document).alias("metadata_json"),
        F.lit(VIDEO_EXTRACTOR).alias("extractor_id"),
    )


def metadata_targets(objects: DataFrame, attachments: DataFrame) -> DataFrame:
    """Objects metadata can be extracted from: photos and videos that have content."""
    wanted = objects.filter(F.col("object_type").isin("photo", "video"))
    return wanted.join(attachments.select("object_id", "blob_id"), "object_id", "inner")


def project_metadata(
    targets: DataFrame, normalised: DataFrame, stored: DataFrame, ids: IdSpace = DEFAULT_IDS
) -> DataFrame:
    """New extraction rows for targets not extracted yet from their present content.

    ``targets`` has ``object_id, blob_id, content_hash, occurred_at``; ``normalised`` the
    output of the functions above by ``object_id``. A derived time that contradicts a
    known one is dropped with a diagnostic. ``backfill`` tells where the object had none.
    """
    canonical = targets.select("object_id", "blob_id", "content_hash", F.col("occurred_at").alias("known_at"))
    joined = canonical.join(normalised, "object_id", "inner").withColumn(
        "extraction_id", ids.extraction_id(F.col("object_id"), F.col("blob_id"), F.col("extractor_id"))
    )
    pending = joined.join(stored.select("extraction_id"), "extraction_id", "left_anti")
    clash = F.coalesce(F.col("occurred_at") != F.col("known_at"), F.lit(False))
    note = F.array(F.struct(
        F.lit("canonical.occurred_at_conflict").alias("code"),
        F.lit("Derived time conflicts with the known time").alias("detail"),
    ))
    kept = F.when(~clash, F.col("occurred_at"))
    return pending.select(
        "extraction_id", "object_id", "blob_id", "content_hash", "extractor_id",
        F.when(clash, "partial").otherwise(F.col("status")).alias("status"),
        "metadata_json",
        kept.alias("occurred_at"),
        F.when(~clash, F.col("occurred_at_source")).alias("occurred_at_source"),
        F.when(kept.isNotNull(), "high").otherwise("none").alias("occurred_at_confidence"),
        F.when(clash, F.concat(F.col("diagnostics"), note)).otherwise(F.col("diagnostics")).alias("diagnostics"),
        (kept.isNotNull() & F.col("known_at").isNull()).alias("backfill"),
    )


def metadata_diagnostics(extractions: DataFrame) -> DataFrame:
    """One row per distinct diagnostic of an extraction."""
    rows = extractions.select(
        "extraction_id", F.explode(F.array_distinct("diagnostics")).alias("item")
    )
    severity = F.when(F.col("item.code").endswith(".extraction_failed"), "error").otherwise("warning")
    return rows.select("extraction_id", severity.alias("severity"), "item.code", "item.detail")


def backfill_times(objects: DataFrame, extractions: DataFrame) -> DataFrame:
    """Objects with the time read: the known one, else the derived one."""
    derived = latest(
        extractions.filter("backfill"), ["object_id"], F.col("extraction_id"), ["occurred_at"]
    ).withColumnRenamed("occurred_at", "occurred_at_derived")
    joined = objects.join(derived, "object_id", "left")
    return joined.withColumn("occurred_at", F.coalesce("occurred_at", "occurred_at_derived")).drop("occurred_at_derived")


def backfill_versions(versions: DataFrame, extractions: DataFrame) -> DataFrame:
    """Versions with the time read from their own content: where they know one, that one stays.

    Versions of other contents of the object learn nothing.
    """
    key = ["object_id", "content_hash"]
    derived = latest(extractions.filter("backfill"), key, F.col("extraction_id"), ["occurred_at"]).withColumnRenamed("occurred_at", "_derived")
    joined = versions.join(derived, key, "left").withColumn("occurred_at", F.coalesce("occurred_at", "_derived"))
    return joined.select(*versions.columns)


def latest_metadata(extractions: DataFrame) -> DataFrame:
    """Newest extraction per object, ties broken by the greater id."""
    columns = [name for name in extractions.columns if name != "object_id"]
    return latest(extractions, ["object_id"], F.struct("extracted_at", "extraction_id"), columns)


def diagnostic_category(code: Column) -> Column:
    return (
        F.when(code.endswith(".extraction_failed"), "extractor_error")
        .when(code.endswith("_missing"), "missing_metadata")
        .when(code.endswith("_invalid"), "invalid_metadata")
        .when(code.endswith("_conflict"), "conflicting_metadata")
        .otherwise("metadata_warning")
    )


def group_status(group: str, codes: Column, metadata_json: Column) -> Column:
    """State of one field group: the worst diagnostic decides, else whether it has a value."""
    field = lambda path: F.coalesce(F.get_json_object(metadata_json, path), F.lit(""))
    has_code = lambda suffix: F.exists(codes, lambda code: code.contains(group) & code.endswith(suffix))
    if group == "capture_time":
        found = (field("$.date_time_original") != "") | (field("$.date_time_digitized") != "") | (field("$.creation_time") != "")
    elif group == "camera":
        found = (field("$.camera.make") != "") | (field("$.camera.model") != "")
    elif group == "dimensions":
        found = (field("$.dimensions.width") != "") & (field("$.dimensions.height") != "")
    else:
        found = field(f"$.{group}") != ""
    status = (
        F.when(F.exists(codes, lambda code: code.endswith(".extraction_failed")), "error")
        .when(has_code("_conflict"), "conflict")
        .when(has_code("_invalid"), "invalid")
        .when(has_code("_missing"), "missing")
    )
    if group == "capture_time":
        status = status.when(F.array_contains(codes, "photo.timezone_missing"), "partial")
    return status.when(found, "found").otherwise("missing")


def diagnostic_summary(objects: DataFrame, extractions: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Why the latest metadata of each object is what it is, without any values."""
    newest = latest_metadata(extractions)
    # Codes form a small fixed set, so the set per extraction is bounded.
    per_extraction = diagnostics.groupBy("extraction_id").agg(
        F.array_sort(F.collect_set("code")).alias("codes"),
        F.min(F.when(F.col("code").endswith(".extraction_failed"), F.col("detail"))).alias("failure"),
    )
    joined = (
        objects.select("object_id")
        .join(newest, "object_id", "left")
        .join(per_extraction, "extraction_id", "left")
        .withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    )
    categories = F.array_distinct(F.transform("codes", diagnostic_category))
    optional_only = F.size(F.array_except(categories, F.array(F.lit("missing_metadata"), F.lit("metadata_warning")))) == 0
    category = F.when(F.array_contains(categories, "extractor_error"), "extractor_error").when(
        F.col("status") == "partial",
        F.when((F.size(categories) > 0) & optional_only, "missing_optional_metadata").otherwise("metadata_quality_issue"),
    )
    extracted = F.col("extraction_id").isNotNull()
    return joined.select(
        "object_id",
        F.col("extractor_id").alias("extractor"),
        F.coalesce("status", F.lit("missing")).alias("status"),
        category.alias("error_category"),
        error_name(F.col("failure")).alias("error_type"),
        *[
            F.when(extracted, group_status(group, F.col("codes"), F.col("metadata_json"))).alias(f"{group}_status")
            for group in GROUPS
        ],
        F.when(extracted, F.array_join("codes", ",")).alias("codes"),
    )
