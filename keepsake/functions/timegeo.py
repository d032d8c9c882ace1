"""Dates with offsets, coordinates, durations and file URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)
OFFSET_PATTERN = r"\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"
ISO6709_PATTERN = r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _micros(local: Column) -> Column:
    """Microseconds of ``yyyy-MM-dd HH:mm:ss[.f]`` read as UTC; null when no such time."""
    return F.unix_micros(F.concat(local, F.lit("Z")).try_cast("timestamp"))


def _offset_minutes(offset: Column) -> Column:
    digits = F.replace(F.substring(offset, 2, 5), F.lit(":"), F.lit(""))
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    return (
        F.when(offset.isin("", "Z"), F.lit(0))
        .when(offset.startswith("-"), -minutes)
        .otherwise(minutes)
    )


def _offset_text(minutes: Column) -> Column:
    size = F.abs(minutes)
    return F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def _local_iso(micros: Column) -> Column:
    moment = F.timestamp_micros(micros)
    text = F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$", "")


def unix_to_iso(seconds: Column) -> Column:
    """Unix seconds, number or numeric text, to UTC ISO text; anything else is null."""
    value = seconds.try_cast("double")
    usable = value.between(-62135596800.0, 253402300799.999999)
    micros = F.rint(F.when(usable, value) * 1_000_000).cast("long")
    return F.concat(_local_iso(micros), F.lit("+00:00"))


def has_offset(text: Column) -> Column:
    return F.coalesce(text.rlike(OFFSET_PATTERN), F.lit(False))


def iso_micros(text: Column) -> Column:
    """Instant of ISO text in microseconds; text without an offset is read as UTC.

    Offsets go up to 18 hours, which covers every zone there is.
    """
    zoned = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    complete = (
        F.when(text.rlike(OFFSET_PATTERN), zoned)
        .when(F.char_length(text) == 10, F.concat(text, F.lit("T00:00:00Z")))
        .otherwise(F.concat(zoned, F.lit("Z")))
    )
    return F.unix_micros(F.when(text.rlike(ISO_PATTERN), complete).try_cast("timestamp"))


def iso_text(text: Column) -> Column:
    """The same instant in one spelling, with its own offset kept; null without offset."""
    minutes = _offset_minutes(F.regexp_extract(text, OFFSET_PATTERN, 1))
    local = iso_micros(text) + minutes.cast("long") * 60_000_000
    return F.when(has_offset(text), F.concat(_local_iso(local), _offset_text(minutes)))


def timestamp_error(text: Column, field: str, required: bool) -> Column:
    """Named reason why a provider timestamp is unusable, else null."""
    empty = F.lit(f"invalid:{field}") if required else F.lit(None).cast("string")
    return (
        F.when(text.isNull(), empty)
        .when(iso_micros(text).isNull(), F.lit(f"invalid:{field}"))
        .when(~has_offset(text), F.lit(f"no_timezone:{field}"))
    )


def in_time_range(value: Column, start: Column, end: Column) -> Column:
    """Inclusive range test; unreadable times are outside any given range.

    So is a time that has an offset where the bound has none, or the other way round.
    """
    current = iso_micros(value)

    def bound(limit: Column, name: str, passes: Column) -> Column:
        return (
            F.when(limit.isNull(), F.lit(True))
            .when(iso_micros(limit).isNull(), F.raise_error(F.concat(F.lit(f"invalid {name}: "), limit)).cast("boolean"))
            .when(current.isNull() | (has_offset(limit) != has_offset(value)), F.lit(False))
            .otherwise(passes)
        )

    return bound(start, "time_from", current >= iso_micros(start)) & bound(
        end, "time_to", current <= iso_micros(end)
    )


def exif_datetime(value: Column, offset: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` with ``±HH:MM`` to ISO text; null when either is invalid."""
    pattern = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$"
    local = F.regexp_replace(value, pattern, "$1-$2-$3 $4")
    minutes = _offset_minutes(offset)
    usable = value.rlike(pattern) & offset.rlike(r"^[+-]\d{2}:\d{2}$") & (F.abs(minutes) < 1440)
    return F.when(usable, F.concat(_local_iso(_micros(local)), _offset_text(minutes)))


def video_datetime(value: Column) -> Column:
    """Container date in its usual spellings to ISO text; null when it has no zone."""
    text = F.trim(value)
    marked_utc = text.startswith("UTC ") | text.endswith(" UTC") | text.endswith("Z")
    bare = F.regexp_replace(F.regexp_replace(text, "^UTC ", ""), "( UTC|Z)$", "")
    plain = bare.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$")
    micros = _micros(F.when(plain, bare))
    return (
        F.when(micros.isNotNull() & marked_utc, F.concat(_local_iso(micros), F.lit("+00:00")))
        .when(micros.isNotNull(), F.lit(None).cast("string"))
        .otherwise(iso_text(value))
    )


def rationals(pairs: Column) -> Column:
    """``array<struct<num,den>>`` to ``array<double>``; a zero denominator gives null."""
    return F.transform(pairs, lambda pair: F.try_divide(pair["num"].cast("double"), pair["den"].cast("double")))


def gps_coordinate(degrees: Column, reference: Column) -> Column:
    """Degrees, minutes, seconds to signed decimal degrees with 8 digits."""
    value = degrees[0] + degrees[1] / 60 + degrees[2] / 3600
    signed = F.when(F.trim(reference).isin("S", "W"), -value).otherwise(value)
    return F.when(F.size(degrees) == 3, F.round(signed, 8))


def valid_coordinate(latitude: Column, longitude: Column) -> Column:
    return F.coalesce(latitude.between(-90, 90) & longitude.between(-180, 180), F.lit(False))


def iso6709(text: Column) -> Column:
    """First ``±lat±lon`` in the text as a struct, null when absent or out of range."""
    latitude = _part(text, ISO6709_PATTERN, 1).try_cast("double")
    longitude = _part(text, ISO6709_PATTERN, 2).try_cast("double")
    return F.when(
        valid_coordinate(latitude, longitude),
        F.struct(latitude.alias("latitude"), longitude.alias("longitude")),
    )


def milliseconds_to_seconds(text: Column) -> Column:
    return text.try_cast("double") / 1000


def uri_to_path(uri: Column) -> Column:
    """Local path of a ``file:`` URI (percent-decoded, host and drive kept), else null."""
    pattern = r"(?i)^file:(?://([^/?#]*))?([^?#]*)"
    raw = _part(uri, pattern, 2)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    host = _part(uri, pattern, 1)
    path = F.when(host == "", decoded).otherwise(F.concat(F.lit("//"), host, decoded))
    return F.when(uri.rlike("(?i)^file:"), F.regexp_replace(path, "^/(.:)", "$1"))
