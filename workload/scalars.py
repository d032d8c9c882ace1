"""Identity, time, text and redaction functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import redact, text, timegeo
from keepsake.functions.ids import DEFAULT_IDS, canonical_json_hash, identity_hint

from .dialects import blob_id, object_id
from .fragments import DUCK, ISO, clean, collapse, iso_us, norm, quoted, slug, toks
from .registry import query
from .views import load

P = DEFAULT_IDS.prefix


@query("object_ids", f"SELECT doc_id, {object_id(DUCK, 'source', 'CAST(doc_id AS VARCHAR)')} AS object_id FROM documents")
def object_ids(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", DEFAULT_IDS.object_id(F.col("source"), F.col("doc_id").cast("string")).alias("object_id"))


@query("relation_ids", f"""SELECT o_orderkey, '{P}_rel_' || {DUCK.uuid("('relation:placed_by:' || CAST(o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR))")} AS relation_id FROM orders""")
def relation_ids(spark, d):
    orders = load(spark, d, "orders")
    return orders.select("o_orderkey", DEFAULT_IDS.relation_id(
        F.lit("placed_by"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("relation_id"))


@query("blob_ids", f"SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {blob_id('sha256(text)')} END AS blob_id FROM documents")
def blob_ids(spark, d):
    digest = F.sha2("text", 256)
    given = F.when(F.col("doc_id") % 9 == 0, F.upper(F.substring(digest, 1, 60))).otherwise(digest)
    return load(spark, d, "documents").select("doc_id", DEFAULT_IDS.blob_id(given).alias("blob_id"))


@query("location_ids", f"""SELECT page_id, '{P}_loc_' || {DUCK.uuid("('location:' || CAST(page_id AS VARCHAR) || ':' || url)")} AS location_id FROM pages""")
def location_ids(spark, d):
    return load(spark, d, "pages").select(
        "page_id", DEFAULT_IDS.location_id(F.col("page_id").cast("string"), F.col("url")).alias("location_id"))


@query("semantic_result_ids", f"""SELECT object_id, '{P}_sem_' || {DUCK.uuid("('semantic:' || object_id || ':text_normalization:1.0.0:text_normalization:' || content_hash || ':' || CASE WHEN object_type IN ('photo','video','audio') THEN 'kps_blob_' || content_hash ELSE '' END)")} AS semantic_result_id FROM v_objects""", views=("v_objects",))
def semantic_result_ids(spark, d):
    name = F.lit("text_normalization")
    blob = F.when(F.col("object_type").isin("photo", "video", "audio"), DEFAULT_IDS.blob_id(F.col("content_hash")))
    return load(spark, d, "v_objects").select("object_id", DEFAULT_IDS.result_id(
        F.col("object_id"), name, F.lit("1.0.0"), name, F.col("content_hash"), blob).alias("semantic_result_id"))


@query("json_hash", "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}') AS json_hash FROM events")
def json_hash(spark, d):
    spaced = F.concat(F.lit('{ "type" : "'), "event_type", F.lit('" , "k": '), F.get_json_object("props", "$.k"), F.lit(" }"))
    return load(spark, d, "events").select("event_id", canonical_json_hash(spaced).alias("json_hash"))


@query("pseudonymize", "SELECT event_id, substring(sha256('user-' || CAST(user_id AS VARCHAR)), 1, 24) AS principal_hash, substring(sha256(event_type), 1, 12) AS identity_hint FROM events")
def pseudonymize(spark, d):
    return load(spark, d, "events").select(
        "event_id", identity_hint(F.concat(F.lit("user-"), F.col("user_id").cast("string")), 24).alias("principal_hash"),
        identity_hint(F.col("event_type")).alias("identity_hint"))


@query("dq_id_shape", f"SELECT source_id, regexp_full_match(object_id, '{P}_obj_[0-9a-f]{{32}}') AS well_formed FROM v_stored", views=("v_stored",))
def dq_id_shape(spark, d):
    return load(spark, d, "v_stored").select("source_id", DEFAULT_IDS.is_object_id(F.col("object_id")).alias("well_formed"))


@query("unix_to_iso", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE
  strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t) % 1000000 = 0 THEN '' ELSE strftime(t, '.%f') END || '+00:00' END AS iso
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE date_trunc('milliseconds', ts) END AS t FROM events) e""")
def unix_to_iso(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    step = F.when(F.col("event_id") % 3 == 0, 1_000_000).otherwise(1_000)
    seconds = (micros - micros % step) / 1_000_000
    given = F.when(F.col("event_id") % 10 == 0, F.lit("soon")).otherwise(F.format_string("%.3f", seconds))
    return load(spark, d, "events").select("event_id", timegeo.unix_to_iso(given).alias("iso"))


@query("time_range_filter", f"""SELECT ordinal FROM v_items1
WHERE {iso_us('coalesce(occurred_at, captured_at)')} BETWEEN epoch_us(TIMESTAMPTZ '2024-03-01T00:00:00+00:00') AND epoch_us(TIMESTAMPTZ '2024-06-10T00:00:00+02:00')""", views=("v_items1",))
def time_range_filter(spark, d):
    when = F.coalesce("occurred_at", "captured_at")
    return load(spark, d, "v_items1").filter(
        timegeo.in_time_range(when, F.lit("2024-03-01T00:00:00Z"), F.lit("2024-06-10T00:00:00+02:00"))
    ).select("ordinal")


@query("iso6709_parse", r"""SELECT event_id, CASE WHEN ok THEN la END AS latitude, CASE WHEN ok THEN lo END AS longitude FROM (
SELECT event_id, la, lo, coalesce(la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180, false) AS ok FROM (
SELECT event_id, try_cast(regexp_extract(location, '([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)', 1) AS DOUBLE) AS la,
 try_cast(regexp_extract(location, '([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)', 2) AS DOUBLE) AS lo FROM v_tracks) t) u""", views=("v_tracks",))
def iso6709_parse(spark, d):
    place = timegeo.iso6709(F.col("location"))
    return load(spark, d, "v_tracks").select("event_id", place["latitude"].alias("latitude"), place["longitude"].alias("longitude"))


@query("uri_to_path", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/data/My Photos+é/' || CAST(page_id AS VARCHAR) || '.jpg'
  WHEN 1 THEN '//nas/share/' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'C:/Fotos/' || CAST(page_id AS VARCHAR) || '.jpg' ELSE NULL END AS path FROM pages""")
def uri_to_path(spark, d):
    number = F.col("page_id").cast("string")
    uri = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("file:///data/My%20Photos+%C3%A9/"), number, F.lit(".jpg")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("file://nas/share/"), number))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("file:///C:/Fotos/"), number, F.lit(".jpg")))
        .otherwise(F.col("url"))
    )
    return load(spark, d, "pages").select("page_id", timegeo.uri_to_path(uri).alias("path"))


@query("normalize_text", f"SELECT doc_id, {norm('text')} AS normal FROM documents")
def normalize_text(spark, d):
    return load(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query("query_tokens", f"SELECT item_id, array_to_string({toks('text')}, ' ') AS tokens FROM benchmark")
def query_tokens(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query("alias_match", f"""SELECT doc_id, contains(' ' || n, ' licen') AS starts_licen, contains(' ' || n || ' ', ' this is ') AS has_phrase, contains(' ' || n, ' from') AS starts_from
FROM (SELECT doc_id, {norm('text')} AS n FROM documents) t""")
def alias_match(spark, d):
    normal = text.normalize(F.col("text"))
    return load(spark, d, "documents").select(
        "doc_id", text.contains_alias(normal, F.lit("licen")).alias("starts_licen"),
        text.contains_alias(normal, F.lit("this is")).alias("has_phrase"),
        text.contains_alias(normal, F.lit("from")).alias("starts_from"))


@query("json_decode", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_decode(spark, d):
    given = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.col("props"))
    default = F.struct(F.lit(-1).cast("long").alias("k"))
    return load(spark, d, "events").select("event_id", F.coalesce(text.decode_json(given, "k bigint", default)["k"], F.lit(-1)).cast("long").alias("k"))


@query("snippets", f"""SELECT semantic_result_id, CASE WHEN coalesce(result_text, '') <> '' THEN substring({collapse('result_text')}, 1, 320)
  WHEN semantic_type = 'detected_objects' THEN 'detected objects: ' || json_extract_string(result_json, '$.detections[0].label') || ', tree'
  WHEN semantic_type = 'detected_places' THEN 'place candidates: ' || CAST(json_extract(result_json, '$.candidates') AS VARCHAR)
  ELSE substring(result_json, 1, 320) END AS snippet FROM v_results""", views=("v_results",))
def snippets(spark, d):
    return load(spark, d, "v_results").select(
        "semantic_result_id", text.snippet(F.col("result_text"), F.col("result_json"), F.col("semantic_type")).alias("snippet"))


@query("slugs", f"SELECT item_id, {slug('''split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || '_ ' || CASE WHEN item_id % 4 = 0 THEN 'Знак' ELSE '' END''')} AS slug, {slug('''CASE WHEN item_id % 2 = 0 THEN 'Снег' ELSE 'Red car!' END''')} AS label_slug FROM benchmark")
def slugs(spark, d):
    words = F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(2)), F.lit("_ "),
                     F.when(F.col("item_id") % 4 == 0, F.lit("Знак")).otherwise(F.lit("")))
    label = F.when(F.col("item_id") % 2 == 0, F.lit("Снег")).otherwise(F.lit("Red car!"))
    return load(spark, d, "benchmark").select("item_id", text.slug(words).alias("slug"), text.slug(label).alias("label_slug"))


SEEDED = r"""text || CASE doc_id % 4 WHEN 0 THEN ' see file:///home/me/a.txt and more' WHEN 1 THEN chr(10) || 'at C:\Users\me\x.png end' || chr(10) || 'next' WHEN 2 THEN ' in album/2024/img.jpg ok' ELSE '' END"""


def seeded():
    """Document texts with local paths planted in them."""
    n = F.col("doc_id") % 4
    return F.concat("text", F.when(n == 0, " see file:///home/me/a.txt and more").when(n == 1, "\nat C:\\Users\\me\\x.png end\nnext")
                    .when(n == 2, " in album/2024/img.jpg ok").otherwise(""))


@query("redact_paths", rf"""SELECT doc_id, regexp_replace(regexp_replace({SEEDED}, 'file:///[^\s"'']+', '[local-path-redacted]', 'g'), '(?i)\b[a-z]:[\\/][^\r\n]*', '[local-path-redacted]', 'g') AS safe FROM documents""")
def redact_paths(spark, d):
    return load(spark, d, "documents").select("doc_id", redact.redact_paths(seeded()).alias("safe"))


@query("redact_keys", """SELECT event_id, '{"deep":[{"keep":' || json_extract_string(props, '$.k') || '}],"kind":"' || event_type || '"}' AS safe,
  'kind=' || event_type || ',note=[local-path-redacted]' AS safe_map FROM events""")
def redact_keys(spark, d):
    k = F.get_json_object("props", "$.k")
    document = F.concat(F.lit('{"deep":[{"keep":'), k, F.lit(',"Access_Token":"x"}],"raw_path":{"a":1},"kind":"'), "event_type", F.lit('","my_secret_id":2,"home_uri":null}'))
    flat = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("note"), F.lit("file:///tmp/x"), F.lit("raw_uri"), F.lit("r"), F.lit("TOKEN"), F.lit("t"))
    safe = F.transform(F.array_sort(F.map_entries(redact.redact_map(flat))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return load(spark, d, "events").select("event_id", redact.drop_sensitive_keys(document).alias("safe"), F.array_join(safe, ",").alias("safe_map"))


@query("leak_scan", """SELECT event_id, event_id % 6 IN (0, 1, 2, 4) AS client, event_id % 6 IN (0, 1, 2, 3) AS gateway, event_id % 6 IN (1, 2, 3, 4) AS smoke FROM events""")
def leak_scan(spark, d):
    n = F.col("event_id") % 6
    document = (
        F.when(n == 0, '{"a":[{"home_path":"x"}]}').when(n == 1, '{"a":"see file:///x"}').when(n == 2, '{"a":{"b":"C:\\\\tmp"}}')
        .when(n == 3, '{"a":"in SQLite"}').when(n == 4, '{"csrf_token":"1"}').otherwise(F.concat(F.lit('{"tokenless \\" value":'), F.lit('0}')))
    )
    document = F.when(n == 5, F.concat(F.lit('{"a":"token : path_uri","b":'), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(document)
    return load(spark, d, "events").select("event_id", *[redact.leaks(document, rules).alias(rules) for rules in ("client", "gateway", "smoke")])


@query("error_category", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'validation_error' WHEN 2 THEN 'OSError' WHEN 3 THEN event_type ELSE 'My2Exception' END AS category,
  CASE event_id % 5 WHEN 2 THEN 'OSError' WHEN 4 THEN 'My2Exception' END AS error_name FROM events""")
def error_category(spark, d):
    n = F.col("event_id") % 5
    given = (
        F.when(n == 1, F.lit(": no head")).when(n == 2, F.lit("OSError: disk: full"))
        .when(n == 3, F.concat("event_type", F.lit(": text"))).when(n == 4, F.lit("My2Exception"))
    )
    return load(spark, d, "events").select("event_id", redact.error_category(given).alias("category"), redact.error_name(given).alias("error_name"))


@query("content_digest", """SELECT source_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE octet_length(encode(text)) END AS byte_size,
  CASE WHEN doc_id % 12 = 5 THEN 'content is required when raw_uri is not a file URI' WHEN doc_id % 12 = 11 THEN 'file not found' END AS error
FROM (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS source_id, doc_id, text FROM documents) t""")
def content_digest(spark, d):
    from keepsake.sources.content import content_digest as digest_items

    docs, n = load(spark, d, "documents"), F.col("doc_id") % 12
    number = F.col("doc_id").cast("string")
    uri = F.when(n == 5, F.concat(F.lit("https://x/"), number)).otherwise(F.concat(F.lit("file:///vault/"), number))
    items = docs.select(
        F.concat(F.lit("doc-"), number).alias("source_id"), uri.alias("raw_uri"),
        F.when(F.col("doc_id") % 6 < 3, F.encode("text", "UTF-8")).alias("content"))
    files = docs.filter("doc_id % 6 IN (3, 4)").select(F.concat(F.lit("/vault/"), number).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return digest_items(items, files).select("source_id", "sha256", "byte_size", "error")
