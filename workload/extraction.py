"""Extractor outputs, dispatch, runs, the current projection and status roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.ids import DEFAULT_IDS
from keepsake.operators import extractors as x
from keepsake.plans.photos import photo_context, run_photo_projections

from .fragments import DUCK, collapse, quoted
from .registry import query
from .views import load

P = DEFAULT_IDS.prefix


def unpacked(out):
    return [out["status"].alias("status"), out["confidence"].alias("confidence"), out["result_text"].alias("result_text"),
            F.array_join(out["diagnostics"], ",").alias("diagnostics")]


@query("text_normalization", f"SELECT doc_id, {collapse('text')} AS result_text, CAST(length({collapse('text')}) AS INT) AS character_count, 'complete' AS status FROM documents")
def text_normalization(spark, d):
    out = load(spark, d, "documents").select("doc_id", x.normalize_text_output().alias("out"))
    return out.select("doc_id", F.col("out.result_text"), F.get_json_object("out.result_json", "$.character_count").cast("int").alias("character_count"), F.col("out.status"))


@query("caption_normalize", f"""SELECT page_id, CASE WHEN c = '' THEN 'partial' ELSE 'complete' END AS status, CAST(NULL AS DOUBLE) AS confidence, c AS result_text,
 CASE WHEN c = '' THEN 'caption_empty,' ELSE '' END || 'model_confidence_unavailable' AS diagnostics FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '' ELSE {collapse("coalesce(regexp_extract(html, '<title>([^<]*)', 1), '')")} END AS c FROM pages) t""")
def caption_normalize(spark, d):
    caption = F.when(F.col("page_id") % 18 == 0, F.lit(" \n ")).when(F.col("page_id") % 9 != 0, F.regexp_extract("html", "<title>([^<]*)", 1))
    rows = load(spark, d, "pages").withColumn("caption", caption).withColumn("runtime", F.lit("{}"))
    return rows.select("page_id", x.caption_output().alias("out")).select("page_id", *unpacked(F.col("out")))


def vision(spark, d):
    """Model answers in the shape the normalisers take."""
    rows = load(spark, d, "v_boxes")
    labels = F.array("label_a", "label_b", "label_c")
    scores = F.array("score_a", "score_b", "score_c")
    box = F.array("x", "y", "x2", "y2")
    quads = F.array(F.concat(box, box), F.concat(box, box))
    return rows.select(
        "image_id", "width", "height", F.lit("{}").alias("runtime"),
        F.struct(labels.alias("labels"), F.array(box, F.array("x", "y")).alias("bboxes"), scores.alias("scores")).alias("objects"),
        F.struct(labels.alias("labels"), quads.alias("quad_boxes"), scores.alias("scores")).alias("ocr"))


LA, LB, LC = collapse("label_a"), collapse("label_b"), "label_c"
MEAN = lambda parts: f"round(list_avg(list_filter([{parts}], lambda s: s IS NOT NULL)), 6)"


@query("ocr_normalize", f"""SELECT image_id, 'complete' AS status, {MEAN('score_a, score_b, score_c')} AS confidence, {LA} || chr(10) || CASE WHEN {LB} <> '' THEN {LB} || chr(10) ELSE '' END || {LC} AS result_text, '' AS diagnostics,
 CAST(CASE WHEN {LB} <> '' THEN 3 ELSE 2 END AS INT) AS n_regions, round(score_c, 6) AS last_score FROM v_boxes""", views=("v_boxes",))
def ocr_normalize(spark, d):
    out = vision(spark, d).select("image_id", x.ocr_output().alias("out"))
    regions = F.from_json("out.result_json", "regions array<struct<confidence double, text string>>")["regions"]
    return out.select("image_id", *unpacked(F.col("out")), F.size(regions).alias("n_regions"), F.element_at(regions, -1)["confidence"].alias("last_score"))


@query("detection_normalize", f"""SELECT image_id, label, CASE WHEN pos = 1 THEN round(x, 3) END AS left_side, CASE WHEN pos = 1 THEN round(round(y2, 3) / height, 6) END AS bottom_relative, round(score, 6) AS confidence FROM (
SELECT *, 1 AS pos, {LA} AS label, score_a AS score FROM v_boxes UNION ALL SELECT *, 2, {LB}, score_b FROM v_boxes UNION ALL SELECT *, 3, {LC}, score_c FROM v_boxes) t WHERE label <> ''""", views=("v_boxes",))
def detection_normalize(spark, d):
    found = x.detections(F.col("objects"), F.col("width"), F.col("height"))
    rows = vision(spark, d).select("image_id", F.explode(found).alias("item"))
    return rows.select("image_id", "item.label", F.col("item.bbox")[0].alias("left_side"), F.col("item.bbox_normalized")[3].alias("bottom_relative"), "item.confidence")


SLUG_OF = "CASE label WHEN 'Street sign' THEN 'street-sign' WHEN 'Снег 7' THEN '7' ELSE label END"


@query("detection_mentions", f"""SELECT image_id, 'semantic_mentions_entity' AS relation_type, 'object:' || {SLUG_OF} AS target_ref, round(score, 6) AS confidence FROM (
SELECT image_id, label, score, pos, row_number() OVER (PARTITION BY rid, label ORDER BY pos) AS nth FROM (
SELECT rid, image_id, 1 AS pos, {LA} AS label, score_a AS score FROM b UNION ALL SELECT rid, image_id, 2, {LB}, score_b FROM b UNION ALL SELECT rid, image_id, 3, {LC}, score_c FROM b) u) t WHERE label <> '' AND nth = 1""".replace("SELECT image_id, 'semantic", ", b AS (SELECT *, row_number() OVER () AS rid FROM v_boxes)\nSELECT image_id, 'semantic", 1), views=("v_boxes",))
def detection_mentions(spark, d):
    return vision(spark, d).select("image_id", F.explode(x.detection_mentions(F.col("objects"))).alias("m")).select("image_id", "m.*")


@query("detection_summary", f"""SELECT image_id, 'complete' AS status, round(list_avg(list_filter([round(score_a, 6), CASE WHEN {LB} <> '' THEN round(score_b, 6) END, round(score_c, 6)], lambda s: s IS NOT NULL)), 6) AS confidence,
 CASE WHEN score_a IS NULL AND score_c IS NULL AND {LB} = '' THEN 'model_confidence_unavailable' ELSE '' END AS diagnostics FROM v_boxes""", views=("v_boxes",))
def detection_summary(spark, d):
    # Fields are taken from the output itself, so that those nobody reads are not computed.
    out = x.detection_output()
    return vision(spark, d).select("image_id", out["status"].alias("status"), out["confidence"].alias("confidence"), F.array_join(out["diagnostics"], ",").alias("diagnostics"))


@query("place_candidates", """SELECT event_id, CASE WHEN event_id % 7 IN (1, 2) THEN 'partial' ELSE 'complete' END AS status, CASE WHEN event_id % 7 > 2 THEN 1.0::DOUBLE END AS confidence,
 CASE WHEN event_id % 7 = 0 THEN 'no_reliable_gps_place_candidate' WHEN event_id % 7 IN (1, 2) THEN 'invalid_gps_place_candidate' ELSE '' END AS diagnostics,
 CASE WHEN event_id % 7 > 2 THEN printf('geo:%.6f,%.6f', user_id / 4.0::DOUBLE, -(event_id % 1000) / 8.0::DOUBLE) END AS target_ref FROM events""")
def place_candidates(spark, d):
    n = F.col("event_id")
    latitude = F.when(n % 7 == 1, F.lit(91.5)).otherwise(F.col("user_id") / F.lit(4.0))
    longitude = -(n % 1000) / F.lit(8.0)
    derived = (
        F.when(n % 7 == 0, F.lit('{"gps":null}'))
        .when(n % 7 == 2, F.lit('{"gps":{"latitude":"north","longitude":1}}'))
        .otherwise(F.to_json(F.struct(F.struct(latitude.alias("latitude"), longitude.alias("longitude")).alias("gps"))))
    )
    out = load(spark, d, "events").withColumn("derived_json", derived).select("event_id", x.place_output().alias("out"))
    return out.select("event_id", "out.status", "out.confidence", F.array_join("out.diagnostics", ",").alias("diagnostics"), F.get("out.mentions", 0)["target_ref"].alias("target_ref"))


@query("semantic_validate", """SELECT event_id, CASE WHEN event_id % 9 < 8 THEN 'failed' ELSE 'complete' END AS status,
 CASE event_id % 9 WHEN 0 THEN 'invalid semantic status' WHEN 1 THEN 'confidence must be between 0 and 1' WHEN 2 THEN 'result_json must be a JSON object or array' WHEN 3 THEN 'failed extraction must include diagnostics'
  WHEN 4 THEN 'unsupported semantic relation' WHEN 5 THEN 'semantic mention target_ref is required' WHEN 6 THEN 'mention confidence must be between 0 and 1' WHEN 7 THEN 'provenance must be a JSON object' ELSE NULL END AS problem FROM events""")
def semantic_validate(spark, d):
    n = F.col("event_id") % 9
    mention = F.struct(
        F.when(n == 4, "object_has_semantic_result").otherwise("semantic_mentions_topic").alias("relation_type"),
        F.when(n == 5, "").otherwise(F.col("event_type")).alias("target_ref"),
        F.when(n == 6, F.lit(1.5)).otherwise(F.lit(None).cast("double")).alias("confidence"))
    out = x.output(
        F.when(n == 0, "done").when(n == 3, "failed").otherwise("complete"),
        confidence=F.when(n == 1, F.lit(-0.5)).otherwise(F.col("value") / 1_000_000),
        result_json=F.when(n == 2, F.lit("7")).otherwise(F.col("props")), mentions=F.array(mention),
        provenance=F.when(n == 7, F.lit("[]")).otherwise(F.lit("{}")))
    judged = load(spark, d, "events").select("event_id", x.validate_output(out).alias("out"))
    problem = F.regexp_extract(F.get("out.diagnostics", 0), "^extractor_failed:[A-Za-z]+: (.*)$", 1)
    return judged.select("event_id", "out.status", problem.alias("problem"))


DECLARED = ", ".join(
    f"({quoted(name)}, {quoted(kind)})"
    for spec in x.default_registry().list() for name in [spec.name] for kind in spec.object_types
)


@query("extractor_dispatch", f"SELECT object_id, object_type, name AS extractor_name, CASE WHEN name = 'text_normalization' THEN 'complete' ELSE 'unsupported' END AS status FROM v_objects JOIN (VALUES {DECLARED}) s(name, kind) ON kind = object_type", views=("v_objects",))
def extractor_dispatch(spark, d):
    rows = x.dispatch(load(spark, d, "v_objects"), x.default_registry().frame(spark))
    status = F.when(F.col("extractor_name") == "text_normalization", "complete").otherwise("unsupported")
    return rows.select("object_id", "object_type", "extractor_name", status.alias("status"))


def text_context(spark, d):
    """Objects with the text a text extractor reads."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    objects = load(spark, d, "v_objects").join(docs, "doc_id").drop("doc_id")
    none = F.lit(None).cast("string")
    return x.contexts(objects, load(spark, d, "v_attachments").drop("doc_id")).withColumn("metadata_extraction_id", none).withColumn("metadata_status", none)


def text_run(spark, d):
    """One run of text normalisation; results of each fourth object are stored already."""
    context = text_context(spark, d)
    spec = x.default_registry().get("text_normalization")
    stored = x.with_result_id(context.filter("CAST(substring(source_id, 5) AS INT) % 4 = 0"), spec).select("semantic_result_id")
    return x.run_extractor(context, stored, spec, 1)


RUN_CTES = f""", run AS (SELECT o.object_id, o.object_type, o.doc_id, '{P}_sem_' || {DUCK.uuid("('semantic:' || o.object_id || ':text_normalization:1.0.0:text_normalization:' || o.content_hash || ':' || coalesce(a.blob_id, ''))")} AS semantic_result_id,
 o.object_type IN ('note', 'message') AS fits, {collapse('d.text')} AS t FROM v_objects o JOIN documents d ON d.doc_id = o.doc_id LEFT JOIN v_attachments a ON a.object_id = o.object_id WHERE o.doc_id % 4 <> 0)
"""


@query("semantic_run", RUN_CTES + """SELECT semantic_result_id, object_id, CASE WHEN fits THEN 'complete' ELSE 'unsupported' END AS status, CASE WHEN fits THEN 1.0::DOUBLE END AS confidence, CASE WHEN fits THEN t END AS result_text,
 CASE WHEN fits THEN '' ELSE 'extractor_not_supported_for_object_type:' || object_type END AS diagnostics FROM run""", views=("v_objects", "v_attachments"))
def semantic_run(spark, d):
    return text_run(spark, d).select("semantic_result_id", "object_id", "status", "confidence", "result_text", F.array_join("diagnostics", ",").alias("diagnostics"))


@query("extract_pending", RUN_CTES + "SELECT semantic_result_id FROM run", views=("v_objects", "v_attachments"))
def extract_pending(spark, d):
    return text_run(spark, d).select("semantic_result_id")


def photo_answers(spark, d):
    """Backend answers for photo objects, made of the line items' labels by number."""
    photos = load(spark, d, "v_objects").filter("object_type = 'photo'")
    n = F.col("doc_id")
    labels = F.array(F.lit("person"), F.when(n % 2 == 0, "Snow  man").otherwise("person"))
    return photos.select(
        "object_id", F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("a  view of "), n.cast("string"))).alias("caption"),
        F.struct(F.array(F.lit("TRAIL 7")).alias("labels"), F.array().cast("array<array<double>>").alias("quad_boxes"), F.array().cast("array<double>").alias("scores")).alias("ocr"),
        F.struct(labels.alias("labels"), F.array(F.array(*[F.lit(float(v)) for v in (1, 2, 30, 20)])).alias("bboxes"), F.array(F.lit(0.91), F.lit(0.83)).alias("scores")).alias("objects"),
        F.lit(40).alias("width"), F.lit(30).alias("height"), F.lit('{"backend":"fixed"}').alias("runtime"),
        F.when(n % 4 == 0, "RuntimeError: no text model").alias("ocr_error"))


def photo_run(spark, d):
    objects = load(spark, d, "v_objects").filter("object_type = 'photo'").drop("doc_id")
    context = photo_context(objects, load(spark, d, "v_attachments").drop("doc_id"), load(spark, d, "v_extractions").drop("doc_id"), photo_answers(spark, d))
    return run_photo_projections(context, None, 1)


PHOTO_CTES = """, ph AS (SELECT object_id, doc_id FROM v_objects WHERE object_type = 'photo'),
res AS (SELECT object_id, doc_id, 'photo.caption' AS extractor_name, CASE WHEN doc_id % 3 = 0 THEN 'partial' ELSE 'complete' END AS status, CAST(NULL AS DOUBLE) AS confidence, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a view of ' || doc_id END AS result_text FROM ph
UNION ALL SELECT object_id, doc_id, 'photo.ocr', CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'complete' END, NULL, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'TRAIL 7' END FROM ph
UNION ALL SELECT object_id, doc_id, 'photo.objects', 'complete', 0.87, NULL FROM ph
UNION ALL SELECT object_id, doc_id, 'photo.place', 'complete', CASE WHEN doc_id % 4 < 2 THEN 1.0 END, NULL FROM ph)
"""


@query("photo_semantics", PHOTO_CTES + "SELECT object_id, extractor_name, status, confidence, result_text FROM res", views=("v_objects",))
def photo_semantics(spark, d):
    return photo_run(spark, d).select("object_id", "extractor_name", "status", "confidence", "result_text")


@query("semantic_relations", PHOTO_CTES + """SELECT object_id, relation_type, CASE relation_type WHEN 'object_has_semantic_result' THEN extractor_name ELSE target_ref END AS target, confidence FROM (
SELECT object_id, 'object_has_semantic_result' AS relation_type, extractor_name, NULL AS target_ref, confidence FROM res
UNION ALL SELECT object_id, 'semantic_mentions_entity', NULL, 'object:person', 0.91 FROM ph UNION ALL SELECT object_id, 'semantic_mentions_entity', NULL, 'object:snow-man', 0.83 FROM ph WHERE doc_id % 2 = 0
UNION ALL SELECT object_id, 'semantic_mentions_place', NULL, printf('geo:%.6f,%.6f', 48 + (doc_id % 8) / 8.0::DOUBLE, 142 + (doc_id % 4) / 4.0::DOUBLE), 1.0 FROM ph WHERE doc_id % 4 < 2) t""", views=("v_objects",))
def semantic_relations(spark, d):
    results = photo_run(spark, d)
    names = results.select("semantic_result_id", "extractor_name")
    rows = x.relation_rows(results).join(names, "semantic_result_id")
    target = F.when(F.col("relation_type") == x.BASE_RELATION, F.col("extractor_name")).otherwise(F.col("target_ref"))
    return rows.select("object_id", "relation_type", target.alias("target"), "confidence")


@query("status_rollup", PHOTO_CTES + "SELECT object_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status <> 'complete') THEN 'partial' ELSE 'complete' END AS semantic_status, count(*) AS n_results FROM res GROUP BY object_id", views=("v_objects",))
def status_rollup(spark, d):
    return x.status_rollup(photo_run(spark, d), ["object_id"])


@query("dq_no_person_edges", "SELECT count(*) FILTER (relation_type = 'semantic_mentions_person') AS person_edges FROM v_semantic_relations", views=("v_semantic_relations",))
def dq_no_person_edges(spark, d):
    from keepsake.operators.quality import person_edges

    return person_edges(load(spark, d, "v_semantic_relations"))


@query("current_results", """, runs AS (SELECT doc_id, 'v1-' || doc_id AS result_id, 1 AS seq FROM documents UNION ALL SELECT doc_id, 'v2-' || doc_id, 2 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'v1-' || doc_id, 3 FROM documents WHERE doc_id % 9 = 0),
last AS (SELECT doc_id, arg_max(result_id, seq) AS result_id FROM runs GROUP BY doc_id)
SELECT r.result_id AS semantic_result_id, l.result_id = r.result_id AS is_current FROM (SELECT DISTINCT doc_id, result_id FROM runs) r JOIN last l USING (doc_id)""".replace(", runs", "WITH runs", 1))
def current_results(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    number = F.col("doc_id").cast("string")

    def run(version: str, seq: int, every: int):
        return docs.filter(F.col("doc_id") % every == 0).select(
            number.alias("object_id"), F.lit("e").alias("extractor_name"), F.lit("t").alias("semantic_type"),
            F.concat(F.lit(f"{version}-"), number).alias("semantic_result_id"), F.lit(seq).alias("run_seq"))

    runs = run("v1", 1, 1).unionByName(run("v2", 2, 3)).unionByName(run("v1", 3, 9))
    results = run("v1", 1, 1).unionByName(run("v2", 2, 3)).drop("run_seq")
    return x.mark_current(results, runs).select("semantic_result_id", "is_current")
