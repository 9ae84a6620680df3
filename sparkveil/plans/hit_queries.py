"""Queries over stored hits: normalising, de-duplicating, choosing, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import dedupe as H
from . import corpora as C
from .registry import query

DOC = ("batch_id", "filename")
KEYS = "batch_id, filename"
NORM = """(CASE WHEN upper(type) = 'AADHAAR' THEN regexp_replace(translate(value, ' -_', ''), '[^0-9]', '', 'g')
 WHEN upper(type) = 'PHONE' THEN CASE WHEN starts_with(regexp_replace(value, '[^0-9]', '', 'g'), '91') AND length(regexp_replace(value, '[^0-9]', '', 'g')) > 10
  THEN right(regexp_replace(value, '[^0-9]', '', 'g'), 10) ELSE regexp_replace(value, '[^0-9]', '', 'g') END
 WHEN upper(type) IN ('EMAIL', 'UPI') THEN lower(translate(value, ' -_', '')) ELSE translate(value, ' -_', '') END)"""


def _alias(t):
    from .detection_queries import _alias_sql
    return _alias_sql(t)


@query("normalize_detections", f"""SELECT batch_id, filename, hit_no, type, CASE WHEN page % 2 = 0 THEN value ELSE normalized END AS value,
 CASE WHEN page % 2 = 0 THEN value ELSE normalized END AS normalized, CASE WHEN page % 3 = 0 THEN 0.8 ELSE confidence END AS confidence,
 page, 0 AS "start", 0 AS "end" FROM ({C.HITS}) WHERE page <> 5""")
def normalize_detections(spark, sf):
    odd = F.col("page") % 2 == 1
    raw = C.hits(spark, sf).select(
        "batch_id", "filename", "hit_no", F.when(F.col("page") == 5, "").otherwise(F.col("type")).alias("type"),
        F.when(odd, "").otherwise(F.col("value")).alias("value"), F.when(odd, F.col("normalized")).alias("match"),
        F.when(F.col("page") % 3 != 0, F.col("confidence")).alias("confidence"), "page")
    return H.normalize_detections(raw)


@query("normalize_type", f"SELECT t AS type, {_alias('t')} AS canonical, count(*) AS n FROM (SELECT type AS t FROM ({C.HITS}) UNION ALL SELECT lower(type) FROM ({C.HITS})) GROUP BY 1")
def normalize_type(spark, sf):
    h = C.hits(spark, sf).select(F.explode(F.array("type", F.lower("type"))).alias("type"))
    return h.groupBy("type", H.normalize_type(F.col("type")).alias("canonical")).agg(F.count("*").alias("n"))


@query("normalize_value", f"SELECT type, {NORM} AS norm, count(*) AS n FROM ({C.HITS}) GROUP BY 1, 2")
def normalize_value(spark, sf):
    return C.hits(spark, sf).groupBy("type", H.normalize_value(F.col("value"), F.col("type")).alias("norm")).agg(
        F.count("*").alias("n"))


EXACT = f"PARTITION BY {KEYS}, {_alias('type')}, upper(translate(trim(value), ' -_', ''))"


@query("dedupe_exact", f"""SELECT batch_id, filename, hit_no, type, value, occurrence_count FROM (
 SELECT *, count(*) OVER ({EXACT}) AS occurrence_count, row_number() OVER ({EXACT} ORDER BY hit_no) AS rn FROM ({C.HITS})) WHERE rn = 1""")
def dedupe_exact(spark, sf):
    return H.dedupe_exact(C.hits(spark, sf), DOC).select(*DOC, "hit_no", "type", "value", "occurrence_count")


@query("masking_instances", f"SELECT batch_id, count(*) AS instances, count(DISTINCT concat(filename, type, value)) AS shown FROM ({C.HITS}) WHERE confidence >= 0.7 GROUP BY 1")
def masking_instances(spark, sf):
    h = H.min_confidence(C.hits(spark, sf), 0.7)
    rows = H.instances_of(h, H.dedupe_exact(h, DOC), DOC)
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("instances"), F.count_distinct(F.concat("filename", "type", "value")).alias("shown"))


SHOWN = f"PARTITION BY {KEYS}, upper(type), {NORM}"


@query("dedupe_display", f"""SELECT batch_id, filename, hit_no, type, occurrence_count, occurrence_count > 1 AS is_deduplicated FROM (
 SELECT *, count(*) OVER ({SHOWN}) AS occurrence_count, row_number() OVER ({SHOWN} ORDER BY hit_no) AS rn FROM ({C.HITS})) WHERE rn = 1""")
def dedupe_display(spark, sf):
    return H.dedupe_display(C.hits(spark, sf), DOC).select(*DOC, "hit_no", "type", "occurrence_count", "is_deduplicated")


@query("min_confidence", f"SELECT type, count(*) AS n FROM ({C.HITS}) WHERE confidence >= 0.7 GROUP BY 1")
def min_confidence(spark, sf):
    return H.min_confidence(C.hits(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


INSIDE = f"""EXISTS (SELECT 1 FROM h o WHERE o.batch_id = h.batch_id AND o.filename = h.filename AND o.type = h.type
 AND o.norm <> h.norm AND contains(o.norm, h.norm) AND (o.confidence, o.len, -o.hit_no) > (h.confidence, h.len, -h.hit_no))"""


@query("drop_substrings", f"""WITH h AS (SELECT *, {NORM} AS norm, length(value) AS len FROM ({C.HITS}))
 SELECT batch_id, filename, hit_no, type, value FROM h WHERE NOT {INSIDE}""")
def drop_substrings(spark, sf):
    return H.drop_substrings(C.hits(spark, sf), DOC).select(*DOC, "hit_no", "type", "value")


@query("smart_dedupe", f"""WITH h AS (SELECT *, {NORM} AS norm, length(value) AS len FROM ({C.HITS}) WHERE confidence >= 0.7),
 k AS (SELECT * FROM h WHERE NOT {INSIDE})
 SELECT batch_id, filename, hit_no, type, occurrence_count FROM (SELECT *, count(*) OVER ({SHOWN}) AS occurrence_count,
 row_number() OVER ({SHOWN} ORDER BY hit_no) AS rn FROM k) WHERE rn = 1""")
def smart_dedupe(spark, sf):
    display, _ = H.smart_dedupe(C.hits(spark, sf), doc=DOC)
    return display.select(*DOC, "hit_no", "type", "occurrence_count")


@query("select_types", f"SELECT batch_id, type, count(*) AS n FROM ({C.HITS}) WHERE type IN ('EMAIL', 'PAN') GROUP BY 1, 2")
def select_types(spark, sf):
    return H.select_types(C.hits(spark, sf), [" email ", "Pan"]).groupBy("batch_id", "type").agg(F.count("*").alias("n"))


@query("attach_bbox", f"""WITH b AS ({C.BLOCKS}), h AS (SELECT DISTINCT doc_id, concat('CUST', lpad(doc_id::VARCHAR, 6, '0')) AS value FROM b
 UNION SELECT doc_id, 'no such value' FROM b)
 SELECT h.doc_id, h.value, min_by(b.x, b.line_number) AS x, min_by(b.y, b.line_number) AS y
 FROM h LEFT JOIN b ON b.doc_id = h.doc_id AND contains(b.text, h.value) GROUP BY 1, 2""")
def attach_bbox(spark, sf):
    blocks = C.blocks(spark, sf)
    ids = blocks.select("doc_id").distinct()
    values = F.array(C.cat("CUST", F.lpad(F.col("doc_id").cast("string"), 6, "0")), F.lit("no such value"))
    hits = ids.select("doc_id", F.posexplode(values).alias("hit_no", "value"))
    return G.attach_bbox(hits, blocks).select("doc_id", "value", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"))


@query("normalize_bbox", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey::INT % 50 END AS x,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS height FROM part""")
def normalize_bbox(spark, sf):
    k = F.col("p_partkey")
    x, s = (k % 50).cast("int"), F.col("p_size")
    rec = F.when(k % 3 == 1, F.struct(x.alias("x"), F.lit(1).alias("y"), F.lit(2).alias("width"), s.alias("height")))
    lst = F.when(k % 3 == 2, F.array(x, F.lit(1), F.lit(2), s)).when(k % 3 == 0, F.array(x, s))
    b = G.normalize_bbox(rec, lst)
    return C.table(spark, sf, "part").select(k.alias("id"), b["x"].alias("x"), b["height"].alias("height"))


COVERS = """len(list_filter(w.kept, lambda k: least(k.x + k.w, b.x + b.w) > greatest(k.x, b.x) AND least(k.y + k.h, b.y + b.h) > greatest(k.y, b.y)
 AND (least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * (least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)) > least(k.w * k.h, b.w * b.h) * 0.5)) > 0"""


@query("drop_overlapping_boxes", f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY box_no, x, y, w) AS rn FROM (
 SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_partkey * 1000 + l_suppkey AS box_no, (l_partkey % 200)::INT AS x, (l_suppkey % 50)::INT AS y, l_quantity::INT AS w, 20 AS h FROM lineitem)),
 w AS (SELECT doc_id, page, 0::BIGINT AS rn, 0::BIGINT AS box_no, 0 AS x, 0 AS y, 0 AS w, 0 AS h, false AS keep, []::STRUCT(x INT, y INT, w INT, h INT)[] AS kept FROM (SELECT DISTINCT doc_id, page FROM b)
 UNION ALL SELECT b.doc_id, b.page, b.rn, b.box_no, b.x, b.y, b.w, b.h, NOT ({COVERS}),
  CASE WHEN {COVERS} THEN w.kept ELSE list_append(w.kept, {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) END
 FROM w JOIN b ON b.doc_id = w.doc_id AND b.page = w.page AND b.rn = w.rn + 1)
 SELECT doc_id, page, box_no, x, y, w AS width, h AS height FROM w WHERE keep""")
def drop_overlapping_boxes(spark, sf):
    li = C.table(spark, sf, "lineitem")
    bbox = G.box(F.col("l_partkey") % 200, F.col("l_suppkey") % 50, F.col("l_quantity"), F.lit(20))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"),
                     (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("box_no"), bbox.alias("bbox"))
    return G.drop_overlapping_boxes(rows).select("doc_id", "page", "box_no", "bbox.x", "bbox.y", "bbox.width", "bbox.height")


@query("mask_rectangle", """SELECT id, greatest(0, x - 5) AS x1, greatest(0, top - 5) AS y1,
 least(400, greatest(0, x - 5) + w + 10) AS x2, least(300, greatest(0, top - 5) + least(h, most) + 10) AS y2 FROM (
 SELECT *, CASE WHEN h > most THEN greatest(0, trunc(y + h / 2 - most / 2)::INT) ELSE y END AS top FROM (
 SELECT p_partkey AS id, p_partkey::INT % 300 AS x, p_partkey::INT % 170 AS y, p_size AS w, (p_partkey % 60 + 1)::INT AS h,
 greatest(12, floor(p_size * 0.55)::INT) AS most FROM part))""")
def mask_rectangle(spark, sf):
    k = F.col("p_partkey")
    b = G.box(k % 300, k % 170, F.col("p_size"), k % 60 + 1)
    r = G.mask_rectangle(b, F.lit(400), F.lit(300))
    return C.table(spark, sf, "part").select(k.alias("id"), *[r[n].alias(n) for n in ("x1", "y1", "x2", "y2")])


@query("polygon_to_bbox", """SELECT p_partkey AS id, least(p_size, p_partkey % 40, 7)::INT AS x, least(p_size + 1, p_partkey % 30, 9)::INT AS y,
 (greatest(p_size, p_partkey % 40, 7) - least(p_size, p_partkey % 40, 7))::INT AS width,
 (greatest(p_size + 1, p_partkey % 30, 9) - least(p_size + 1, p_partkey % 30, 9))::INT AS height FROM part""")
def polygon_to_bbox(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    seven, nine = F.lit(7).cast("bigint"), F.lit(9).cast("bigint")
    b = G.polygon_to_bbox(F.array(point(s, s + 1), point(k % 40, k % 30), point(seven, nine)))
    return C.table(spark, sf, "part").select(k.alias("id"), *[b[n].alias(n) for n in ("x", "y", "width", "height")])
