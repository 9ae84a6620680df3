"""Queries of the sources: admission, names, routing, assembling text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import process as P
from ..sources import files as R
from ..sources import sinks as W
from ..sources.scratch import scratch_path, written
from . import corpora as C
from . import sqlgen as S
from .analytics_queries import EXPORT
from .detection_queries import DOCS
from .registry import query


@query("decode_text", "SELECT doc_id, md5(text) AS digest FROM documents")
def decode_text(spark, sf):
    docs = C.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(R.decode(F.encode("text", "UTF-8"))).alias("digest"))


@query("csv_as_document", """WITH s AS (SELECT s_nationkey AS file, s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey::VARCHAR END AS code FROM supplier)
 SELECT file, concat(string_agg(concat_ws(' ', s_name, code), chr(10) ORDER BY s_suppkey), chr(10),
 string_agg(s_name, ' ' ORDER BY s_suppkey), ' ', string_agg(coalesce(code, 'nan'), ' ' ORDER BY s_suppkey)) AS text FROM s GROUP BY file""")
def csv_as_document(spark, sf):
    k = F.col("s_suppkey")
    s = C.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("file"), "s_suppkey", "s_name", F.when(k % 4 != 0, k.cast("string")).alias("code"))
    numbered = R.number_rows(s, ["file"], ["s_suppkey"])
    return R.csv_as_document(numbered, ["file"], "position", ["s_name", "code"]).select("file", "text")


@query("admit_files", f"""SELECT file_id, reason, reason IS NULL AS admitted FROM (SELECT file_id, CASE
 WHEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) NOT IN ('pdf','docx','txt','csv','png','jpg','jpeg','json')
  THEN concat('File type ''', lower(regexp_extract(path, '\\.([^./]*)$', 1)), ''' not allowed')
 WHEN length > 524288000 THEN concat('File size ', length, ' exceeds maximum 524288000 bytes')
 WHEN length = 0 THEN 'File is empty' END AS reason FROM ({C.UPLOADS}))""")
def admit_files(spark, sf):
    return R.admit_files(C.uploads(spark, sf)).select("file_id", "reason", "admitted")


@query("safe_path", f"""SELECT file_id, NOT starts_with(path, '/') AND NOT starts_with(path, '../')
 AND NOT regexp_matches(path, '[<>|&;`$()]') AS ok FROM ({C.UPLOADS})""")
def safe_path(spark, sf):
    return C.uploads(spark, sf).select("file_id", R.safe_path(F.col("path")).alias("ok"))


@query("sanitize_filename", f"SELECT file_id, left(regexp_replace(split_part(path, '/', -1), '[^A-Za-z0-9._\\-]', '_', 'g'), 255) AS name FROM ({C.UPLOADS})")
def sanitize_filename(spark, sf):
    return C.uploads(spark, sf).select("file_id", R.sanitize_filename(F.col("path")).alias("name"))


CLEAN = "left(regexp_replace(filename, '[^A-Za-z0-9._\\-]', '_', 'g'), 255)"


@query("skip_processed", f"""WITH u AS (SELECT file_id, batch_id, {CLEAN} AS filename FROM ({C.UPLOADS})),
 done AS (SELECT batch_id, filename FROM u WHERE file_id % 3 = 0)
 SELECT file_id, EXISTS (SELECT 1 FROM done d WHERE d.batch_id = u.batch_id AND d.filename = u.filename) AS skipped FROM u""")
def skip_processed(spark, sf):
    new = C.uploads(spark, sf).select("file_id", "batch_id", "filename")
    done = new.filter(F.col("file_id") % 3 == 0).select("batch_id", R.sanitize_filename(F.col("filename")).alias("filename"))
    todo, skipped = R.skip_processed(new, done)
    return todo.select("file_id", F.lit(False).alias("skipped")).unionByName(
        skipped.select("file_id", F.lit(True).alias("skipped")))


@query("dedupe_by_content", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_content(spark, sf):
    return R.dedupe_by_content(C.table(spark, sf, "documents"))


@query("content_copies", """SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents""")
def content_copies(spark, sf):
    return R.copies_of(C.table(spark, sf, "documents"))


EXT = "lower(regexp_extract(filename, '\\.([^./]*)$', 1))"


@query("route_detector", f"""SELECT filename, CASE WHEN {EXT} IN ('pdf','txt','docx','doc') THEN 'LABEL-BASED' WHEN {EXT} IN ('csv','png') THEN 'ADVANCED'
 ELSE 'LABEL-BASED (default)' END AS detector_used, count(*) AS files FROM ({C.UPLOADS}) GROUP BY 1, 2""")
def route_detector(spark, sf):
    return R.route_detector(C.uploads(spark, sf)).groupBy("filename", "detector_used").agg(F.count("*").alias("files"))


def _routed_sql():
    from . import sqlgen as S
    src = lambda ext: f"SELECT doc_id, text FROM ({C.CARDS}) WHERE doc_id % 3 = {ext}"
    part = lambda ctes, name: f"SELECT doc_id, type, value, '{name}' AS detector_used FROM (WITH RECURSIVE {ctes} SELECT doc_id, type, value FROM kept)"
    return " UNION ALL ".join([
        part(S.label_ctes(src(0)), "LABEL-BASED"), part(S.context_ctes(src(1)), "ADVANCED"),
        part(S.base_ctes(src(2)), "ADVANCED")])


@query("detect_routed", _routed_sql())
def detect_routed(spark, sf):
    name = C.cat("f.", C.pick(["txt", "csv", "png"], F.col("doc_id") % 3))
    docs = R.route_detector(C.cards(spark, sf).withColumn("filename", name))
    return R.detect_routed(docs).select("doc_id", "type", "value", "detector_used")


@query("assemble_blocks", f"SELECT doc_id, string_agg(text, chr(10) ORDER BY line_number) AS text FROM ({C.BLOCKS}) GROUP BY 1")
def assemble_blocks(spark, sf):
    return R.assemble_blocks(C.blocks(spark, sf))


@query("prefer_fallback_blocks", f"""WITH b AS ({C.BLOCKS}), a AS (SELECT doc_id, line_number, CASE WHEN line_number % 2 = 0 THEN concat(text, '!') ELSE 'x' END AS alt FROM b)
 SELECT b.doc_id, b.line_number, CASE WHEN b.confidence < 0.65 AND length(a.alt) > length(b.text) THEN a.alt ELSE b.text END AS text,
 CASE WHEN b.confidence < 0.65 AND length(a.alt) > length(b.text) THEN 0.75 ELSE b.confidence END AS confidence
 FROM b LEFT JOIN a USING (doc_id, line_number)""")
def prefer_fallback_blocks(spark, sf):
    b = C.blocks(spark, sf)
    alt = b.select("doc_id", "line_number", F.when(
        F.col("line_number") % 2 == 0, F.concat("text", F.lit("!"))).otherwise("x").alias("text"))
    return R.prefer_fallback_blocks(b, alt).select("doc_id", "line_number", "text", "confidence")


SIZE = "(p_partkey * p_partkey * p_partkey * p_size)"


@query("human_size", f"""SELECT p_partkey AS id, CASE WHEN {SIZE} < 1024 THEN printf('%.2f B', {SIZE}::DOUBLE)
 WHEN {SIZE} < 1048576 THEN printf('%.2f KB', {SIZE} / 1024.0::DOUBLE) WHEN {SIZE} < 1073741824 THEN printf('%.2f MB', {SIZE} / 1048576.0::DOUBLE)
 WHEN {SIZE} < 1099511627776 THEN printf('%.2f GB', {SIZE} / 1073741824.0::DOUBLE) ELSE printf('%.2f TB', {SIZE} / 1099511627776.0::DOUBLE) END AS size FROM part""")
def human_size(spark, sf):
    # the product passes a bigint from a key of some 570,000 on
    k = F.col("p_partkey")
    d = k.cast("decimal(38,0)")
    return C.table(spark, sf, "part").select(k.alias("id"), R.human_size(d * d * d * F.col("p_size")).alias("size"))


def _named(spark, sf):
    return C.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("batch_id"), C.cat("doc_", F.col("doc_id"), ".txt").alias("filename"), "text")


@query("process_batch", f"""WITH {S.label_ctes(DOCS)}, n AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1),
 t AS (SELECT source, count(DISTINCT type) AS types FROM kept JOIN documents USING (doc_id) GROUP BY 1)
 SELECT d.source AS batch_id, count(*) AS files, count(*) AS pages_processed, coalesce(sum(n.n), 0)::BIGINT AS piis, coalesce(any_value(t.types), 0) AS pii_types,
 2 * count(*) AS debit FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (source) WHERE length(trim(d.text)) > 0 GROUP BY 1""")
def process_batch(spark, sf):
    docs, path = _named(spark, sf), scratch_path(spark, f"hits-{uuid.uuid4().hex}")
    none = docs.select("batch_id", "filename").limit(0)
    entries, totals, debits = P.process_batch(docs, none, path)
    # a second run over the same documents knows the entries of the first and adds nothing
    seen = written(entries.select("batch_id", "filename"), "entries")
    _, more, later = P.process_batch(docs, seen, path)
    totals, debits = totals.unionByName(more), debits.unionByName(later)
    return totals.join(debits, "batch_id").select("batch_id", "files", "pages_processed", "piis", "pii_types", "debit")


def _written(spark, write, rows, reader="parquet"):
    path = scratch_path(spark, f"sink-{uuid.uuid4().hex}")
    write(rows, path)
    return spark.read.format(reader).schema(rows.schema).load(path)


# the first 15 hexadecimal digits of a digest as a number, added up: any change of any text shows
def _digest(c):
    return F.sum(F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest")


SQL_DIGEST = "sum(('0x' || substr(md5({}), 1, 15))::BIGINT)::DECIMAL(38,0) AS digest"
SINK_SQL = f"SELECT source AS batch_id, count(*) AS docs, {SQL_DIGEST.format('text')} FROM documents GROUP BY 1"


@query("write_masked", SINK_SQL)
def write_masked(spark, sf):
    return _written(spark, W.write_masked, _named(spark, sf)).groupBy("batch_id").agg(F.count("*").alias("docs"), _digest("text"))


@query("write_masked_json", SINK_SQL)
def write_masked_json(spark, sf):
    rows = _named(spark, sf).select("batch_id", "doc_id", "text")
    return _written(spark, W.write_masked_json, rows, "json").groupBy("batch_id").agg(F.count("*").alias("docs"), _digest("text"))


@query("write_masked_lines", f"""WITH l AS (SELECT source AS batch_id, unnest(string_split(text, chr(10))) AS line FROM documents)
 SELECT batch_id, count(*) AS lines, {SQL_DIGEST.format('line')} FROM l GROUP BY 1""")
def write_masked_lines(spark, sf):
    rows = _named(spark, sf).select("batch_id", "doc_id", "text")
    path = scratch_path(spark, f"sink-{uuid.uuid4().hex}")
    W.write_masked_lines(rows, path)
    lines = spark.read.schema("value string, batch_id string").option("lineSep", "\n").text(path)
    return lines.groupBy("batch_id").agg(F.count("*").alias("lines"), _digest("value"))


@query("write_detections", f"SELECT batch_id, type, count(*) AS hits, {SQL_DIGEST.format('value')} FROM ({C.HITS}) GROUP BY 1, 2")
def write_detections(spark, sf):
    rows, path = C.hits(spark, sf).select("batch_id", "filename", "type", "value"), scratch_path(spark, f"sink-{uuid.uuid4().hex}")
    for _ in range(2):  # a run that is repeated is stored once
        W.write_detections(rows, path, run="first")
    return W.read_batches(spark, path, rows.schema).groupBy("batch_id", "type").agg(F.count("*").alias("hits"), _digest("value"))


@query("write_sidecar", f"SELECT batch_id, count(*) AS tokens, {SQL_DIGEST.format('sha256(value)')} FROM ({C.HITS}) GROUP BY 1")
def write_sidecar(spark, sf):
    rows = C.hits(spark, sf).select("batch_id", F.sha2("value", 256).alias("token"), F.col("type").alias("pii_type"))
    return _written(spark, W.write_sidecar, rows).groupBy("batch_id").agg(F.count("*").alias("tokens"), _digest("token"))


@query("write_export", f"""SELECT batch_id, count(*) AS payloads, {SQL_DIGEST.format("concat('{\"type\":\"', type, '\",\"value\":\"', value, '\",\"filename\":\"', filename, '\"}')")}
 FROM ({EXPORT}) GROUP BY 1""")
def write_export(spark, sf):
    rows = A.export_values(A.export_rows(C.hits(spark, sf)))
    return _written(spark, W.write_export, rows, "json").groupBy("batch_id").agg(F.count("*").alias("payloads"), _digest("payload"))


CARDS_IN_FILE = 500


@query("scan_directory", f"""WITH RECURSIVE {S.label_ctes(f"SELECT doc_id // {CARDS_IN_FILE} AS doc_id, concat(string_agg(text, chr(10) ORDER BY doc_id), chr(10)) AS text FROM ({C.CARDS}) GROUP BY 1")}
 SELECT doc_id AS part, type, count(*) AS hits, {SQL_DIGEST.format('value')}, any_value(n) AS files_found FROM kept,
 (SELECT count(DISTINCT doc_id // {CARDS_IN_FILE}) AS n FROM ({C.CARDS})) GROUP BY 1, 2""")
def scan_directory(spark, sf):
    path, part = scratch_path(spark, f"files-{uuid.uuid4().hex}"), F.floor(F.col("doc_id") / CARDS_IN_FILE)
    cards = C.cards(spark, sf).select("doc_id", part.alias("part"), F.col("text").alias("value"))
    cards.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(path)
    found, hits = R.scan_directory(spark, path, "*.txt")
    of = F.regexp_extract("path", r"/part=(\d+)/", 1).cast("bigint")
    rows = hits.groupBy(of.alias("part"), "type").agg(F.count("*").alias("hits"), _digest("value"), F.lit(1).alias("one"))
    # one row
    return rows.join(F.broadcast(found.withColumn("one", F.lit(1))), "one").drop("one")
