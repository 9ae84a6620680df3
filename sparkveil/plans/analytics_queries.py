"""Queries of the batch analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators.accounts import profile_flags
from ..operators.detect import detect_base
from . import corpora as C
from . import sqlgen as S
from .detection_queries import DOCS, _class_sql, docs
from .registry import query


def _weights(t="type"):
    return f"(CASE {t} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in A.RISK_WEIGHTS.items()) + " ELSE 3 END)"


def _parts(parts, t="type"):
    return "(" + " OR ".join(f"contains(upper({t}), '{p}')" for p in parts) + ")"


def entries(m):
    """A map as sorted text, so that both engines show it alike."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ";")


RISK_SQL = f"""SELECT batch_id, sum(w * n)::BIGINT AS total_risk_score, sum(n)::BIGINT AS total_piis,
 sum(CASE WHEN w >= 8 THEN n ELSE 0 END)::BIGINT AS critical_count, sum(CASE WHEN w BETWEEN 6 AND 7 THEN n ELSE 0 END)::BIGINT AS high_count,
 sum(CASE WHEN w BETWEEN 4 AND 5 THEN n ELSE 0 END)::BIGINT AS medium_count, sum(CASE WHEN w < 4 THEN n ELSE 0 END)::BIGINT AS low_count,
 count(*) AS pii_types, sum(w * n) / (sum(n) * 10) * 100 AS p
 FROM (SELECT batch_id, type, count(*) AS n, {_weights()} AS w FROM ({{hits}}) GROUP BY 1, 2) GROUP BY batch_id"""
LEVEL = "CASE WHEN p >= 70 THEN 'CRITICAL' WHEN p >= 50 THEN 'HIGH' WHEN p >= 30 THEN 'MEDIUM' ELSE 'LOW' END"
ENTRY_HITS = f"SELECT source AS batch_id, type FROM kept JOIN documents USING (doc_id)"


@query("document_risk", f"""WITH RECURSIVE {S.base_ctes(DOCS)}
 SELECT type, n, percentage, {_weights()} * n AS risk, risk_percentage, risk_level FROM (
 SELECT type, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 1) AS percentage,
  round(sum(sum({_weights()})) OVER () / (sum(count(*)) OVER () * 10) * 100, 1) AS risk_percentage,
  CASE WHEN sum(sum({_weights()})) OVER () / (sum(count(*)) OVER () * 10) * 100 >= 70 THEN 'CRITICAL'
   WHEN sum(sum({_weights()})) OVER () / (sum(count(*)) OVER () * 10) * 100 >= 50 THEN 'HIGH'
   WHEN sum(sum({_weights()})) OVER () / (sum(count(*)) OVER () * 10) * 100 >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
 FROM kept GROUP BY type)""")
def document_risk(spark, sf):
    """Per type of hit found in the documents: how many, what share, how risky."""
    hits = detect_base(docs(spark, sf)).withColumn("batch_id", F.lit("all"))
    # counted once; the shares and the overall risk need only the few counts
    per_type = hits.groupBy("batch_id", "type").agg(F.count("*").alias("n"))
    w = A.risk_weight(F.col("type"))
    rows = F.collect_list(F.struct("type", "n", (w * F.col("n")).alias("risk")))
    total, risk = F.sum("n"), F.sum(w * F.col("n"))
    percent = risk / (total * 10) * 100
    level = F.when(percent >= 70, "CRITICAL").when(percent >= 50, "HIGH").when(percent >= 30, "MEDIUM").otherwise("LOW")
    one = per_type.groupBy("batch_id").agg(rows.alias("rows"), total.alias("total"), F.round(percent, 1).alias("risk_percentage"),
                                           level.alias("risk_level"))
    return one.select(F.explode_outer("rows").alias("r"), "total", "risk_percentage", "risk_level").select(
        "r.type", "r.n", F.round(F.col("r.n") / F.col("total") * 100, 1).alias("percentage"), "r.risk",
        "risk_percentage", "risk_level")


@query("file_results", f"""WITH RECURSIVE {S.base_ctes(DOCS)}
 SELECT d.doc_id, length(trim(d.text)) > 0 AS success, CASE WHEN length(trim(d.text)) = 0 THEN 'No text extracted' END AS error,
 length(d.text)::INT AS text_length, {_class_sql('d.text')} AS document_type, coalesce(k.n, 0) AS pii_count
 FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1) k USING (doc_id)""")
def file_results(spark, sf):
    docs = C.table(spark, sf, "documents")
    return A.file_results(docs, detect_base(docs))


GOOD = f"(SELECT * FROM ({C.FILES}) WHERE success)"


@query("batch_stats", f"""WITH h AS ({C.HITS}), f AS {GOOD}, g AS (SELECT h.batch_id, h.type, count(*) AS n FROM h SEMI JOIN f USING (batch_id, filename) GROUP BY 1, 2)
 SELECT f.batch_id, count(*) AS files, sum(f.page_count)::BIGINT AS pages_processed, round(sum(f.processing_time), 2) AS scan_duration,
 max(f.processed_at) AS processed_at, any_value(b.piis) AS piis, any_value(b.types) AS pii_types, any_value(b.breakdown) AS breakdown
 FROM f LEFT JOIN (SELECT batch_id, sum(n)::BIGINT AS piis, count(*) AS types, string_agg(concat(type, '=', n), ';' ORDER BY type) AS breakdown FROM g GROUP BY 1) b
 ON f.batch_id = b.batch_id GROUP BY f.batch_id""")
def batch_stats(spark, sf):
    return A.batch_stats(C.files(spark, sf), C.hits(spark, sf)).withColumns({
        "breakdown": entries(F.col("breakdown")), "scan_duration": F.round("scan_duration", 2)})


@query("list_batches", f"""SELECT b.batch_id, b.user_id, b.status, b.created_at, coalesce(f.n, 0) AS file_count FROM (
 SELECT * FROM ({C.BATCHES}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, batch_id) <= 100) b
 LEFT JOIN (SELECT batch_id, count(*) AS n FROM ({C.FILES}) GROUP BY 1) f ON b.batch_id = f.batch_id""")
def list_batches(spark, sf):
    return A.list_batches(C.batches(spark, sf), C.files(spark, sf)).select(
        "batch_id", "user_id", "status", "created_at", "file_count")


STATS = f"""SELECT batch_id, files, piis FROM (SELECT batch_id, count(*) AS files FROM {GOOD} GROUP BY 1) LEFT JOIN
 (SELECT batch_id, count(*) AS piis FROM ({C.HITS}) SEMI JOIN {GOOD} USING (batch_id, filename) GROUP BY 1) USING (batch_id)"""


@query("user_stats", f"""SELECT b.user_id, count(*) AS total_batches, coalesce(sum(s.files), 0)::BIGINT AS total_files, coalesce(sum(s.piis), 0)::BIGINT AS total_piis
 FROM ({C.BATCHES}) b LEFT JOIN ({STATS}) s USING (batch_id) GROUP BY 1""")
def user_stats(spark, sf):
    return A.user_stats(C.batches(spark, sf), A.batch_stats(C.files(spark, sf), C.hits(spark, sf)))


_GOV = ", ".join(f"'{t}'" for t in A.GOVERNMENT_TYPES)


@query("user_profile_stats", f"""SELECT user_id, sum(n)::BIGINT AS total_piis, sum(CASE WHEN lower(type) IN ({_GOV}) THEN n ELSE 0 END)::BIGINT AS gov_piis,
 sum(CASE WHEN lower(type) IN ({_GOV}) THEN 0 ELSE n END)::BIGINT AS custom_piis,
 round(sum(CASE WHEN lower(type) IN ({_GOV}) THEN n ELSE 0 END) / sum(n) * 100, 2) AS gov_percentage,
 round(sum(CASE WHEN lower(type) IN ({_GOV}) THEN 0 ELSE n END) / sum(n) * 100, 2) AS custom_percentage,
 string_agg(concat(type, '=', n), ';' ORDER BY n DESC, type) AS pii_type_list
 FROM (SELECT b.user_id, h.type, count(*) AS n FROM ({C.HITS}) h JOIN ({C.BATCHES}) b USING (batch_id) GROUP BY 1, 2) GROUP BY 1""")
def user_profile_stats(spark, sf):
    return A.user_profile_stats(C.batches(spark, sf), C.hits(spark, sf)).withColumn("pii_type_list", F.array_join(
        F.transform("pii_type_list", lambda r: F.concat(r["type"], F.lit("="), r["count"].cast("string"))), ";"))


@query("stats_by_format", f"""SELECT f.format, count(*) AS files, coalesce(sum(h.n), 0)::BIGINT AS total_pii FROM {GOOD} f LEFT JOIN
 (SELECT batch_id, filename, count(*) AS n FROM ({C.HITS}) GROUP BY 1, 2) h USING (batch_id, filename) GROUP BY 1""")
def stats_by_format(spark, sf):
    return A.stats_by_format(C.files(spark, sf), C.hits(spark, sf))


@query("pii_statistics", f"""WITH r AS (SELECT h.type, h.category, f.format FROM ({C.HITS}) h JOIN {GOOD} f USING (batch_id, filename))
 SELECT 'format' AS dimension, format AS name, count(*) AS total_pii FROM r GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM r GROUP BY 2
 UNION ALL SELECT 'type', type, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM r""")
def pii_statistics(spark, sf):
    return A.pii_statistics(C.files(spark, sf), C.hits(spark, sf))


_IMG = """CASE WHEN type IN ('AADHAAR', 'PAN', 'PASSPORT', 'VOTER_ID', 'DRIVING_LICENSE') THEN 'government'
 WHEN type IN ('BANK_ACCOUNT_NUMBER', 'IFSC', 'CREDIT_CARD_NUMBER', 'DEBIT_CARD_NUMBER', 'GST') THEN 'financial'
 WHEN type IN ('PHONE', 'EMAIL', 'EMAIL_DOMAIN') THEN 'contact' ELSE 'custom' END"""


@query("image_summary", f"""WITH h AS ({C.HITS}), f AS ({C.FILES}) SELECT f.batch_id, sum(coalesce(n, 0))::BIGINT AS total_piis, count(n) AS images_with_pii,
 round(sum(processing_time), 2) AS total_time, any_value(c.pii_by_category) AS pii_by_category FROM f
 LEFT JOIN (SELECT batch_id, filename, count(*) AS n FROM h GROUP BY 1, 2) p USING (batch_id, filename)
 LEFT JOIN (SELECT batch_id, string_agg(concat(category, '=', n), ';' ORDER BY category) AS pii_by_category FROM
  (SELECT batch_id, {_IMG} AS category, count(*) AS n FROM h GROUP BY 1, 2) GROUP BY 1) c ON c.batch_id = f.batch_id GROUP BY f.batch_id""")
def image_summary(spark, sf):
    return A.image_summary(C.hits(spark, sf), C.files(spark, sf)).withColumns({
        "pii_by_category": entries(F.col("pii_by_category")), "total_time": F.round("total_time", 2)})


DIST = f"""SELECT batch_id, type, n, round(n / sum(n) OVER (PARTITION BY batch_id) * 100, 1) AS percentage,
 row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, type)::INT AS place FROM (SELECT batch_id, type, count(*) AS n FROM ({C.HITS}) GROUP BY 1, 2)"""


@query("type_distribution", DIST)
def type_distribution(spark, sf):
    return A.type_distribution(C.hits(spark, sf))


@query("top_types", f"SELECT batch_id, type, n, percentage, place, CASE WHEN length(type) > 8 THEN concat(substr(type, 1, 8), '...') ELSE type END AS label FROM ({DIST}) WHERE place <= 10")
def top_types(spark, sf):
    return A.top_types(C.hits(spark, sf), width=8)


@query("remaining_types", f"SELECT * FROM ({DIST}) WHERE place > 12")
def remaining_types(spark, sf):
    return A.remaining_types(C.hits(spark, sf))


@query("risk_report", f"""SELECT *, CASE WHEN risk_score < 40 THEN 'LOW' WHEN risk_score < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM (
 SELECT *, least(100, floor(high_risk_count / greatest(total_piis, 1) * 100)::INT + 20) AS risk_score FROM (
 SELECT b.batch_id, coalesce(sum(n), 0)::BIGINT AS total_piis, coalesce(sum(CASE WHEN {_parts(A.HIGH_RISK_PARTS)} THEN n ELSE 0 END), 0)::BIGINT AS high_risk_count,
  count(*) FILTER (WHERE {_parts(A.HIGH_RISK_PARTS)}) AS sensitive_types
 FROM ({C.BATCHES}) b LEFT JOIN (SELECT batch_id, type, count(*) AS n FROM ({C.HITS}) GROUP BY 1, 2) t USING (batch_id) GROUP BY 1))""")
def risk_report(spark, sf):
    return A.risk_report(C.hits(spark, sf), C.batches(spark, sf))


@query("weighted_risk", f"SELECT * EXCLUDE (p), round(p, 1) AS risk_percentage, {LEVEL} AS risk_level FROM ({RISK_SQL.format(hits=C.HITS)})")
def weighted_risk(spark, sf):
    return A.weighted_risk(C.hits(spark, sf)).drop("recommendations")


@query("risk_by_type", f"""SELECT batch_id, type, n, weight, risk, place FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY risk DESC, type)::INT AS place FROM (
 SELECT batch_id, type, count(*) AS n, {_weights()} AS weight, {_weights()} * count(*) AS risk FROM ({C.HITS}) GROUP BY 1, 2)) WHERE place <= 10""")
def risk_by_type(spark, sf):
    return A.risk_by_type(C.hits(spark, sf))


@query("recommendations", f"""SELECT batch_id, concat_ws('|', CASE WHEN critical_count > 0 THEN concat('Immediate action required: ', critical_count, ' critical PIIs detected') END,
 CASE WHEN high_count > 10 THEN 'High volume of sensitive data: Consider encryption at rest' END,
 CASE WHEN p >= 50 THEN 'High risk score: Review data retention policies' END,
 CASE WHEN pii_types > 15 THEN 'Multiple PII types: Implement comprehensive data governance' END) AS advice FROM ({RISK_SQL.format(hits=C.HITS)})""")
def recommendations(spark, sf):
    return A.weighted_risk(C.hits(spark, sf)).select("batch_id", F.array_join("recommendations", "|").alias("advice"))


@query("header_metrics", f"""WITH t AS (SELECT batch_id, type, count(*) AS n FROM ({C.HITS}) GROUP BY 1, 2),
 a AS (SELECT batch_id, count(*) AS file_count, sum(page_count)::BIGINT AS total_pages, sum(processing_time) AS s, max(processed_at) AS processed_at FROM ({C.FILES}) GROUP BY 1),
 b AS (SELECT batch_id, sum(n)::BIGINT AS total_piis, count(*) AS pii_types_count, sum(CASE WHEN {_parts(A.SENSITIVE_PARTS)} THEN n ELSE 0 END)::BIGINT AS sensitive_count FROM t GROUP BY 1),
 c AS (SELECT batch_id, type AS most_frequent_type FROM t QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, type) = 1)
 SELECT a.batch_id, file_count, total_pages, processed_at, total_piis, pii_types_count, sensitive_count, most_frequent_type,
 CASE WHEN s >= 60 THEN concat(floor(s / 60)::INT, 'm ', floor(s - floor(s / 60) * 60 + 0.5)::INT, 's') ELSE concat(floor(s + 0.5)::INT, 's') END AS scan_duration,
 round(total_piis / file_count, 1) AS avg_pii_per_file,
 CASE WHEN sensitive_count > 50 OR total_piis > 200 THEN 'High' WHEN sensitive_count > 20 OR total_piis > 100 THEN 'Medium' ELSE 'Low' END AS risk_level,
 CASE WHEN sensitive_count > 50 OR total_piis > 200 THEN 25 WHEN sensitive_count > 20 OR total_piis > 100 THEN 60 ELSE 90 END AS compliance_score
 FROM a JOIN b USING (batch_id) JOIN c USING (batch_id)""")
def header_metrics(spark, sf):
    return A.header_metrics(C.files(spark, sf), C.hits(spark, sf))


@query("detail_rows", f"""SELECT batch_id, filename, hit_no, type, value, CASE WHEN length(value) > 20 THEN concat(substr(value, 1, 17), '...') ELSE value END AS shown,
 page, confidence FROM ({C.HITS}) WHERE type IN ('EMAIL', 'BANK_ACCOUNT')""")
def detail_rows(spark, sf):
    return A.detail_rows(C.hits(spark, sf), types=["EMAIL", "BANK_ACCOUNT"])


@query("distinct_types", f"SELECT DISTINCT type FROM ({C.HITS})")
def distinct_types(spark, sf):
    return A.distinct_types(C.hits(spark, sf))


EXPORT = f"""SELECT batch_id, upper(type) AS type, trim(value) AS value, file_ord, hit_no, filename FROM ({C.HITS})
 QUALIFY row_number() OVER (PARTITION BY batch_id, upper(type), trim(value) ORDER BY file_ord, hit_no) = 1"""


@query("export_grouped", EXPORT)
def export_grouped(spark, sf):
    return A.export_rows(C.hits(spark, sf))


@query("export_files", f"SELECT batch_id, filename, count(*) AS pii_count FROM ({EXPORT}) GROUP BY 1, 2")
def export_files(spark, sf):
    return A.export_files(A.export_rows(C.hits(spark, sf)))


@query("export_metadata", f"SELECT batch_id, count(*) AS total_piis, string_agg(DISTINCT type, ',' ORDER BY type) AS pii_types FROM ({EXPORT}) GROUP BY 1")
def export_metadata(spark, sf):
    return A.export_metadata(A.export_rows(C.hits(spark, sf))).withColumn("pii_types", F.array_join("pii_types", ","))


@query("export_payload", f"""SELECT batch_id, concat(type, '-0') AS part, concat('{{"type":"', type, '","values":["', string_agg(value, '","' ORDER BY file_ord, hit_no), '"]}}') AS payload
 FROM ({EXPORT}) GROUP BY batch_id, type""")
def export_payload(spark, sf):
    return A.export_payload(A.export_rows(C.hits(spark, sf)))


@query("export_values", f"""SELECT batch_id, concat_ws('-', type, lpad(file_ord::VARCHAR, 20, '0'), lpad(hit_no::VARCHAR, 20, '0')) AS part,
 concat('{{"type":"', type, '","value":"', value, '","filename":"', filename, '"}}') AS payload FROM ({EXPORT})""")
def export_values(spark, sf):
    return A.export_values(A.export_rows(C.hits(spark, sf)))


@query("export_document", f"""SELECT e.batch_id, trim(b.name) AS name, e.total_piis, e.pii_types, e.files, 'AES-GCM-256' AS encryption FROM (
 SELECT batch_id, count(*) AS total_piis, array_to_string(list_sort(list(DISTINCT type)), ',') AS pii_types,
 (SELECT string_agg(concat(filename, ':', n), ',' ORDER BY filename) FROM (SELECT filename, count(*) AS n FROM ({EXPORT}) i WHERE i.batch_id = x.batch_id GROUP BY 1)) AS files
 FROM ({EXPORT}) x GROUP BY batch_id) e LEFT JOIN ({C.BATCHES}) b USING (batch_id)""")
def export_document(spark, sf):
    rows = A.export_document(A.export_rows(C.hits(spark, sf)), C.batches(spark, sf))
    files = F.array_join(F.transform("files", lambda f: F.concat(f["filename"], F.lit(":"), f["pii_count"].cast("string"))), ",")
    return rows.withColumns({"files": files, "pii_types": F.array_join("pii_types", ",")})


@query("page_of", f"SELECT batch_id, filename, hit_no, type FROM ({C.HITS}) ORDER BY hit_no, batch_id OFFSET 50 LIMIT 25")
def page_of(spark, sf):
    return A.page_of(C.hits(spark, sf).select("batch_id", "filename", "hit_no", "type"), ["hit_no", "batch_id"], 3, 25)


@query("page_count", f"SELECT batch_id, ceil(count(*) / 25)::BIGINT AS total_pages FROM ({C.HITS}) GROUP BY 1")
def page_count(spark, sf):
    return A.page_count(C.hits(spark, sf), 25, ["batch_id"])


@query("throughput", f"""SELECT batch_id, file_ord, completed, total, round(spent / completed, 4) AS avg_time,
 floor(round((total - completed) * (spent / completed), 6))::BIGINT AS eta FROM (SELECT batch_id, file_ord, count(*) OVER w AS completed,
 sum(processing_time) OVER w AS spent, count(*) OVER (PARTITION BY batch_id) AS total FROM ({C.FILES})
 WINDOW w AS (PARTITION BY batch_id ORDER BY processed_at, file_ord ROWS UNBOUNDED PRECEDING))""")
def throughput(spark, sf):
    return A.throughput(C.files(spark, sf))


@query("detector_totals", f"""SELECT count(*) AS scans, round(sum(processing_time), 2) AS total_time, round(avg(processing_time), 4) AS avg_time,
 (SELECT count(*) FROM ({C.HITS})) AS pii_found FROM ({C.FILES})""")
def detector_totals(spark, sf):
    return A.detector_totals(C.files(spark, sf), C.hits(spark, sf))


STRENGTH = """round(100 * ((email <> '' AND coalesce(email_verified, true))::INT + (full_name <> '' AND email <> '' AND country <> '')::INT
 + (coalesce(enable_2fa, false) OR coalesce(two_factor_enabled, false))::INT) / 3)::INT"""


@query("user_activity", f"""WITH b AS (SELECT *, CASE WHEN processed_at IS NOT NULL OR status = 'completed' THEN coalesce(processed_at, updated_at, created_at) END AS scan_at FROM ({C.BATCHES})),
 g AS (SELECT user_id, max(created_at) AS last_batch_created FROM b GROUP BY 1),
 s AS (SELECT user_id, scan_at FROM b WHERE scan_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, batch_id DESC) = 1)
 SELECT u.email, coalesce(last_login, updated_at, created_at) AS last_login, {STRENGTH} AS account_strength, g.last_batch_created, s.scan_at AS last_pii_scan
 FROM ({C.USERS}) u LEFT JOIN g ON g.user_id = u.email LEFT JOIN s ON s.user_id = u.email""")
def user_activity(spark, sf):
    return A.user_activity(profile_flags(C.users(spark, sf)), C.batches(spark, sf))


@query("daily_timeline", f"SELECT date_trunc('day', processed_at)::DATE AS day, type, count(*) AS events FROM ({C.HITS}) GROUP BY 1, 2")
def daily_timeline(spark, sf):
    return A.daily_timeline(C.hits(spark, sf))


@query("batch_comparison", f"""SELECT f.batch_id, file_count, total_piis AS pii_count, round(p, 1) AS risk_score
 FROM (SELECT batch_id, count(*) AS file_count FROM ({C.FILES}) GROUP BY 1) f JOIN ({RISK_SQL.format(hits=C.HITS)}) r USING (batch_id)""")
def batch_comparison(spark, sf):
    return A.batch_comparison(C.files(spark, sf), C.hits(spark, sf))


@query("riskiest_files", f"""SELECT batch_id, filename, count(*) AS pii_count, sum({_weights()})::BIGINT AS risk_score,
 row_number() OVER (PARTITION BY batch_id ORDER BY sum({_weights()}) DESC, filename)::INT AS place FROM ({C.HITS}) GROUP BY 1, 2
 QUALIFY place <= 5""")
def riskiest_files(spark, sf):
    return A.riskiest_files(C.hits(spark, sf))


@query("masked_share", f"""SELECT batch_id, sum(CASE WHEN m THEN n ELSE 0 END)::BIGINT AS masked, sum(CASE WHEN m THEN 0 ELSE n END)::BIGINT AS unmasked,
 round(sum(CASE WHEN m THEN n ELSE 0 END) / sum(n) * 100, 1) AS masked_percentage FROM (
 SELECT h.batch_id, h.filename, count(*) AS n, bool_or(f.success) AS m FROM ({C.HITS}) h JOIN ({C.FILES}) f USING (batch_id, filename) GROUP BY 1, 2) GROUP BY 1""")
def masked_share(spark, sf):
    return A.masked_share(C.hits(spark, sf), C.files(spark, sf).filter("success"))


@query("severity_counts", f"""SELECT CASE WHEN {_parts(['AADHAAR', 'PAN', 'VOTER', 'PASSPORT', 'DRIVING', 'IFSC'])} THEN 'Government'
 WHEN {_parts(['API', 'KEY', 'PASSWORD', 'TOKEN', 'SECRET'])} THEN 'Custom/Credentials' ELSE 'Other' END AS category,
 CASE WHEN {_parts(['AADHAAR', 'PAN', 'VOTER', 'PASSPORT', 'DRIVING', 'IFSC'])} THEN 'Critical'
 WHEN {_parts(['API', 'KEY', 'PASSWORD', 'TOKEN', 'SECRET'])} THEN 'High' ELSE 'Medium' END AS severity, count(*) AS hits FROM ({C.HITS}) GROUP BY 1, 2""")
def severity_counts(spark, sf):
    return A.severity_counts(C.hits(spark, sf))
