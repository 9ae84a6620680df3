"""Queries of masking, encryption, unmasking and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import crypto as K
from ..operators import detect as D
from ..operators import mask as M
from . import corpora as C
from . import sqlgen as S
from .analytics_queries import EXPORT
from .detection_queries import DOCS, docs
from .registry import query

PASSWORD = "correct horse"
K6, K9, K4 = "lpad(c_custkey::VARCHAR, 6, '0')", "lpad(c_custkey::VARCHAR, 9, '0')", "lpad((c_custkey % 10000)::VARCHAR, 4, '0')"


def card_hits(spark, sf):
    """Stored hits of the customer cards: one of several kinds each, with spellings."""
    k = F.col("c_custkey")
    nine, four = F.lpad(k.cast("string"), 9, "0"), F.lpad((k % 10000).cast("string"), 4, "0")
    aadhaar = C.cat("2341 2341 ", four)
    rows = F.array(
        F.struct(F.lit("AADHAAR").alias("type"), aadhaar.alias("value"), F.regexp_replace(aadhaar, " ", "").alias("normalized")),
        F.struct(F.lit("PHONE").alias("type"), C.cat("9", nine).alias("value"), C.cat("9", nine).alias("normalized")),
        F.struct(F.lit("EMAIL").alias("type"), C.cat("User", k, "@Example.com").alias("value"), C.cat("User", k, "@Example.com").alias("normalized")),
        F.struct(F.lit("PAN").alias("type"), C.cat("ABCDE", four, "F").alias("value"), C.cat("ABCDE", four, "F").alias("normalized")))
    keys = C.spread(C.table(spark, sf, "customer").select("c_custkey"))
    return keys.select(k.alias("doc_id"), F.posexplode(rows).alias("hit_no", "h")).select("doc_id", "hit_no", "h.*")


@query("variations", f"""SELECT c_custkey AS doc_id, 'AADHAAR' AS type, concat_ws('|', concat('2341 2341 ', {K4}), concat('23412341', {K4}), concat('2341-2341-', {K4})) AS spellings FROM customer
 UNION ALL SELECT c_custkey, 'PHONE', concat_ws('|', concat('9', {K9}), concat('9', left({K9}, 3), '-', substr({K9}, 4, 4), '-', right({K9}, 2))) FROM customer
 UNION ALL SELECT c_custkey, 'EMAIL', concat_ws('|', concat('User', c_custkey, '@Example.com'), concat('user', c_custkey, '@example.com'), concat('USER', c_custkey, '@EXAMPLE.COM')) FROM customer
 UNION ALL SELECT c_custkey, 'PAN', concat('ABCDE', {K4}, 'F') FROM customer""")
def variations(spark, sf):
    forms = M.variations(F.col("value"), F.col("normalized"), F.col("type"))
    return card_hits(spark, sf).select("doc_id", "type", F.array_join(forms, "|").alias("spellings"))


@query("mask_text", f"""SELECT doc_id, md5(replace(replace(replace(replace(text, concat('user', doc_id, '@example.com'), repeat('█', length(concat('user', doc_id, '@example.com')))),
 concat('2341 2341 ', k4), repeat('█', 14)), concat('9', k9), repeat('█', 10)), concat('ABCDE', k4, 'F'), repeat('█', 10))) AS digest
 FROM (SELECT doc_id, text, lpad((doc_id % 10000)::VARCHAR, 4, '0') AS k4, lpad(doc_id::VARCHAR, 9, '0') AS k9 FROM ({C.CARDS}))""")
def mask_text(spark, sf):
    return M.mask_text(C.cards(spark, sf), card_hits(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


def _masked_sql():
    return f"""WITH RECURSIVE {S.base_ctes(DOCS)},
 v AS (SELECT doc_id, list(value ORDER BY length(value) DESC, value) AS vs FROM (SELECT DISTINCT doc_id, value FROM kept) GROUP BY doc_id)
 SELECT d.doc_id, md5(CASE WHEN vs IS NULL THEN d.text ELSE list_reduce(list_prepend(d.text, vs), lambda t, x: replace(t, x, repeat('█', length(x)))) END) AS digest
 FROM documents d LEFT JOIN v USING (doc_id)"""


@query("detect_and_mask", _masked_sql())
def detect_and_mask(spark, sf):
    return M.detect_and_mask(docs(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


@query("mask_stored_hits", _masked_sql())
def mask_stored_hits(spark, sf):
    texts = docs(spark, sf)
    return M.mask_text(texts, D.detect_base(texts)).select("doc_id", F.md5("text").alias("digest"))


@query("mask_spans", f"""WITH RECURSIVE {S.base_ctes(C.CARDS)},
 h AS (SELECT doc_id, list({{'s': "start", 'e': "end", 't': ''}} ORDER BY "start") AS hs FROM kept GROUP BY 1)
 SELECT c.doc_id, md5(list_reduce(list_prepend({{'s': 0, 'e': 0, 't': c.text}}, hs), lambda a, b:
 {{'s': 0, 'e': 0, 't': concat(substr(a.t, 1, b.s), repeat('█', b.e - b.s), substr(a.t, b.e + 1))}}).t) AS digest FROM ({C.CARDS}) c JOIN h USING (doc_id)""")
def mask_spans(spark, sf):
    found = D.add_base_hits(C.cards(spark, sf))
    return M.mask_spans(found).select("doc_id", F.md5("text").alias("digest"))


UNITS = f"SELECT doc_id * 10000 + element_no AS doc_id, text FROM ({C.ELEMENTS})"


def _units_masked_sql(name, by):
    """Every unit with the values found in all units of the same ``by`` blanked out, the longest first."""
    return f"""WITH RECURSIVE {S.base_ctes(UNITS)},
 v AS (SELECT k, list(value ORDER BY length(value) DESC, value) AS vs FROM (SELECT DISTINCT {by.format(key='doc_id')} AS k, value FROM kept) GROUP BY k)
 SELECT e.doc_id, e.element_no AS {name}, md5(CASE WHEN vs IS NULL THEN e.text ELSE list_reduce(list_prepend(e.text, vs), lambda t, x: replace(t, x, repeat('█', length(x)))) END) AS digest
 FROM ({C.ELEMENTS}) e LEFT JOIN v ON v.k = {by.format(key='(e.doc_id * 10000 + e.element_no)')}"""


@query("mask_elements", _units_masked_sql("element_no", "({key} // 10000)"))
def mask_elements(spark, sf):
    el = C.elements(spark, sf)
    hits = D.detect_base(el, key=("doc_id", "element_no")).select("doc_id", "type", "value", "normalized")
    return M.mask_elements(el, hits).select("doc_id", "element_no", F.md5("text").alias("digest"))


@query("mask_pages", _units_masked_sql("page", "{key}"))
def mask_pages(spark, sf):
    pages = C.elements(spark, sf).select("doc_id", F.col("element_no").alias("page"), "text")
    hits = D.detect_base(pages, key=("doc_id", "page")).select("doc_id", "page", "type", "value", "normalized")
    return M.mask_pages(pages, hits).select("doc_id", "page", F.md5("text").alias("digest"))


@query("partial_mask", f"""SELECT batch_id, filename, hit_no, concat(type, ': ', CASE WHEN page % 3 = 0 THEN 'hidden'
 WHEN length(value) > 4 THEN concat(repeat('X', length(value) - 4), right(value, 4)) ELSE repeat('X', length(value)) END) AS shown FROM ({C.HITS})""")
def partial_mask(spark, sf):
    given = F.when(F.col("page") % 3 == 0, "hidden").when(F.col("page") % 3 == 1, F.col("value"))
    return C.hits(spark, sf).select("batch_id", "filename", "hit_no", M.partial_mask(
        F.col("type"), F.col("value"), given).alias("shown"))


@query("derive_key", "SELECT count(*) AS batches, count(*) AS distinct_keys, true AS all_256_bit FROM supplier")
def derive_key(spark, sf):
    keys = K.batch_keys(C.batches(spark, sf), PASSWORD, K.new_nonce())
    return keys.agg(F.count("*").alias("batches"), F.count_distinct("key").alias("distinct_keys"),
                    F.bool_and(F.length("key") == 32).alias("all_256_bit"))


def _batched(df):
    return df.withColumn("batch_id", C.cat("B", F.col("doc_id") % 16))


@query("encrypt_values", f"""SELECT doc_id, type, value, value AS plain, true AS hidden, NULL AS wrong FROM (
 SELECT c_custkey AS doc_id, 'AADHAAR' AS type, concat('2341 2341 ', {K4}) AS value FROM customer UNION ALL SELECT c_custkey, 'PHONE', concat('9', {K9}) FROM customer
 UNION ALL SELECT c_custkey, 'EMAIL', concat('User', c_custkey, '@Example.com') FROM customer UNION ALL SELECT c_custkey, 'PAN', concat('ABCDE', {K4}, 'F') FROM customer)""")
def encrypt_values(spark, sf):
    hits = _batched(card_hits(spark, sf))
    nonce = K.new_nonce()
    sealed = K.encrypt_values(hits, K.batch_keys(hits, PASSWORD, nonce), nonce)
    opened = K.decrypt_values(sealed, PASSWORD)
    wrong = K.decrypt_values(sealed.select("doc_id", "type", "token", "salt", "iv"), "wrong").select(
        "doc_id", "type", F.col("plain").alias("wrong"))
    return opened.join(wrong, ["doc_id", "type"]).select(
        "doc_id", "type", "value", "plain", (~F.contains("token", "value")).alias("hidden"), "wrong")


def _sealed(spark, sf):
    texts, hits = _batched(C.cards(spark, sf)), card_hits(spark, sf)
    return K.hash_mask_text(texts, hits, PASSWORD)


@query("hash_mask_text", f"""SELECT doc_id, 4 AS tokens, false AS shows_phone FROM ({C.CARDS})""")
def hash_mask_text(spark, sf):
    masked, side = _sealed(spark, sf)
    n = side.groupBy("doc_id").agg(F.count("*").cast("int").alias("tokens"))
    phone = C.cat("Phone: 9", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return masked.join(n, "doc_id").select("doc_id", "tokens", F.contains("text", phone).alias("shows_phone"))


@query("unmask_text", f"SELECT doc_id, text, 4 AS decrypted, 0 AS failed FROM ({C.CARDS})")
def unmask_text(spark, sf):
    masked, side = _sealed(spark, sf)
    return K.unmask_text(masked, side, PASSWORD).select("doc_id", "text", "decrypted", "failed")


@query("unmask_and_rescan", f"WITH RECURSIVE {S.context_ctes(C.CARDS)} SELECT type, count(*) AS hits FROM kept GROUP BY 1")
def unmask_and_rescan(spark, sf):
    masked, side = _sealed(spark, sf)
    return K.unmask_and_rescan(masked, side, PASSWORD).groupBy("type").agg(F.count("*").alias("hits"))


@query("extract_tokens", f"SELECT doc_id, 4 AS tokens, true AS all_sealed FROM ({C.CARDS})")
def extract_tokens(spark, sf):
    masked, side = _sealed(spark, sf)
    known = side.select("doc_id", "token", F.lit(True).alias("known"))
    return K.extract_tokens(masked).join(known, ["doc_id", "token"], "left").groupBy("doc_id").agg(
        F.count("*").cast("int").alias("tokens"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_sealed"))


@query("match_tokens", f"SELECT doc_id, 3::BIGINT AS found, 1::BIGINT AS failed FROM ({C.CARDS})")
def match_tokens(spark, sf):
    masked, side = _sealed(spark, sf)
    return K.match_tokens(K.extract_tokens(masked), side.filter("pii_type <> 'EMAIL'"))


@query("lock_export", f"""SELECT batch_id, concat(type, '-0') AS part, concat('{{"type":"', type, '","values":["', string_agg(value, '","' ORDER BY file_ord, hit_no), '"]}}') AS payload,
 NULL AS error FROM ({EXPORT}) GROUP BY batch_id, type""")
def lock_export(spark, sf):
    payloads = A.export_payload(A.export_rows(C.hits(spark, sf)))
    return K.unlock_export(K.lock_export(payloads, PASSWORD), PASSWORD).select("batch_id", "part", "payload", "error")


@query("pseudonymize", f"SELECT batch_id, filename, hit_no, sha256(concat('pepper', value)) AS token FROM ({C.HITS})")
def pseudonymize(spark, sf):
    return C.hits(spark, sf).select("batch_id", "filename", "hit_no", M.pseudonymize(
        F.col("value"), F.lit("pepper")).alias("token"))


@query("redact_nested", """SELECT o_orderkey AS id, concat('{"id":', o_orderkey, ',"at":"', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'),
 '","inner":{"status":"', o_orderstatus, '"},"list":[{"keep":', o_custkey, '}],"map":{"a":"x"}}') AS record FROM orders""")
def redact_nested(spark, sf):
    o = C.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit("x").alias("password"),
        F.struct(F.col("o_orderstatus").alias("status"), F.lit("1").alias("otp")).alias("inner"),
        F.array(F.struct(F.col("o_custkey").alias("keep"), F.lit("s").alias("reset_token"))).alias("list"),
        F.create_map(F.lit("a"), F.lit("x"), F.lit("sessions"), F.lit("y")).alias("map"))
    return M.redact_nested(o).select("id", F.to_json(F.struct("id", "at", "inner", "list", "map")).alias("record"))


@query("sanitize_text", """SELECT page_id, md5(regexp_replace(regexp_replace(html, '[<>"''&\n\r]', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM pages""")
def sanitize_text(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", F.md5(M.sanitize_text(F.col("html"))).alias("digest"))


@query("sanitize_columns", """SELECT event_id, replace(props, '"', '') AS props, replace(props, '"', '') AS inner_props FROM events""")
def sanitize_columns(spark, sf):
    e = C.table(spark, sf, "events").select("event_id", "props", F.array(F.struct(F.col("props").alias("p"))).alias("nested"))
    return M.sanitize_columns(e).select("event_id", "props", F.col("nested")[0]["p"].alias("inner_props"))


@query("mask_report", f"""SELECT batch_id, count(*) FILTER (WHERE success AND n > 0 AND NOT img) AS masked_files, count(*) FILTER (WHERE NOT success) AS skipped_failed,
 count(*) FILTER (WHERE success AND n = 0) AS skipped_no_hits, count(*) FILTER (WHERE success AND n > 0 AND img) AS skipped_unsupported FROM (
 SELECT batch_id, success, CASE WHEN file_ord % 9 = 0 THEN 0 ELSE pii_count END AS n, format = 'PNG' AS img FROM ({C.FILES})) GROUP BY 1""")
def mask_report(spark, sf):
    jobs = C.files(spark, sf).withColumn("pii_count", F.when(F.col("file_ord") % 9 != 0, F.col("pii_count")))
    return M.mask_report(jobs)


@query("masked_name", f"SELECT DISTINCT filename, concat('masked_hash_', filename) AS masked FROM ({C.FILES})")
def masked_name(spark, sf):
    return C.files(spark, sf).select("filename", M.masked_name(F.col("filename"), "hash").alias("masked")).distinct()
