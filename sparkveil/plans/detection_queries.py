"""Queries of the detection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..operators import detect as D
from ..operators import units as U
from ..operators.context import classify_document, filter_by_context
from ..operators.dedupe import categorize, summarize, with_category
from ..functions.catalogs import DOCUMENT_CLASSES, GENERIC, LABELS
from . import corpora as C
from . import sqlgen as S
from .registry import query

DOCS = "SELECT doc_id, text FROM documents"
HIT_COLS = ["doc_id", "type", "value", "normalized", "confidence", "start", "end"]
HIT_SQL = 'doc_id, type, value, normalized, confidence, "start", "end"'


def docs(spark, sf):
    # the given folders hold the table as one file, which is one or two splits
    return D.balanced(C.table(spark, sf, "documents").select("doc_id", "text"), 2 * spark.sparkContext.defaultParallelism)


@query("detect_base", f"WITH RECURSIVE {S.base_ctes(DOCS)} SELECT {HIT_SQL} FROM kept")
def detect_base(spark, sf):
    return D.detect_base(docs(spark, sf)).select(*HIT_COLS)


@query("detect_base_cards", f"WITH RECURSIVE {S.base_ctes(C.CARDS)} SELECT {HIT_SQL} FROM kept")
def detect_base_cards(spark, sf):
    return D.detect_base(C.cards(spark, sf)).select(*HIT_COLS)


@query("detect_context", f"WITH RECURSIVE {S.context_ctes(DOCS)} SELECT {HIT_SQL}, context FROM kept")
def detect_context(spark, sf):
    return D.detect_context(docs(spark, sf)).select(*HIT_COLS, "context")


@query("detect_context_cards", f"WITH RECURSIVE {S.context_ctes(C.CARDS)} SELECT {HIT_SQL}, context FROM kept")
def detect_context_cards(spark, sf):
    return D.detect_context(C.cards(spark, sf)).select(*HIT_COLS, "context")


LABEL_SQL = 'doc_id, type, category, label, value, 0.95::DOUBLE AS confidence, "start", "end"'
LABEL_COLS = ["doc_id", "type", "category", "label", "value", "confidence", "start", "end"]


@query("detect_labels", f"WITH {S.label_ctes(DOCS)} SELECT {LABEL_SQL} FROM kept")
def detect_labels(spark, sf):
    return D.detect_labels(docs(spark, sf)).select(*LABEL_COLS)


@query("detect_labels_cards", f"WITH {S.label_ctes(C.CARDS)} SELECT {LABEL_SQL} FROM kept")
def detect_labels_cards(spark, sf):
    return D.detect_labels(C.cards(spark, sf)).select(*LABEL_COLS)


@query("detect_generic", f"WITH {S.generic_ctes(DOCS)} SELECT {LABEL_SQL} FROM kept")
def detect_generic(spark, sf):
    return D.detect_generic(docs(spark, sf)).select(*LABEL_COLS)


@query("detect_generic_cards", f"WITH {S.generic_ctes(C.CARDS)} SELECT {LABEL_SQL} FROM kept")
def detect_generic_cards(spark, sf):
    return D.detect_generic(C.cards(spark, sf)).select(*LABEL_COLS)


@query("detect_by_category", f"WITH {S.generic_ctes(C.CARDS, category='Financial')} SELECT {LABEL_SQL} FROM kept")
def detect_by_category(spark, sf):
    return D.detect_by_category(C.cards(spark, sf), "Financial").select(*LABEL_COLS)


@query("detect_custom", """SELECT doc_id, 'HEX40' AS type, u AS value, 0.8::DOUBLE AS confidence FROM (
 SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9a-f]{40}'))) AS u FROM documents)""")
def detect_custom(spark, sf):
    own = [("HEX40", r"[0-9a-f]{40}", 0.8)]
    return D.detect_custom(docs(spark, sf), own).select("doc_id", "type", "value", "confidence").distinct()


@query("short_text_guard", """SELECT turn, count(*) AS texts, count(*) FILTER (WHERE length(trim(text)) >= 2) AS scanned
 FROM conversations GROUP BY turn""")
def short_text_guard(spark, sf):
    ok = F.length(checks.strip(F.col("text"))) >= 2
    return C.table(spark, sf, "conversations").groupBy("turn").agg(
        F.count("*").alias("texts"), F.count_if(ok).alias("scanned"))


@query("normalize_ws", "SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS squeezed FROM documents")
def normalize_ws(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(checks.normalize_ws(F.col("text"))).alias("squeezed"))


@query("confidence", f"""WITH {S.raw_matches(C.CARDS, 'doc_id', S.cat.shape_catalog())}, {S.scored('doc_id', S.cat.shape_catalog())}
 SELECT type, confidence, count(*) AS hits FROM scored GROUP BY 1, 2""")
def confidence(spark, sf):
    patterns = S.cat.shape_catalog()
    raw = D._find(C.cards(spark, sf), "text", patterns, "hits")
    rows = raw.select("doc_id", D._shape_hits(patterns, F.col("hits"), False).alias("hits"))
    return D.explode_hits(rows, ["doc_id"]).groupBy("type", "confidence").agg(F.count("*").alias("hits"))


VERHOEFF, LUHN = S._checks()
TWELVE = "concat('2341', lpad((c_custkey % 100000000)::VARCHAR, 8, '0'))"


@query("verhoeff_check", f"SELECT doc_id, ok FROM (SELECT c_custkey AS doc_id, {TWELVE} AS normalized, {VERHOEFF} AS ok FROM customer)")
def verhoeff_check(spark, sf):
    num = C.cat("2341", F.lpad((F.col("c_custkey") % 100000000).cast("string"), 8, "0"))
    return C.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), checks.verhoeff_ok(num).alias("ok"))


@query("luhn_check", f"SELECT doc_id, {LUHN} AS ok FROM (SELECT c_custkey AS doc_id, concat('41111111', lpad(c_custkey::VARCHAR, 8, '0')) AS normalized FROM customer)")
def luhn_check(spark, sf):
    num = C.cat("41111111", F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return C.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), checks.luhn_ok(num).alias("ok"))


@query("context_words", f"""WITH RECURSIVE {S.context_ctes(C.CARDS)} SELECT type, context, count(*) AS hits FROM kept GROUP BY 1, 2""")
def context_words(spark, sf):
    return D.detect_context(C.cards(spark, sf)).groupBy("type", "context").agg(F.count("*").alias("hits"))


@query("same_span_resolution", f"""WITH RECURSIVE {S.base_ctes(C.CARDS)}
 SELECT type, count(*) AS hits, count(DISTINCT concat(doc_id, ':', "start", ':', "end")) AS spans FROM owned GROUP BY type""")
def same_span_resolution(spark, sf):
    patterns = S.cat.shape_catalog()
    raw = D._find(C.cards(spark, sf), "text", patterns, "hits")
    one = raw.select("doc_id", D.resolve_same_span(D._shape_hits(patterns, F.col("hits"), False)).alias("hits"))
    return D.explode_hits(one, ["doc_id"]).groupBy("type").agg(
        F.count("*").alias("hits"), F.count_distinct("doc_id", "start", "end").alias("spans"))


@query("same_span_parity", f"WITH RECURSIVE {S.first_ctes(C.CARDS)} SELECT type, count(*) AS hits FROM kept GROUP BY 1")
def same_span_parity(spark, sf):
    return D.detect_base(C.cards(spark, sf), same_span="first").groupBy("type").agg(F.count("*").alias("hits"))


@query("noise_filter", f"""WITH RECURSIVE {S.base_ctes(C.CARDS)}
 SELECT type, count(*) AS hits FROM sound GROUP BY type""")
def noise_filter(spark, sf):
    patterns = S.cat.shape_catalog()
    raw = D._find(C.cards(spark, sf), "text", patterns, "hits")
    ok = raw.select("doc_id", F.filter(D._shape_hits(patterns, F.col("hits"), False), D.not_noise).alias("hits"))
    return D.explode_hits(ok, ["doc_id"]).groupBy("type").agg(F.count("*").alias("hits"))


@query("dedupe_nearby", f"""WITH RECURSIVE {S.base_ctes(DOCS)}
 SELECT o.type, count(*) AS before_, count(k.doc_id) AS after_ FROM owned o LEFT JOIN kept k
 ON o.doc_id = k.doc_id AND o.type = k.type AND o."start" = k."start" AND o."end" = k."end" GROUP BY o.type""")
def dedupe_nearby(spark, sf):
    patterns = S.cat.shape_catalog()
    raw = D._find(docs(spark, sf), "text", patterns, "hits")
    own = raw.select("doc_id", D._round_confidence(D.resolve_same_span(
        D._shape_hits(patterns, F.col("hits"), False))).alias("hits"))
    both = own.select("doc_id", F.explode_outer(F.concat(
        F.transform("hits", lambda h: F.struct(h["type"].alias("type"), F.lit(0).alias("kept"))),
        F.transform(D.dedupe_nearby(F.col("hits")), lambda h: F.struct(h["type"].alias("type"), F.lit(1).alias("kept"))))).alias("x"))
    return both.filter("x is not null").groupBy("x.type").agg(
        F.count_if(F.col("x.kept") == 0).alias("before_"), F.count_if(F.col("x.kept") == 1).alias("after_"))


LINES = f"SELECT doc_id * 100000 + ln AS doc_id, text FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS ln, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({{src}})))"


@query("detect_by_line", f"""WITH {S.generic_ctes(LINES.format(src=C.CARDS))}
 SELECT k.doc_id // 100000 AS doc_id, (k.doc_id % 100000)::INT AS line_number, count(*)::INT AS pii_count,
  any_value(CASE WHEN length(s.text) > 100 THEN concat(substr(s.text, 1, 100), '...') ELSE s.text END) AS content,
  string_agg(concat(type, '=', value), ';' ORDER BY "start", ord) AS found
 FROM kept k JOIN src s USING (doc_id) GROUP BY k.doc_id""")
def detect_by_line(spark, sf):
    found = F.array_join(F.transform("hits", lambda h: F.concat(h["type"], F.lit("="), h["value"])), ";")
    return U.detect_by_line(C.cards(spark, sf)).select("doc_id", "line_number", "pii_count", "content", found.alias("found"))


@query("line_totals", f"""WITH {S.generic_ctes(LINES.format(src=C.CARDS))}
 SELECT c.doc_id, (length(c.text) - length(replace(c.text, chr(10), '')) + 1)::INT AS total_lines,
  coalesce(h.lines, 0) AS lines_with_pii, coalesce(h.hits, 0) AS total_pii_found
 FROM ({C.CARDS}) c LEFT JOIN (SELECT doc_id // 100000 AS doc_id, count(DISTINCT doc_id) AS lines, count(*) AS hits FROM kept GROUP BY 1) h
 ON c.doc_id = h.doc_id""")
def line_totals(spark, sf):
    return U.line_totals(C.cards(spark, sf))


@query("line_stats", """SELECT doc_id, len(l)::INT AS total_lines,
 len(list_filter(l, lambda x: length(trim(x)) > 0))::INT AS non_empty_lines,
 round(list_sum(list_transform(l, lambda x: length(x))) / len(l), 4) AS average_line_length,
 list_max(list_transform(l, lambda x: length(x)))::INT AS max_line_length
 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def line_stats(spark, sf):
    return U.line_stats(docs(spark, sf)).withColumn("average_line_length", F.round("average_line_length", 4))


PAGES = "SELECT conv_id * 1000 + turn AS doc_id, concat('[Page ', turn, ']', chr(10), 'Contact: 9', lpad(conv_id::VARCHAR, 9, '0'), ' ', text) AS text FROM conversations"


@query("split_pages", """SELECT conv_id AS doc_id, turn::INT AS page, text FROM conversations""")
def split_pages(spark, sf):
    c = C.table(spark, sf, "conversations")
    # one document per conversation, its turns as marked pages
    pages = F.array_sort(F.collect_list(F.struct("turn", F.concat(
        C.cat("[Page ", F.col("turn"), "]\n"), F.col("text")).alias("body"))))
    whole = c.groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_join(F.transform(pages, lambda p: p["body"]), "\n\n").alias("text"))
    return U.split_pages(whole)


@query("pages_processed", """SELECT conv_id AS doc_id, count(*)::INT AS pages_processed FROM conversations GROUP BY conv_id""")
def pages_processed(spark, sf):
    c = C.table(spark, sf, "conversations")
    body = C.cat("\n--- Page ", F.col("turn"), " ---\n", F.col("text"))
    whole = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.collect_list(body), "").alias("text"))
    return U.pages_processed(whole)


@query("detect_by_page", f"""WITH RECURSIVE {S.base_ctes(PAGES)}
 SELECT doc_id // 1000 AS doc_id, (doc_id % 1000)::INT AS page, count(*)::INT AS pii_count,
 string_agg(concat(type, '=', value), ';' ORDER BY "start", confidence DESC, prio) AS found FROM kept GROUP BY kept.doc_id""")
def detect_by_page(spark, sf):
    pages = C.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"),
        C.cat("[Page ", F.col("turn"), "]\nContact: 9", F.lpad(F.col("conv_id").cast("string"), 9, "0"), " ", F.col("text")).alias("text"))
    found = F.array_join(F.transform("hits", lambda h: F.concat(h["type"], F.lit("="), h["value"])), ";")
    return U.detect_by_page(pages).select("doc_id", "page", "pii_count", found.alias("found"))


ELEMENT_ROWS = f"SELECT doc_id * 1000 + element_no AS doc_id, text, kind FROM ({C.ELEMENTS}) WHERE kind IN ('paragraph', 'table_row')"


@query("detect_by_element", f"""WITH {S.generic_ctes(ELEMENT_ROWS)}
 SELECT k.doc_id // 1000 AS doc_id, k.doc_id % 1000 AS element_no, any_value(s.kind) AS kind, count(*)::INT AS pii_count,
 string_agg(concat(type, '=', value), ';' ORDER BY "start", ord) AS found
 FROM kept k JOIN src s USING (doc_id) GROUP BY k.doc_id""")
def detect_by_element(spark, sf):
    found = F.array_join(F.transform("hits", lambda h: F.concat(h["type"], F.lit("="), h["value"])), ";")
    return U.detect_by_element(C.elements(spark, sf)).select("doc_id", "element_no", "kind", "pii_count", found.alias("found"))


@query("element_stats", f"""SELECT doc_id, count(*) FILTER (WHERE kind = 'paragraph') AS total_paragraphs,
 count(DISTINCT CASE WHEN kind = 'table_row' THEN table_no END) AS total_tables, count(DISTINCT section_no) AS total_sections,
 bool_or(kind = 'header') AS has_headers, bool_or(kind = 'footer') AS has_footers FROM ({C.ELEMENTS}) GROUP BY doc_id""")
def element_stats(spark, sf):
    return U.element_stats(C.elements(spark, sf))


@query("valid_ids", f"""SELECT doc_id, regexp_full_match(trim(pan), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AS pan_ok, {VERHOEFF} AS aadhaar_ok FROM (
 SELECT c_custkey AS doc_id, concat(' ABCDE', c_custkey % 20000, 'F ') AS pan, {TWELVE} AS normalized FROM customer)""")
def valid_ids(spark, sf):
    k = F.col("c_custkey")
    return C.table(spark, sf, "customer").select(
        k.alias("doc_id"), checks.valid_pan(C.cat(" ABCDE", k % 20000, "F ")).alias("pan_ok"),
        checks.valid_aadhaar(C.cat("2341", F.lpad((k % 100000000).cast("string"), 8, "0"))).alias("aadhaar_ok"))


def _case(lists, other):
    arms = " ".join(f"WHEN type IN ({', '.join(S.lit(t) for t in ts)}) THEN {S.lit(n)}" for n, ts in lists.items())
    return f"CASE {arms} ELSE {'NULL' if other is None else S.lit(other)} END"


def _taxonomies():
    from ..operators.dedupe import BOARD_CATEGORIES, IMAGE_CATEGORIES, SCATTER_PARTS
    lab, gen = {}, {}
    for n, c, _ in LABELS:
        lab.setdefault(c, []).append(n)
    for n, _, c, *_r in GENERIC:
        gen.setdefault(c, []).append(n)
    scatter = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(type, '{p}')" for p in parts) + f" THEN '{name}'"
        for name, _, parts in SCATTER_PARTS) + " ELSE 'Other' END"
    return _case(lab, None), _case(gen, None), _case(IMAGE_CATEGORIES, "custom"), _case(BOARD_CATEGORIES, "General PII"), scatter


_LAB, _GEN, _IMG, _BRD, _SCT = _taxonomies()


@query("with_category", f"""SELECT type, {_LAB} AS label_category, {_GEN} AS generic_category, {_IMG} AS image_category,
 {_BRD} AS board_category, {_SCT} AS scatter_category, count(*) AS hits FROM ({C.HITS}) GROUP BY ALL""")
def with_category_q(spark, sf):
    h = C.hits(spark, sf).groupBy("type").agg(F.count("*").alias("hits"))
    for t in ("label", "generic", "image", "board", "scatter"):
        h = with_category(h, t, out=f"{t}_category")
    return h


@query("categorize", f"""WITH {S.label_ctes(C.CARDS)} SELECT doc_id, category, label,
 string_agg(value, '|' ORDER BY "start", ord) AS found, count(*) AS n FROM kept GROUP BY 1, 2, 3""")
def categorize_q(spark, sf):
    maps = categorize(D.detect_labels(C.cards(spark, sf)))
    cats = maps.select("doc_id", F.explode("categorized").alias("category", "labels"))
    rows = cats.select("doc_id", "category", F.explode("labels").alias("label", "xs"))
    return rows.select("doc_id", "category", "label", F.array_join(F.transform("xs", lambda x: x["value"]), "|").alias("found"),
                       F.size("xs").cast("bigint").alias("n"))


@query("summarize", f"""WITH {S.generic_ctes(C.CARDS)} SELECT doc_id, type,
 string_agg(value, '|' ORDER BY "start", ord) AS found FROM kept GROUP BY 1, 2""")
def summarize_q(spark, sf):
    return summarize(D.detect_generic(C.cards(spark, sf))).select("doc_id", "type", F.array_join("items", "|").alias("found"))


def _class_sql(text):
    score = lambda ws: " + ".join(f"contains(lower({text}), {S.lit(w)})::INT" for w in ws)
    rows = ", ".join(f"{{'s': {score(ws)}, 'r': {-i}, 'n': '{n}'}}" for i, (n, ws, _, _) in enumerate(DOCUMENT_CLASSES))
    return f"(CASE WHEN list_max([{rows}]).s > 0 THEN list_max([{rows}]).n ELSE 'GENERIC' END)"


@query("classify_document", f"""SELECT doc_id, {_class_sql('text')} AS document_type FROM
 (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM ({C.CARDS}))""")
def classify_q(spark, sf):
    both = docs(spark, sf).select("doc_id", "text").unionByName(
        C.cards(spark, sf).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    return both.select("doc_id", classify_document(F.col("text")).alias("document_type"))


def _alias_sql(t):
    from ..functions.catalogs import TYPE_ALIASES
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_ALIASES.items())
    return f"(CASE upper({t}) {arms} ELSE lower({t}) END)"


_EXPECTED = " UNION ALL ".join(
    f"SELECT '{n}' AS document_type, '{t}' AS etype, {i} AS place, {m} AS most"
    for n, _, ts, m in DOCUMENT_CLASSES for i, t in enumerate(ts))
_KEY = "upper(translate(trim(value), ' -_', ''))"


@query("filter_by_context", f"""WITH RECURSIVE {S.context_ctes(C.CARDS)},
 classed AS (SELECT k.*, {_class_sql('p.text')} AS document_type FROM kept k JOIN prepared p USING (doc_id)),
 fit AS (SELECT c.doc_id, c.document_type, {_alias_sql('c.type')} AS t, c.value, c.confidence, c."start", c.ord, e.place, e.most
  FROM classed c JOIN ({_EXPECTED}) e ON e.document_type = c.document_type AND e.etype = {_alias_sql('c.type')}),
 once AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t, {_KEY}) AS occurrence_count,
  row_number() OVER (PARTITION BY doc_id, t, {_KEY} ORDER BY "start", confidence DESC, ord) AS rn FROM fit),
 gen AS (SELECT *, count(*) OVER (PARTITION BY doc_id, {_alias_sql('type')}, {_KEY}) AS occurrence_count,
  row_number() OVER (PARTITION BY doc_id, {_alias_sql('type')}, {_KEY} ORDER BY "start", confidence DESC, ord) AS rn FROM classed WHERE document_type = 'GENERIC')
 SELECT doc_id, document_type, t AS type, value, confidence, place, occurrence_count FROM once WHERE rn = 1
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, "start", ord) <= most
 UNION ALL SELECT doc_id, document_type, type, value, confidence, 0, occurrence_count FROM gen WHERE rn = 1""")
def filter_by_context_q(spark, sf):
    cards = C.cards(spark, sf)
    return filter_by_context(D.detect_context(cards), cards).select(
        "doc_id", "document_type", "type", "value", "confidence", "place", "occurrence_count")


CELLS = ("SELECT row_number() OVER () AS doc_id, * FROM (SELECT s_suppkey, 's_name' AS column_name, concat(s_name, ' ') AS text FROM supplier "
         "UNION ALL SELECT s_suppkey, 'contact', concat('PAN ABCDE', lpad((s_suppkey % 10000)::VARCHAR, 4, '0'), 'F') FROM supplier "
         "UNION ALL SELECT s_suppkey, 'phone', concat('9', lpad(s_suppkey::VARCHAR, 9, '0')) FROM supplier)")


def _supplier_cells(spark, sf):
    k = F.col("s_suppkey")
    return C.table(spark, sf, "supplier").select(
        "s_suppkey", C.cat(F.col("s_name"), " ").alias("s_name"),
        C.cat("PAN ABCDE", F.lpad((k % 10000).cast("string"), 4, "0"), "F").alias("contact"),
        C.cat("9", F.lpad(k.cast("string"), 9, "0")).alias("phone"))


@query("scan_table", f"""WITH RECURSIVE {S.base_ctes(CELLS)}
 SELECT s.s_suppkey, s.column_name, k.type, k.value, k.confidence FROM kept k JOIN src s USING (doc_id)""")
def scan_table(spark, sf):
    return U.scan_table(_supplier_cells(spark, sf), ["s_suppkey"], ["s_name", "contact", "phone"]).select(
        "s_suppkey", "column_name", "type", "value", "confidence")


@query("column_hit_rate", f"""WITH RECURSIVE {S.base_ctes(CELLS)}
 SELECT s.column_name, k.type, count(*) AS hits, count(DISTINCT k.doc_id) AS cells,
 round(count(DISTINCT k.doc_id) / (SELECT count(*) FROM supplier), 4) AS hit_rate
 FROM kept k JOIN src s USING (doc_id) GROUP BY 1, 2""")
def column_hit_rate(spark, sf):
    return U.column_hit_rate(_supplier_cells(spark, sf), ["s_suppkey"], ["s_name", "contact", "phone"])
