"""Working tables derived from the given ones, in Spark and in SQL.

Each derived table is a pair: a function (spark, folder) -> DataFrame and a SQL
query over the same tables giving the same rows.  All of them grow with the
tables they are made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ["AADHAAR", "PAN", "EMAIL", "PHONE", "IFSC", "UPI", "BANK_ACCOUNT", "CARD_NUMBER", "API_KEY",
         "REFERRAL_CODE", "DOB", "IPV4", "EMPLOYEE_ID", "CUSTOMER_ID"]
FORMATS = ["pdf", "txt", "docx", "csv", "png", "doc"]
PLAN_IDS = ["starter", "professional", "enterprise"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out anew: a table of millions of narrow rows is a few MB in one file, which is one split and one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- customer cards: label documents with identifiers of many kinds ---------
def cards(spark, sf):
    k = F.col("c_custkey")
    six, nine = F.lpad(text(k), 6, "0"), F.lpad(text(k), 9, "0")
    four = F.lpad(text(k % 10000), 4, "0")
    body = cat(
        "Customer ID: CUST", six, "\nName: ", F.col("c_mktsegment"), "\nPAN: ABCDE", four, "F\nPhone: 9", nine,
        "\nIFSC: HDFC0", six, "\nEmail: user", k, "@example.com\nAadhaar: 2341 2341 ", four,
        "\n// Password: pw-", k, "\nAccount: 80", nine, "\nmerchantId: \"TXN", six, "\"\nCard: 4111 1111 1111 ", four,
        "\nDOB: 0", k % 9 + 1, "/1", k % 3, "/19", k % 90 + 10, "\nUPI: pay", k, "@okaxis\nemp EMP", four,
        " MH12AB", four, " TXN80", six, " 10.0.", k % 256, ".", k % 200, "\nGender: male\nVersion: 1.", k % 10,
        "\nTotal: 1,", k % 900 + 100, ".50")
    rows = spread(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    return rows.select(F.col("c_custkey").alias("doc_id"), body.alias("text"))


CARDS = """SELECT c_custkey AS doc_id, concat(
 'Customer ID: CUST', lpad(c_custkey::VARCHAR, 6, '0'), chr(10), 'Name: ', c_mktsegment, chr(10),
 'PAN: ABCDE', lpad((c_custkey % 10000)::VARCHAR, 4, '0'), 'F', chr(10), 'Phone: 9', lpad(c_custkey::VARCHAR, 9, '0'), chr(10),
 'IFSC: HDFC0', lpad(c_custkey::VARCHAR, 6, '0'), chr(10), 'Email: user', c_custkey, '@example.com', chr(10),
 'Aadhaar: 2341 2341 ', lpad((c_custkey % 10000)::VARCHAR, 4, '0'), chr(10), '// Password: pw-', c_custkey, chr(10),
 'Account: 80', lpad(c_custkey::VARCHAR, 9, '0'), chr(10), 'merchantId: "TXN', lpad(c_custkey::VARCHAR, 6, '0'), '"', chr(10),
 'Card: 4111 1111 1111 ', lpad((c_custkey % 10000)::VARCHAR, 4, '0'), chr(10),
 'DOB: 0', c_custkey % 9 + 1, '/1', c_custkey % 3, '/19', c_custkey % 90 + 10, chr(10),
 'UPI: pay', c_custkey, '@okaxis', chr(10), 'emp EMP', lpad((c_custkey % 10000)::VARCHAR, 4, '0'),
 ' MH12AB', lpad((c_custkey % 10000)::VARCHAR, 4, '0'), ' TXN80', lpad(c_custkey::VARCHAR, 6, '0'),
 ' 10.0.', c_custkey % 256, '.', c_custkey % 200, chr(10), 'Gender: male', chr(10),
 'Version: 1.', c_custkey % 10, chr(10), 'Total: 1,', c_custkey % 900 + 100, '.50') AS text FROM customer"""


# --- stored hits, files and batches: supplier = batch, line item = hit ------
def hits(spark, sf):
    li = table(spark, sf, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    kind = pick(TYPES, (p * 7 + F.col("l_linenumber")) % len(TYPES))
    file = p % 40
    value = cat(kind, "-", F.col("l_orderkey") % 97)
    return li.select(
        cat("B", s).alias("batch_id"),
        cat("file_", file, ".", pick(FORMATS, file % len(FORMATS))).alias("filename"),
        file.alias("file_ord"),
        (F.col("l_orderkey") * 10_000_000 + p * 10 + F.col("l_linenumber")).alias("hit_no"),
        kind.alias("type"), value.alias("value"), F.lower(value).alias("normalized"),
        F.round(F.col("l_discount") * 4 + 0.5, 2).alias("confidence"),
        F.col("l_linenumber").alias("page"), F.col("l_shipdate").alias("processed_at"),
        F.when(p % 3 == 0, "Contact").otherwise("Financial").alias("category"))


HITS = f"""SELECT concat('B', l_suppkey) AS batch_id,
 concat('file_', l_partkey % 40, '.', {sql_list(FORMATS)}[(l_partkey % 40) % {len(FORMATS)} + 1]) AS filename,
 l_partkey % 40 AS file_ord, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS hit_no,
 {sql_list(TYPES)}[(l_partkey * 7 + l_linenumber) % {len(TYPES)} + 1] AS type,
 concat({sql_list(TYPES)}[(l_partkey * 7 + l_linenumber) % {len(TYPES)} + 1], '-', l_orderkey % 97) AS value,
 lower(concat({sql_list(TYPES)}[(l_partkey * 7 + l_linenumber) % {len(TYPES)} + 1], '-', l_orderkey % 97)) AS normalized,
 round(l_discount * 4 + 0.5, 2) AS confidence, l_linenumber AS page, l_shipdate AS processed_at,
 CASE WHEN l_partkey % 3 = 0 THEN 'Contact' ELSE 'Financial' END AS category FROM lineitem"""


def files(spark, sf):
    li = table(spark, sf, "lineitem")
    file = F.col("l_partkey") % 40
    g = li.groupBy(F.col("l_suppkey").alias("s"), file.alias("file_ord")).agg(
        F.count("*").alias("pii_count"), F.max("l_linenumber").alias("page_count"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.max("l_shipdate").alias("processed_at"))
    ext = pick(FORMATS, F.col("file_ord") % len(FORMATS))
    return g.select(
        cat("B", F.col("s")).alias("batch_id"), cat("file_", F.col("file_ord"), ".", ext).alias("filename"), "file_ord",
        ((F.col("s") + F.col("file_ord")) % 7 != 0).alias("success"), "pii_count", "page_count", "processed_at",
        (F.col("q") / 4).alias("processing_time"), F.upper(ext).alias("format"))


FILES = f"""SELECT concat('B', s) AS batch_id,
 concat('file_', file_ord, '.', {sql_list(FORMATS)}[file_ord % {len(FORMATS)} + 1]) AS filename, file_ord,
 (s + file_ord) % 7 <> 0 AS success, pii_count, page_count, processed_at, q / 4.0::DOUBLE AS processing_time,
 upper({sql_list(FORMATS)}[file_ord % {len(FORMATS)} + 1]) AS format
 FROM (SELECT l_suppkey AS s, l_partkey % 40 AS file_ord, count(*) AS pii_count, max(l_linenumber) AS page_count,
  sum(l_quantity::BIGINT) AS q, max(l_shipdate) AS processed_at FROM lineitem GROUP BY 1, 2)"""


def batches(spark, sf):
    k = F.col("s_suppkey")
    created = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(days=(k % 1000).cast("int"))
    return table(spark, sf, "supplier").select(
        cat("B", k).alias("batch_id"), cat(" Batch ", k % 5, F.when(k % 2 == 0, " ").otherwise("")).alias("name"),
        F.when(k % 4 == 0, cat("user", F.col("s_nationkey"))).otherwise(
            cat("user", F.col("s_nationkey"), "@example.com")).alias("user_id"),
        F.when(k % 3 == 0, "processing").otherwise("completed").alias("status"),
        created.alias("created_at"), (created + F.expr("INTERVAL '1' HOUR")).alias("updated_at"),
        F.when(k % 5 == 0, created + F.expr("INTERVAL '2' HOUR")).alias("processed_at"))


BATCHES = """SELECT concat('B', s_suppkey) AS batch_id,
 concat(' Batch ', s_suppkey % 5, CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE '' END) AS name,
 CASE WHEN s_suppkey % 4 = 0 THEN concat('user', s_nationkey) ELSE concat('user', s_nationkey, '@example.com') END AS user_id,
 CASE WHEN s_suppkey % 3 = 0 THEN 'processing' ELSE 'completed' END AS status,
 TIMESTAMP '2024-01-01 00:00:00' + to_days((s_suppkey % 1000)::INT) AS created_at,
 TIMESTAMP '2024-01-01 01:00:00' + to_days((s_suppkey % 1000)::INT) AS updated_at,
 CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-01 02:00:00' + to_days((s_suppkey % 1000)::INT) END AS processed_at FROM supplier"""


# --- users, payments, ledger ------------------------------------------------
def users(spark, sf):
    k = F.col("c_custkey")
    day = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(days=(k % 60).cast("int"))
    nine = F.lpad(text(k), 9, "0")
    return table(spark, sf, "customer").select(
        F.when(k < 25, cat("user", k, "@example.com")).otherwise(cat("member", k, "@example.com")).alias("email"),
        F.when(k < 25, cat("user", k)).otherwise(F.col("c_name")).alias("username"), cat("U", k).alias("user_id"),
        F.when(k % 7 == 0, "").otherwise(F.col("c_name")).alias("full_name"),
        F.when(k % 3 == 0, cat("9", nine)).when(k % 3 == 1, cat("+919", nine)).otherwise(cat("919", nine)).alias("phone"),
        F.when(k % 5 == 0, "").otherwise("IN").alias("country"),
        pick(PLAN_IDS, k % 3).alias("plan_id"),
        F.when(k % 3 == 2, F.lit(None)).otherwise(150 + k % 100).cast("bigint").alias("tokens_total"),
        (k % 50).alias("tokens_used"),
        F.when(k % 3 == 2, F.lit(None)).otherwise(150 + k % 100 - k % 50).cast("bigint").alias("tokens_balance"),
        F.when(k % 4 == 0, "2023-12").otherwise("2024-01").alias("token_period"),
        pick(PLAN_IDS, k % 3).alias("plan_type"),
        F.when(k % 6 == 0, "cancelled").otherwise("active").alias("status"),
        F.when(k % 2 == 0, day).alias("expires_at"),
        F.when(k % 8 == 0, False).alias("email_verified"), (k % 9 == 0).alias("enable_2fa"),
        F.when(k % 10 == 0, True).alias("two_factor_enabled"),
        F.when(k % 4 == 1, day).alias("last_login"), F.when(k % 4 == 2, day).alias("updated_at"), day.alias("created_at"))


USERS = f"""SELECT CASE WHEN c_custkey < 25 THEN concat('user', c_custkey, '@example.com') ELSE concat('member', c_custkey, '@example.com') END AS email,
 CASE WHEN c_custkey < 25 THEN concat('user', c_custkey) ELSE c_name END AS username, concat('U', c_custkey) AS user_id,
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS full_name,
 CASE c_custkey % 3 WHEN 0 THEN concat('9', lpad(c_custkey::VARCHAR, 9, '0')) WHEN 1 THEN concat('+919', lpad(c_custkey::VARCHAR, 9, '0'))
  ELSE concat('919', lpad(c_custkey::VARCHAR, 9, '0')) END AS phone,
 CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'IN' END AS country, {sql_list(PLAN_IDS)}[c_custkey % 3 + 1] AS plan_id,
 CASE WHEN c_custkey % 3 <> 2 THEN 150 + c_custkey % 100 END AS tokens_total, c_custkey % 50 AS tokens_used,
 CASE WHEN c_custkey % 3 <> 2 THEN 150 + c_custkey % 100 - c_custkey % 50 END AS tokens_balance,
 CASE WHEN c_custkey % 4 = 0 THEN '2023-12' ELSE '2024-01' END AS token_period,
 {sql_list(PLAN_IDS)}[c_custkey % 3 + 1] AS plan_type,
 CASE WHEN c_custkey % 6 = 0 THEN 'cancelled' ELSE 'active' END AS status,
 CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INT) END AS expires_at,
 CASE WHEN c_custkey % 8 = 0 THEN false END AS email_verified, c_custkey % 9 = 0 AS enable_2fa,
 CASE WHEN c_custkey % 10 = 0 THEN true END AS two_factor_enabled,
 CASE WHEN c_custkey % 4 = 1 THEN TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INT) END AS last_login,
 CASE WHEN c_custkey % 4 = 2 THEN TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INT) END AS updated_at,
 TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INT) AS created_at FROM customer"""


def payments(spark, sf):
    k = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.when(k < 25, cat("user", k, "@example.com")).otherwise(cat("member", k, "@example.com")).alias("user_email"),
        cat("pay_", F.col("o_orderkey")).alias("payment_id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_paise"),
        pick(PLAN_IDS, F.col("o_orderkey") % 3).alias("plan_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "yearly").otherwise("monthly").alias("billing_period"),
        F.col("o_orderdate").alias("created_at"))


PAYMENTS = f"""SELECT CASE WHEN o_custkey < 25 THEN concat('user', o_custkey, '@example.com') ELSE concat('member', o_custkey, '@example.com') END AS user_email,
 concat('pay_', o_orderkey) AS payment_id, round(o_totalprice * 100)::BIGINT AS amount_paise,
 {sql_list(PLAN_IDS)}[o_orderkey % 3 + 1] AS plan_id,
 CASE WHEN o_orderkey % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS billing_period, o_orderdate AS created_at FROM orders"""


def actions(spark, sf):
    e = table(spark, sf, "events")
    action = (
        F.when(F.col("event_type") == "signup", "create_batch").when(F.col("event_type") == "click", "scan_file")
        .when(F.col("event_type") == "view", "download_masked_file").when(F.col("event_type") == "purchase", "lock_json")
        .otherwise("no_such_action"))
    return e.select("event_id", "ts", "user_id", action.alias("action"))


ACTIONS = """SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'create_batch' WHEN 'click' THEN 'scan_file'
 WHEN 'view' THEN 'download_masked_file' WHEN 'purchase' THEN 'lock_json' ELSE 'no_such_action' END AS action FROM events"""


def ledger(spark, sf):
    """Signed entries: purchases credit, the rest debit."""
    e = table(spark, sf, "events")
    amount = F.when(F.col("event_type") == "purchase", 500).otherwise(-(F.col("event_id") % 50))
    return e.select(
        F.col("event_id").alias("entry_id"), text("user_id").alias("user_id"), amount.cast("bigint").alias("amount"),
        F.create_map(F.lit("payment_id"), cat("pay_", F.col("event_id") * 3)).alias("metadata"), F.col("ts").alias("created_at"))


LEDGER = """SELECT event_id AS entry_id, user_id::VARCHAR AS user_id,
 CASE WHEN event_type = 'purchase' THEN 500 ELSE -(event_id % 50) END AS amount,
 concat('pay_', event_id * 3) AS payment_id, ts AS created_at FROM events"""


def requests(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("endpoint"), (F.col("user_id") % 4).alias("client"))


REQUESTS = "SELECT event_id, ts, event_type AS endpoint, user_id % 4 AS client FROM events"


# --- document structure: conversations as paragraphs, rows, headers ---------
def elements(spark, sf):
    t = F.col("turn")
    kind = F.when(t % 4 == 0, "paragraph").when(t % 4 == 1, "table_row").when(t % 4 == 2, "header").otherwise("footer")
    body = F.concat(F.col("text"), cat("\nPhone: 9", F.lpad(text(F.col("conv_id")), 9, "0"), " user name: Ann Lee"))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), t.alias("element_no"), kind.alias("kind"), (t % 3).alias("table_no"),
        (t % 2).alias("section_no"), body.alias("text"))


ELEMENTS = """SELECT conv_id AS doc_id, turn AS element_no,
 ['paragraph', 'table_row', 'header', 'footer'][turn % 4 + 1] AS kind, turn % 3 AS table_no, turn % 2 AS section_no,
 concat(text, chr(10), 'Phone: 9', lpad(conv_id::VARCHAR, 9, '0'), ' user name: Ann Lee') AS text FROM conversations"""


# --- text blocks, as a recogniser would give them ---------------------------
def blocks(spark, sf):
    c = table(spark, sf, "conversations")
    body = F.when(F.col("turn") == 0, cat(F.col("text"), " CUST", F.lpad(text(F.col("conv_id")), 6, "0"))).otherwise(F.col("text"))
    return c.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("line_number"), body.alias("text"),
        (0.5 + (F.col("conv_id") + F.col("turn")) % 5 / 10).alias("confidence"),
        F.struct((F.col("turn") * 10).cast("int").alias("x"), (F.col("turn") * 20).cast("int").alias("y"),
                 F.length("text").alias("width"), F.lit(18).alias("height")).alias("bbox"))


BLOCKS = """SELECT conv_id AS doc_id, turn::INT AS line_number,
 CASE WHEN turn = 0 THEN concat(text, ' CUST', lpad(conv_id::VARCHAR, 6, '0')) ELSE text END AS text,
 0.5 + (conv_id + turn) % 5 / 10.0::DOUBLE AS confidence, (turn * 10)::INT AS x, (turn * 20)::INT AS y, length(text)::INT AS width,
 18 AS height FROM conversations"""


# --- uploaded files ----------------------------------------------------------
def uploads(spark, sf):
    k = F.col("p_partkey")
    ext = pick(["pdf", "TXT", "exe", "csv", "png"], k % 5)
    folder = pick(["up/", "../", "/abs/", "a;b/", "a/../"], k % 7)
    return table(spark, sf, "part").select(
        k.alias("file_id"), cat("B", k % 20).alias("batch_id"),
        cat(F.coalesce(folder, F.lit("")), F.col("p_name"), "é ", k, ".", ext).alias("path"),
        cat(F.col("p_name"), " ", k % 300, ".", ext).alias("filename"),
        (F.col("p_size") * (k % 13) * 1_000_000).cast("bigint").alias("length"))


UPLOADS = """SELECT p_partkey AS file_id, concat('B', p_partkey % 20) AS batch_id,
 concat(coalesce(['up/', '../', '/abs/', 'a;b/', 'a/../'][p_partkey % 7 + 1], ''), p_name, 'é ', p_partkey, '.', ['pdf', 'TXT', 'exe', 'csv', 'png'][p_partkey % 5 + 1]) AS path,
 concat(p_name, ' ', p_partkey % 300, '.', ['pdf', 'TXT', 'exe', 'csv', 'png'][p_partkey % 5 + 1]) AS filename,
 (p_size * (p_partkey % 13) * 1000000)::BIGINT AS length FROM part"""
