"""Queries of the usage ledger and the account tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as U
from ..operators import ledger as L
from ..operators import limits as R
from . import corpora as C
from .registry import query

NOW = "2024-01-20 12:00:00"
PRICES = ", ".join(f"('{a}', {p})" for a, p in L.ACTION_PRICES)
PLANS = ", ".join(f"('{i}', '{n}', {p}, {y}, {'NULL' if t is None else t})" for i, n, p, y, t, _ in L.PLANS)
PLAN_T = f"(VALUES {PLANS}) AS p(plan_id, plan_name, price_inr, price_inr_yearly, monthly_tokens)"


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


@query("price_actions", f"SELECT event_id, user_id, a.action, price FROM ({C.ACTIONS}) a JOIN (VALUES {PRICES}) p(action, price) ON a.action = p.action")
def price_actions(spark, sf):
    return L.price_actions(C.actions(spark, sf)).select("event_id", "user_id", "action", "price")


@query("unknown_actions", f"SELECT action, count(*) AS n FROM ({C.ACTIONS}) WHERE action = 'no_such_action' GROUP BY 1")
def unknown_actions(spark, sf):
    return L.unknown_actions(C.actions(spark, sf)).groupBy("action").agg(F.count("*").alias("n"))


@query("running_balance", f"""SELECT entry_id, user_id, amount, sum(amount) OVER (PARTITION BY user_id ORDER BY created_at, entry_id ROWS UNBOUNDED PRECEDING)::BIGINT AS balance_after
 FROM ({C.LEDGER})""")
def running_balance(spark, sf):
    return L.running_balance(C.ledger(spark, sf)).select("entry_id", "user_id", "amount", "balance_after")


DEBITS = f"""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
 CASE WHEN action = 'create_batch' THEN -100 ELSE price END AS amount FROM ({C.ACTIONS}) a JOIN (VALUES {PRICES}) p(action, price) USING (action)"""


def _debits(spark, sf):
    e = L.price_actions(C.actions(spark, sf))
    amount = F.when(F.col("action") == "create_batch", -100).otherwise(F.col("price"))
    return e.select("event_id", "ts", "user_id", amount.cast("bigint").alias("amount"),
                    (F.col("user_id") % 10 == 0).alias("unlimited"), F.lit(150).cast("bigint").alias("start_balance"))


ADMITTED = f"""WITH RECURSIVE d AS ({DEBITS}), w AS (
 SELECT user_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, 0::BIGINT AS amount, true AS admitted, 150::BIGINT AS balance FROM (SELECT DISTINCT user_id FROM d)
 UNION ALL SELECT d.user_id, d.rn, d.event_id, d.amount, d.user_id % 10 = 0 OR d.amount <= 0 OR w.balance >= d.amount,
  CASE WHEN d.user_id % 10 = 0 OR NOT (d.amount <= 0 OR w.balance >= d.amount) THEN w.balance ELSE w.balance - d.amount END
 FROM w JOIN d ON d.user_id = w.user_id AND d.rn = w.rn + 1)"""


@query("admit_debits", f"{ADMITTED} SELECT event_id, user_id, amount, admitted, CASE WHEN user_id % 10 <> 0 THEN balance END AS balance_after FROM w WHERE rn > 0")
def admit_debits(spark, sf):
    return L.admit_debits(_debits(spark, sf)).select("event_id", "user_id", "amount", "admitted", "balance_after")


@query("usage_after", f"""{ADMITTED} SELECT user_id, coalesce(sum(amount) FILTER (WHERE admitted AND amount > 0), 0)::BIGINT AS tokens_used,
 count(*) FILTER (WHERE NOT admitted) AS refused FROM w WHERE rn > 0 GROUP BY 1""")
def usage_after(spark, sf):
    return L.usage_after(L.admit_debits(_debits(spark, sf)))


DUE = "(monthly_tokens IS NOT NULL AND token_period IS DISTINCT FROM '2024-01')"


@query("monthly_reset", f"""SELECT email, CASE WHEN {DUE} THEN '2024-01' ELSE token_period END AS token_period,
 tokens_balance + CASE WHEN {DUE} THEN monthly_tokens ELSE 0 END AS tokens_balance, tokens_total + CASE WHEN {DUE} THEN monthly_tokens ELSE 0 END AS tokens_total
 FROM ({C.USERS}) u LEFT JOIN {PLAN_T} ON u.plan_id = p.plan_id""")
def monthly_reset(spark, sf):
    return L.monthly_reset(C.users(spark, sf), "2024-01").select("email", "token_period", "tokens_balance", "tokens_total")


@query("reset_entries", f"""SELECT email AS user_id, 'credit' AS type, monthly_tokens AS amount, 'plan_reset' AS reason, u.plan_id FROM ({C.USERS}) u
 JOIN {PLAN_T} ON u.plan_id = p.plan_id WHERE {DUE}""")
def reset_entries(spark, sf):
    return L.reset_entries(C.users(spark, sf), "2024-01", now()).select(
        "user_id", "type", "amount", "reason", F.col("metadata")["plan_id"].alias("plan_id"))


def _plan_requests(spark, sf):
    u = C.users(spark, sf)
    n = F.length("email")
    return u.filter(n % 2 == 0).select("email", C.pick(["Pro", " FREE ", "unlimited", "nonsense"], n / 2 % 4).alias("plan"),
                                       C.pick(["Yearly", "monthly", None], n % 3).alias("billing_period"))


@query("assign_plan", f"""WITH u AS ({C.USERS}), r AS (SELECT email, ['professional', 'starter', 'enterprise', 'nonsense'][(length(email) // 2) % 4 + 1] AS new_plan
  FROM u WHERE length(email) % 2 = 0), c AS (SELECT r.email, p.* FROM r JOIN {PLAN_T} ON r.new_plan = p.plan_id)
 SELECT u.email, coalesce(c.plan_id, u.plan_id) AS plan_id, CASE WHEN c.email IS NULL THEN u.tokens_used ELSE 0 END AS tokens_used,
 CASE WHEN c.email IS NULL THEN u.tokens_balance ELSE c.monthly_tokens END AS tokens_balance,
 CASE WHEN c.email IS NULL THEN u.token_period ELSE '2024-02' END AS token_period FROM u LEFT JOIN c USING (email)""")
def assign_plan(spark, sf):
    return L.assign_plan(C.users(spark, sf), _plan_requests(spark, sf), "2024-02").select(
        "email", "plan_id", "tokens_used", "tokens_balance", "token_period")


@query("allocation_entries", f"""WITH u AS ({C.USERS}), r AS (SELECT email, ['professional', 'starter', 'enterprise', 'nonsense'][(length(email) // 2) % 4 + 1] AS new_plan
  FROM u WHERE length(email) % 2 = 0), c AS (SELECT r.email, p.* FROM r JOIN {PLAN_T} ON r.new_plan = p.plan_id)
 SELECT u.email AS user_id, 'credit' AS type, coalesce(c.monthly_tokens, u.tokens_balance)::BIGINT AS amount, coalesce(c.plan_id, u.plan_id) AS plan_id, TIMESTAMP '{NOW}' AS created_at
 FROM u LEFT JOIN c USING (email) WHERE CASE WHEN c.email IS NULL THEN u.tokens_balance ELSE c.monthly_tokens END IS NOT NULL""")
def allocation_entries(spark, sf):
    assigned = L.assign_plan(C.users(spark, sf), _plan_requests(spark, sf), "2024-02")
    return L.allocation_entries(assigned, now()).select(
        "user_id", "type", "amount", F.col("metadata")["plan_id"].alias("plan_id"), "created_at")


@query("lock_gate", f"""WITH a AS (SELECT event_id, action, CASE WHEN user_id % 3 = 0 THEN concat(' User', user_id, '@Example.com ') WHEN user_id % 3 = 1 THEN concat('member', user_id, '@example.com')
  ELSE concat('nobody', user_id) END AS email FROM ({C.ACTIONS})), u AS ({C.USERS})
 SELECT a.event_id, CASE WHEN a.action <> 'lock_json' THEN NULL WHEN u.email IS NULL THEN 'USER_NOT_FOUND' WHEN u.plan_id = 'starter' THEN 'PLAN_RESTRICTION' END AS error,
 CASE WHEN a.action = 'lock_json' AND u.plan_id = 'starter' THEN 'Lock Json is only available on Professional and Enterprise plans.' END AS message
 FROM a LEFT JOIN u ON u.email = lower(trim(a.email))""")
def lock_gate(spark, sf):
    k = F.col("user_id")
    email = F.when(k % 3 == 0, C.cat(" User", k, "@Example.com ")).when(k % 3 == 1, C.cat("member", k, "@example.com")).otherwise(C.cat("nobody", k))
    asked = C.actions(spark, sf).withColumn("email", email)
    return L.lock_gate(asked, C.users(spark, sf)).select("event_id", "error", "message")


@query("token_summary", f"""SELECT email, u.plan_id, plan_name, monthly_tokens, price_inr, tokens_total, tokens_used,
 CASE WHEN monthly_tokens IS NULL THEN 'unlimited' ELSE coalesce(tokens_balance, 0)::VARCHAR END AS tokens_balance FROM ({C.USERS}) u JOIN {PLAN_T} ON u.plan_id = p.plan_id""")
def token_summary(spark, sf):
    return L.token_summary(C.users(spark, sf))


FORCE = f"CASE WHEN status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') THEN plan_type ELSE 'starter' END"


@query("scan_limit", f"""WITH s AS (SELECT CASE WHEN user_id < 25 THEN concat('user', user_id, '@example.com') ELSE concat('member', user_id, '@example.com') END AS email,
  count(*) * 10 AS scans FROM events GROUP BY 1), l AS (SELECT u.email, {FORCE} AS plan_type, coalesce(s.scans, 0) AS scans FROM ({C.USERS}) u LEFT JOIN s USING (email)),
 m AS (SELECT *, CASE plan_type WHEN 'starter' THEN 500 WHEN 'professional' THEN 10000 ELSE -1 END AS cap FROM l)
 SELECT email, plan_type, scans, cap = -1 OR scans < cap AS allowed,
 CASE WHEN NOT (cap = -1 OR scans < cap) THEN concat('Monthly scan limit (', cap, ') reached. Please upgrade your plan.') END AS message FROM m""")
def scan_limit(spark, sf):
    k = F.col("user_id")
    email = F.when(k < 25, C.cat("user", k, "@example.com")).otherwise(C.cat("member", k, "@example.com"))
    scans = C.table(spark, sf, "events").groupBy(email.alias("email")).agg((F.count("*") * 10).alias("scans"))
    return L.scan_limit(C.users(spark, sf), scans, now())


@query("feature_access", f"""SELECT email, t AS plan_type, t <> 'starter' AS api_access, t <> 'starter' AS batch_processing, t <> 'starter' AS custom_pii_patterns,
 t <> 'starter' AS password_protected_exports, t <> 'starter' AS hash_masking, CASE t WHEN 'starter' THEN 'pdf,docx,txt,csv'
 WHEN 'professional' THEN 'pdf,docx,doc,txt,csv,png,jpg,jpeg,svg' ELSE 'pdf,docx,doc,txt,csv,png,jpg,jpeg,svg,json' END AS formats
 FROM (SELECT email, {FORCE} AS t FROM ({C.USERS}))""")
def feature_access(spark, sf):
    return L.feature_access(C.users(spark, sf), now()).withColumn("formats", F.array_join("formats", ","))


def _flagged(spark, sf):
    n = F.length("email")
    own = F.when(n % 3 == 0, F.create_map(F.lit("lock_json"), F.lit(True))).when(
        n % 3 == 1, F.create_map(*[F.lit(x) for k in L.PLANS[0][5] for x in (k, False)]))
    return C.users(spark, sf).withColumn("features", own)


@query("merge_features", f"""SELECT email, concat('advanced_analysis=', b, ';export_json=', b, ';lock_json=', CASE WHEN n = 0 THEN 'true' ELSE b END,
 ';log_records=', g, ';unlock_json=', b) AS features, n <> 1 AS updated FROM (
 SELECT email, length(email) % 3 AS n, CASE WHEN length(email) % 3 = 1 OR plan_id = 'starter' THEN 'false' ELSE 'true' END AS b,
 CASE WHEN length(email) % 3 <> 1 AND plan_id = 'enterprise' THEN 'true' ELSE 'false' END AS g FROM ({C.USERS}))""")
def merge_features(spark, sf):
    from .analytics_queries import entries
    return L.merge_features(_flagged(spark, sf)).select("email", entries(F.col("features")).alias("features"), "updated")


@query("merge_counts", f"SELECT count(*) FILTER (WHERE length(email) % 3 <> 1) AS updated, count(*) FILTER (WHERE length(email) % 3 = 1) AS skipped FROM ({C.USERS})")
def merge_counts(spark, sf):
    return L.merge_counts(L.merge_features(_flagged(spark, sf)))


@query("subscription_expiry", f"SELECT payment_id, created_at + to_days(CASE WHEN billing_period = 'yearly' THEN 365 ELSE 30 END) AS expires_at FROM ({C.PAYMENTS})")
def subscription_expiry(spark, sf):
    return C.payments(spark, sf).select("payment_id", L.subscription_expiry(
        F.col("created_at"), F.col("billing_period")).alias("expires_at"))


@query("order_amount", f"""SELECT payment_id, CASE WHEN billing_period = 'yearly' THEN price_inr_yearly ELSE price_inr END AS amount_inr
 FROM ({C.PAYMENTS}) o JOIN {PLAN_T} ON o.plan_id = p.plan_id""")
def order_amount(spark, sf):
    return L.order_amount(C.payments(spark, sf)).select("payment_id", "amount_inr")


@query("addon_amount", f"SELECT payment_id, amount_paise * 1 AS price FROM ({C.PAYMENTS})")
def addon_amount(spark, sf):
    return C.payments(spark, sf).select("payment_id", L.addon_amount(F.col("amount_paise")).alias("price"))


@query("payment_history", f"""SELECT user_email, payment_id, amount_paise, row_number() OVER (PARTITION BY user_email ORDER BY created_at DESC, payment_id)::INT AS place
 FROM ({C.PAYMENTS}) QUALIFY place <= 50""")
def payment_history(spark, sf):
    return L.payment_history(C.payments(spark, sf)).select("user_email", "payment_id", "amount_paise", "place")


@query("invoice_rows", f"SELECT p.payment_id, p.user_email, u.full_name, u.phone, p.amount_paise FROM ({C.PAYMENTS}) p JOIN ({C.USERS}) u ON u.email = p.user_email")
def invoice_rows(spark, sf):
    return L.invoice_rows(C.payments(spark, sf), C.users(spark, sf)).select(
        "payment_id", "user_email", "full_name", "phone", "amount_paise")


@query("payments_by_month", f"""SELECT user_email, strftime(date_trunc('month', created_at), '%B %Y') AS month, count(*) AS payments,
 concat('₹', sum(amount_paise)::BIGINT // 100, '.', lpad((sum(amount_paise)::BIGINT % 100)::VARCHAR, 2, '0')) AS amount FROM ({C.PAYMENTS}) GROUP BY user_email, date_trunc('month', created_at)""")
def payments_by_month(spark, sf):
    return L.payments_by_month(C.payments(spark, sf))


AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts))"


@query("time_ago", f"""SELECT event_id, CASE WHEN mins < 1 THEN 'Just now' WHEN mins < 60 THEN concat(mins, CASE WHEN mins = 1 THEN ' minute ago' ELSE ' minutes ago' END)
 WHEN hours < 24 THEN concat(hours, CASE WHEN hours = 1 THEN ' hour ago' ELSE ' hours ago' END) WHEN days < 7 THEN concat(days, CASE WHEN days = 1 THEN ' day ago' ELSE ' days ago' END)
 WHEN days < 30 THEN concat(days // 7, CASE WHEN days // 7 = 1 THEN ' week ago' ELSE ' weeks ago' END) ELSE strftime(ts, '%Y-%m-%d') END AS ago FROM (
 SELECT event_id, ts, floor({AGE} / 60000000)::BIGINT AS mins, floor({AGE} / 3600000000)::BIGINT AS hours, floor({AGE} / 86400000000)::BIGINT AS days FROM events)""")
def time_ago(spark, sf):
    return C.table(spark, sf, "events").select("event_id", L.time_ago(F.col("ts"), now()).alias("ago"))


@query("uncredited_payments", f"SELECT payment_id FROM ({C.PAYMENTS}) p WHERE NOT EXISTS (SELECT 1 FROM ({C.LEDGER}) l WHERE l.payment_id = p.payment_id)")
def uncredited_payments(spark, sf):
    return L.uncredited_payments(C.payments(spark, sf), C.ledger(spark, sf)).select("payment_id")


IDS = f"SELECT DISTINCT CASE length(full_name) % 2 + length(phone) % 2 WHEN 0 THEN email WHEN 1 THEN username ELSE right(phone, 10) END AS identifier FROM ({C.USERS}) UNION SELECT phone FROM ({C.USERS})"
DIG = "regexp_replace(identifier, '[^0-9]', '', 'g')"


@query("resolve_user", f"""WITH u AS ({C.USERS}), i AS (SELECT DISTINCT identifier FROM ({IDS})), f AS (
 SELECT identifier, email, 1 AS r FROM i JOIN u ON u.email = identifier UNION ALL SELECT identifier, email, 2 FROM i JOIN u ON u.username = identifier
 UNION ALL SELECT identifier, email, 3 FROM i JOIN u ON length({DIG}) >= 10 AND u.phone IN ({DIG}, concat('+91', {DIG}), concat('91', {DIG})))
 SELECT identifier, email, r AS matched_by FROM f QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY r, email) = 1""")
def resolve_user(spark, sf):
    u = C.users(spark, sf)
    n = F.length("full_name") % 2 + F.length("phone") % 2
    ids = u.select(F.explode(F.array(F.when(n == 0, F.col("email")).when(n == 1, F.col("username")).otherwise(
        F.right("phone", F.lit(10))), F.col("phone"))).alias("identifier"))
    return U.resolve_user(ids, u)


@query("normalize_phone", f"""SELECT email, CASE WHEN ok THEN concat('+', cc, loc) END AS e164, CASE WHEN ok THEN loc END AS local_digits FROM (
 SELECT email, loc, cc, cc IS NOT NULL AND length(concat(cc, loc)) BETWEEN 6 AND 15 AS ok FROM (SELECT email, regexp_replace(phone, '[^0-9]', '', 'g') AS loc,
 CASE WHEN length(email) % 2 = 0 THEN '44' WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) = 10 THEN '91' END AS cc FROM ({C.USERS})))""")
def normalize_phone(spark, sf):
    p = U.normalize_phone(F.col("phone"), F.when(F.length("email") % 2 == 0, "+44"))
    return C.users(spark, sf).select("email", p["e164"].alias("e164"), p["local_digits"].alias("local_digits"))


@query("duplicate_names", f"SELECT user_id, lower(trim(name)) AS name, count(*) AS batches FROM ({C.BATCHES}) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return U.duplicate_names(C.batches(spark, sf))


GONE = f"SELECT * FROM ({C.USERS}) WHERE length(email) % 3 = 0"


@query("erase_user", f"""WITH g AS ({GONE}), n AS (SELECT email AS who FROM g UNION SELECT username FROM g)
 SELECT 'users' AS name, count(*) AS rows_left FROM ({C.USERS}) WHERE email NOT IN (SELECT email FROM g)
 UNION ALL SELECT 'batches', count(*) FROM ({C.BATCHES}) WHERE user_id NOT IN (SELECT who FROM n)
 UNION ALL SELECT 'payments', count(*) FROM ({C.PAYMENTS}) WHERE user_email NOT IN (SELECT who FROM n)
 UNION ALL SELECT 'tombstones', count(*) FROM g""")
def erase_user(spark, sf):
    u = C.users(spark, sf)
    requests = u.filter(F.length("email") % 3 == 0).select("email", F.lit("asked").alias("reason"))
    left, users, stones = U.erase_user(
        {"batches": (C.batches(spark, sf), ["user_id"]), "payments": (C.payments(spark, sf), ["user_email"])}, u, requests, now())
    out = None
    for name, frame in {"users": users, "tombstones": stones, **left}.items():
        row = frame.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("name"), "rows_left")
        out = row if out is None else out.unionByName(row)
    return out


@query("merge_tombstones", f"""SELECT email, CASE WHEN length(email) % 2 = 0 THEN 'later' ELSE 'first' END AS reason,
 TIMESTAMP '{NOW}' + CASE WHEN length(email) % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS deleted_at FROM ({C.USERS}) WHERE length(email) % 3 < 2""")
def merge_tombstones(spark, sf):
    n = F.length("email")
    stones = lambda rows, reason, at: rows.select("email", "full_name", "username", F.lit(reason).alias("reason"), at.alias("deleted_at"))
    gone = C.users(spark, sf).filter(n % 3 < 2)
    later = stones(gone.filter(n % 2 == 0), "later", now() + F.expr("INTERVAL '1' DAY"))
    return U.merge_tombstones(stones(gone, "first", now()), later).select("email", "reason", "deleted_at")


@query("profile_flags", f"""SELECT email, email <> '' AND coalesce(email_verified, true) AS mail_verified, full_name <> '' AND email <> '' AND country <> '' AS profile_complete,
 coalesce(enable_2fa, false) OR coalesce(two_factor_enabled, false) AS two_factor FROM ({C.USERS})""")
def profile_flags(spark, sf):
    return U.profile_flags(C.users(spark, sf)).select("email", "mail_verified", "profile_complete", "two_factor")


@query("user_export", f"""WITH u AS ({C.USERS}), b AS ({C.BATCHES}), m AS (SELECT DISTINCT u.email, b.batch_id, b.created_at FROM u JOIN b ON b.user_id IN (u.email, u.username, u.user_id)),
 t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY email ORDER BY created_at DESC, batch_id) <= 50),
 s AS (SELECT user_id, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END)::BIGINT AS credited, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END)::BIGINT AS debited FROM ({C.LEDGER}) GROUP BY 1)
 SELECT u.email, u.full_name, strftime(u.created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, s.credited, s.debited, any_value(g.batches) AS batches
 FROM u LEFT JOIN s ON u.email = CASE WHEN s.user_id::BIGINT < 25 THEN concat('user', s.user_id, '@example.com') ELSE concat('member', s.user_id, '@example.com') END
 LEFT JOIN (SELECT email, string_agg(batch_id, ',' ORDER BY created_at DESC, batch_id) AS batches FROM t GROUP BY 1) g ON g.email = u.email GROUP BY ALL""")
def user_export(spark, sf):
    k = F.col("user_id").cast("bigint")
    ledger = C.ledger(spark, sf).withColumn("user_id", F.when(k < 25, C.cat("user", k, "@example.com")).otherwise(
        C.cat("member", k, "@example.com")))
    users = C.users(spark, sf).withColumn("password", F.lit("secret"))
    out = U.user_export(users, C.batches(spark, sf), ledger)
    assert "password" not in out.schema["profile"].dataType.names
    return out.select("email", "profile.full_name", "profile.created_at", "credited", "debited",
                      F.array_join(F.transform("batches", lambda b: b["batch_id"]), ",").alias("batches"))


RATE = 3
HOUR = 3600


@query("rate_screen", f"""SELECT event_id, count(*) OVER (PARTITION BY endpoint, client ORDER BY epoch_us(ts) RANGE BETWEEN {HOUR * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS recent
 FROM ({C.REQUESTS})""")
def rate_screen(spark, sf):
    return R.rate_screen(C.requests(spark, sf), RATE, HOUR).select("event_id", "recent")


@query("rate_limit", f"""WITH RECURSIVE d AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY endpoint, client ORDER BY ts, event_id) AS rn FROM ({C.REQUESTS})),
 w AS (SELECT endpoint, client, 0::BIGINT AS rn, -1::BIGINT AS event_id, false AS admitted, []::BIGINT[] AS live FROM (SELECT DISTINCT endpoint, client FROM d)
 UNION ALL SELECT d.endpoint, d.client, d.rn, d.event_id, len(list_filter(w.live, lambda x: d.t - x < {HOUR * 1_000_000})) < {RATE},
  CASE WHEN len(list_filter(w.live, lambda x: d.t - x < {HOUR * 1_000_000})) < {RATE} THEN list_append(list_filter(w.live, lambda x: d.t - x < {HOUR * 1_000_000}), d.t)
   ELSE list_filter(w.live, lambda x: d.t - x < {HOUR * 1_000_000}) END
 FROM w JOIN d ON d.endpoint = w.endpoint AND d.client = w.client AND d.rn = w.rn + 1)
 SELECT event_id, admitted FROM w WHERE rn > 0""")
def rate_limit(spark, sf):
    return R.rate_limit(C.requests(spark, sf), RATE, HOUR).select("event_id", "admitted")


@query("rate_limit_counter", f"""WITH RECURSIVE d AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY endpoint, client ORDER BY ts, event_id) AS rn FROM ({C.REQUESTS})),
 w AS (SELECT endpoint, client, rn, event_id, 1 AS n, t AS opened FROM d WHERE rn = 1
 UNION ALL SELECT d.endpoint, d.client, d.rn, d.event_id, CASE WHEN d.t - w.opened >= {HOUR * 1_000_000} THEN 1 ELSE w.n + 1 END,
  CASE WHEN d.t - w.opened >= {HOUR * 1_000_000} THEN d.t ELSE w.opened END
 FROM w JOIN d ON d.endpoint = w.endpoint AND d.client = w.client AND d.rn = w.rn + 1)
 SELECT event_id, n <= {RATE} AS admitted FROM w""")
def rate_limit_counter(spark, sf):
    return R.rate_limit_counter(C.requests(spark, sf), RATE, HOUR).select("event_id", "admitted")
