"""Usage ledger: prices, balances, plans, limits, payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .admission import admit
from .running import running_totals

# Cost of each metered action.
ACTION_PRICES = [
    ("lock_json", 50), ("unlock_json", 50), ("download_masked_file", 5),
    ("scan_file", 2), ("create_batch", 5), ("generate_report", 100),
]
# Price of an added token, and all formats of a plan without a list.
ADDON_PRICE_INR = 1
# Plans.  (id, name, monthly price, yearly price, monthly tokens, features)
PLANS = [
    ("starter", "Starter", 0, 0, 150, {
        "export_json": False, "lock_json": False, "unlock_json": False, "advanced_analysis": False, "log_records": False}),
    ("professional", "Professional", 999, 9950, 2000, {
        "export_json": True, "lock_json": True, "unlock_json": True, "advanced_analysis": True, "log_records": False}),
    ("enterprise", "Enterprise", 4999, 49790, None, {
        "export_json": True, "lock_json": True, "unlock_json": True, "advanced_analysis": True, "log_records": True}),
]
# Plan limits; -1 stands for unlimited.
PLAN_LIMITS = [
    {"plan_type": "starter", "max_scans_per_month": 500, "api_access": False, "batch_processing": False,
     "custom_pii_patterns": False, "team_members": 1, "masking_options": ["blur"],
     "password_protected_exports": False, "priority_support": False,
     "file_formats": ["pdf", "docx", "txt", "csv"]},
    {"plan_type": "professional", "max_scans_per_month": 10000, "api_access": True, "batch_processing": True,
     "custom_pii_patterns": True, "team_members": 15, "masking_options": ["blur", "hash"],
     "password_protected_exports": True, "priority_support": True,
     "file_formats": ["pdf", "docx", "doc", "txt", "csv", "png", "jpg", "jpeg", "svg"]},
    {"plan_type": "enterprise", "max_scans_per_month": -1, "api_access": True, "batch_processing": True,
     "custom_pii_patterns": True, "team_members": -1, "masking_options": ["blur", "hash", "custom"],
     "password_protected_exports": True, "priority_support": True,
     "file_formats": ["all"]},
]
ALL_FORMATS = ["pdf", "docx", "doc", "txt", "csv", "png", "jpg", "jpeg", "svg", "json"]
# Other names of plans and billing periods.
PLAN_ALIASES = {"starter": "starter", "free": "starter", "basic": "starter", "professional": "professional",
                "pro": "professional", "enterprise": "enterprise", "unlimited": "enterprise"}
YEARLY_NAMES = ["yearly", "annual", "annually"]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTION_PRICES, "action string, price bigint")


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLANS, "plan_id string, plan_name string, price_inr bigint, price_inr_yearly bigint, "
               "monthly_tokens bigint, plan_features map<string,boolean>")


def plan_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLAN_LIMITS, "plan_type string, max_scans_per_month int, api_access boolean, batch_processing boolean, "
                     "custom_pii_patterns boolean, team_members int, masking_options array<string>, "
                     "password_protected_exports boolean, priority_support boolean, file_formats array<string>")


def _with_plan(users: DataFrame) -> DataFrame:
    """Users with their plan; the plan table is a constant of three rows."""
    return users.join(F.broadcast(plans(users.sparkSession)), "plan_id", "left")


def price_actions(events: DataFrame) -> DataFrame:
    """Metered events with their price; unknown actions are left out."""
    return events.join(F.broadcast(prices(events.sparkSession)), "action")


def unknown_actions(events: DataFrame) -> DataFrame:
    return events.join(F.broadcast(prices(events.sparkSession)), "action", "left_anti")


def running_balance(ledger: DataFrame, user="user_id", at="created_at", order=("entry_id",)) -> DataFrame:
    """Balance after each signed entry."""
    return running_totals(ledger, [user], at, list(order), {"balance_after": F.col("amount")})


def admit_debits(events: DataFrame, user="user_id", at="ts", order="event_id",
                 unlimited="unlimited", start="start_balance", ranges: int | None = None) -> DataFrame:
    """Which debits pass: only those the balance covers; a refused one changes nothing.

    ``amount`` > 0 is a debit, < 0 a credit, 0 a debit of nothing that passes.
    Unlimited users always pass and have no balance.  A user of any number of
    events is spread over ``ranges`` tasks (``admission``).
    """
    return admit(events, [user, unlimited, start], [at, order], start, F.coalesce(F.col(unlimited), F.lit(False)), ranges)


def usage_after(admitted: DataFrame, user="user_id") -> DataFrame:
    """Tokens used per user over the admitted debits."""
    used = F.when(F.col("admitted") & (F.col("amount") > 0), F.col("amount")).otherwise(0)
    return admitted.groupBy(user).agg(F.sum(used).alias("tokens_used"), F.count_if(~F.col("admitted")).alias("refused"))


def _due(period: str) -> Column:
    return F.col("monthly_tokens").isNotNull() & ~F.col("token_period").eqNullSafe(F.lit(period))


def monthly_reset(users: DataFrame, period: str) -> DataFrame:
    """Users with the month's allowance added where the period has changed."""
    rows = _with_plan(users)
    add = F.when(_due(period), F.col("monthly_tokens")).otherwise(0)
    return rows.withColumns({
        "tokens_balance": F.col("tokens_balance") + add, "tokens_total": F.col("tokens_total") + add,
        "token_period": F.when(_due(period), F.lit(period)).otherwise(F.col("token_period")),
    }).select(users.columns)


def reset_entries(users: DataFrame, period: str, at: Column) -> DataFrame:
    """Ledger credits of a monthly reset."""
    return _with_plan(users).filter(_due(period)).select(
        F.col("email").alias("user_id"), F.lit("credit").alias("type"), F.col("monthly_tokens").alias("amount"),
        F.lit("plan_reset").alias("reason"), F.create_map(F.lit("plan_id"), F.col("plan_id")).alias("metadata"),
        F.lit(None).cast("bigint").alias("balance_after"), at.alias("created_at"))


def normalize_plan(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PLAN_ALIASES.items() for x in kv])
    clean = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    named = F.coalesce(F.element_at(table, clean), clean)
    return F.when(named == "", "starter").otherwise(named)


def normalize_billing(c: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(c, F.lit("monthly"))))
    return F.when(clean.isin(YEARLY_NAMES), "annual").otherwise("monthly")


def assign_plan(users: DataFrame, requests: DataFrame, period: str) -> DataFrame:
    """Users after plan changes (email, plan, billing_period); unknown plans are ignored."""
    catalog = F.broadcast(plans(users.sparkSession))
    wanted = requests.select("email", normalize_plan(F.col("plan")).alias("plan_id"),
                             normalize_billing(F.col("billing_period")).alias("new_billing"))
    new = wanted.join(catalog, "plan_id").select(
        "email", F.col("plan_id").alias("new_plan"), "new_billing", "monthly_tokens", "plan_features")
    changed = F.col("new_plan").isNotNull()
    pick = lambda new_value, old: F.when(changed, new_value).otherwise(F.col(old)).alias(old)
    keep = [c for c in users.columns if c not in (
        "plan_id", "tokens_total", "tokens_used", "tokens_balance", "token_period", "features", "billing_period")]
    out = [pick(F.col("new_plan"), "plan_id"), pick(F.col("monthly_tokens"), "tokens_total"),
           pick(F.lit(0).cast("bigint"), "tokens_used"), pick(F.col("monthly_tokens"), "tokens_balance"),
           pick(F.lit(period), "token_period")]
    if "features" in users.columns:
        out.append(pick(F.col("plan_features"), "features"))
    if "billing_period" in users.columns:
        out.append(pick(F.col("new_billing"), "billing_period"))
    return users.join(new, "email", "left").select(*keep, *out)


def allocation_entries(assigned: DataFrame, at: Column) -> DataFrame:
    """Ledger credits for users just assigned a limited plan."""
    return assigned.filter(F.col("tokens_balance").isNotNull()).select(
        F.col("email").alias("user_id"), F.lit("credit").alias("type"), F.col("tokens_balance").alias("amount"),
        F.lit("plan_allocation").alias("reason"), F.create_map(F.lit("plan_id"), F.col("plan_id")).alias("metadata"),
        F.col("tokens_balance").alias("balance_after"), at.alias("created_at"))


def token_summary(users: DataFrame) -> DataFrame:
    """Balance (or ``unlimited``) and plan details of each user."""
    rows = _with_plan(users)
    known = F.col("plan_name").isNotNull()
    return rows.select(
        "email", "plan_id", F.coalesce("plan_name", F.initcap("plan_id")).alias("plan_name"), "monthly_tokens",
        F.coalesce("price_inr", F.lit(0)).alias("price_inr"), "tokens_total", "tokens_used",
        F.when(F.col("monthly_tokens").isNull() | ~known, "unlimited").otherwise(
            F.coalesce("tokens_balance", F.lit(0)).cast("string")).alias("tokens_balance"))


def active_plan(users: DataFrame, now: Column) -> DataFrame:
    """Users with the plan type in force and its limits."""
    active = (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    named = F.lower(F.coalesce("plan_type", F.lit("starter")))
    known = named.isin([p["plan_type"] for p in PLAN_LIMITS])
    in_force = F.when(F.coalesce(active, F.lit(False)) & known, named).otherwise("starter")
    return users.withColumn("plan_type", in_force)


def scan_limit(users: DataFrame, scans: DataFrame, now: Column) -> DataFrame:
    """May the user scan on, given this month's number of scans (email, scans)?"""
    rows = active_plan(users, now).join(F.broadcast(plan_limits(users.sparkSession)), "plan_type")
    used = F.coalesce("scans", F.lit(0))
    cap = F.col("max_scans_per_month")
    ok = (cap == -1) | (used < cap)
    text = F.concat(F.lit("Monthly scan limit ("), cap.cast("string"), F.lit(") reached. Please upgrade your plan."))
    return rows.join(scans, "email", "left").select(
        "email", "plan_type", used.alias("scans"), ok.alias("allowed"), F.when(~ok, text).alias("message"))


def feature_access(users: DataFrame, now: Column) -> DataFrame:
    """Feature flags and formats of the plan in force."""
    rows = active_plan(users, now).join(F.broadcast(plan_limits(users.sparkSession)), "plan_type")
    every = F.array(*[F.lit(x) for x in ALL_FORMATS])
    return rows.select(
        "email", "plan_type", "api_access", "batch_processing", "custom_pii_patterns",
        "password_protected_exports", F.array_contains("masking_options", "hash").alias("hash_masking"),
        F.when(F.array_contains("file_formats", "all"), every).otherwise(F.col("file_formats")).alias("formats"))


# Actions that only some plans may use, and those plans.
GATED_ACTIONS = ["lock_json", "unlock_json"]
GATED_PLANS = ["professional", "enterprise"]


def lock_gate(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (email, action, ...) with ``error`` and ``message``, null where the action may go on.

    Locking and unlocking need a known user on a plan that has them; no other action is held up here.
    """
    plan = F.lower(F.coalesce("plan_id", F.lit("starter")))
    known = users.select(F.lower(F.trim("email")).alias("__who"), plan.alias("__plan")).dropDuplicates(["__who"])
    asked = requests.withColumn("__who", F.lower(F.trim("email")))
    gated = F.col("action").isin(GATED_ACTIONS)
    rows = asked.join(known, "__who", "left")
    error = F.when(gated & F.col("__plan").isNull(), "USER_NOT_FOUND").when(gated & ~F.col("__plan").isin(GATED_PLANS), "PLAN_RESTRICTION")
    text = F.concat(F.initcap(F.replace("action", F.lit("_"), F.lit(" "))), F.lit(" is only available on Professional and Enterprise plans."))
    return rows.withColumn("error", error).withColumn("message", F.when(F.col("error") == "PLAN_RESTRICTION", text)).drop("__who", "__plan")


def merge_features(users: DataFrame) -> DataFrame:
    """Plan defaults under the user's own flags; ``updated`` tells what changed."""
    rows = _with_plan(users)
    own = F.coalesce("features", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>")))
    base = F.coalesce("plan_features", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>")))
    merged = F.map_zip_with(base, own, lambda k, p, u: F.coalesce(u, p))
    same = F.array_sort(F.map_entries(own)) == F.array_sort(F.map_entries(merged))
    return rows.select(*[c for c in users.columns if c != "features"], merged.alias("features"), (~same).alias("updated"))


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if("updated").alias("updated"), F.count_if(~F.col("updated")).alias("skipped"))


def subscription_expiry(at: Column, billing: Column) -> Column:
    """A year after activation when billed yearly, else 30 days."""
    days = F.when(billing == "yearly", 365).otherwise(30)
    return at + F.make_dt_interval(days=days)


def order_amount(orders: DataFrame) -> DataFrame:
    """Price of a plan order in rupees."""
    rows = orders.join(F.broadcast(plans(orders.sparkSession)), "plan_id")
    yearly = F.coalesce("price_inr_yearly", F.col("price_inr") * 12)
    return rows.withColumn("amount_inr", F.when(F.col("billing_period") == "yearly", yearly).otherwise(F.col("price_inr")))


def addon_amount(tokens: Column) -> Column:
    return tokens * ADDON_PRICE_INR


def payment_history(payments: DataFrame, user: str | None = None, limit: int = 50) -> DataFrame:
    """Newest payments of one user, or of every user."""
    mine = payments if user is None else payments.filter(F.col("user_email") == user)
    newest = Window.partitionBy("user_email").orderBy(F.desc("created_at"), F.asc("payment_id"))
    return mine.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)


def invoice_rows(payments: DataFrame, users: DataFrame) -> DataFrame:
    who = users.select(F.col("email").alias("user_email"), "full_name", "phone")
    return payments.join(who, "user_email")


def payments_by_month(payments: DataFrame, by=("user_email",)) -> DataFrame:
    """Payments grouped by calendar month, amounts in rupees."""
    month = F.date_trunc("month", "created_at")
    return payments.groupBy(*by, month.alias("month")).agg(
        F.count("*").alias("payments"), F.sum("amount_paise").alias("__p")).select(
        *by, F.date_format("month", "MMMM yyyy").alias("month"), "payments",
        rupees(F.col("__p")).alias("amount"))


def rupees(paise: Column) -> Column:
    """Paise as rupees with two decimals."""
    p = F.coalesce(paise, F.lit(0))
    return F.concat(F.lit("₹"), F.floor(p / 100).cast("string"), F.lit("."),
                    F.lpad((p % 100).cast("string"), 2, "0"))


def time_ago(at: Column, now: Column) -> Column:
    """How long ago, in words; older than 30 days as a date."""
    secs = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    mins, hours, days = (F.floor(secs / x) for x in (60_000_000, 3_600_000_000, 86_400_000_000))

    def words(n, unit):
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))

    return (
        F.when(at.isNull(), "Never").when(mins < 1, "Just now").when(mins < 60, words(mins, "minute"))
        .when(hours < 24, words(hours, "hour")).when(days < 7, words(days, "day"))
        .when(days < 30, words(F.floor(days / 7), "week")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def uncredited_payments(payments: DataFrame, ledger: DataFrame, id_key="payment_id") -> DataFrame:
    """Payments no ledger entry refers to."""
    seen = ledger.select(F.col("metadata")[id_key].alias("payment_id")).filter(F.col("payment_id").isNotNull())
    return payments.join(seen, "payment_id", "left_anti")
