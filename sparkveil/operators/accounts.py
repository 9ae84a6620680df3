"""Users: finding, checking, exporting and erasing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mask import redact_nested


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[^0-9]", "")


def normalize_phone(mobile: Column, country: Column) -> Column:
    """E.164 parts of a number, or null.

    Without a country code only ten-digit numbers are accepted, as Indian ones.
    """
    local = phone_digits(mobile)
    given = F.when(F.coalesce(country, F.lit("")) != "", phone_digits(country)).when(F.length(local) == 10, "91")
    full = F.concat(given, local)
    ok = (F.length(local) > 0) & (F.length(given) > 0) & F.length(full).between(6, 15)
    return F.when(ok, F.struct(
        F.concat(F.lit("+"), full).alias("e164"), full.alias("digits"),
        F.concat(F.lit("+"), given).alias("country_code"), given.alias("country_digits"), local.alias("local_digits")))


def resolve_user(ids: DataFrame, users: DataFrame, column="identifier") -> DataFrame:
    """User of each identifier: by mail, else by name, else by phone number."""
    wanted = ids.select(column).distinct()
    d = phone_digits(F.col(column))
    phones = wanted.filter(F.length(d) >= 10).select(column, F.explode(F.array(
        d, F.concat(F.lit("+91"), d), F.concat(F.lit("91"), d))).alias("phone"))
    found = (
        wanted.join(users.select(F.col("email").alias(column), "email"), column).withColumn("rank", F.lit(1))
        .unionByName(wanted.join(users.select(F.col("username").alias(column), "email"), column).withColumn("rank", F.lit(2)))
        .unionByName(phones.join(users.select("phone", "email"), "phone").select(column, "email").withColumn("rank", F.lit(3)))
    )
    return found.groupBy(column).agg(
        F.min_by("email", F.struct("rank", "email")).alias("email"), F.min("rank").alias("matched_by"))


def duplicate_names(batches: DataFrame) -> DataFrame:
    """Names a user has given to more than one batch, ignoring case and blanks."""
    return batches.groupBy("user_id", F.lower(F.trim("name")).alias("name")).agg(
        F.count("*").alias("batches")).filter(F.col("batches") > 1)


def profile_flags(users: DataFrame) -> DataFrame:
    """Add mail_verified, profile_complete and two_factor."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return users.withColumns({
        "mail_verified": filled("email") & F.coalesce("email_verified", F.lit(True)),
        "profile_complete": filled("full_name") & filled("email") & filled("country"),
        "two_factor": F.coalesce("enable_2fa", F.lit(False)) | F.coalesce("two_factor_enabled", F.lit(False)),
    })


def user_export(users: DataFrame, batches: DataFrame, ledger: DataFrame, limit: int = 50) -> DataFrame:
    """Per user: profile, ledger totals and newest batches, free of secrets.

    A batch is the user's when its user_id or owner is the user's mail, id or
    name.  The identifiers become rows, so this is two equality joins.
    """
    ident = users.select("email", F.explode(F.array_distinct(F.array_compact(F.array(
        "email", "username", "user_id")))).alias("who"))
    have_owner = "owner" in batches.columns
    mine = batches.join(ident.withColumnRenamed("who", "user_id"), "user_id")
    if have_owner:
        mine = mine.unionByName(batches.join(ident.withColumnRenamed("who", "owner"), "owner"))
    mine = mine.dropDuplicates(["email", "batch_id"])
    newest = Window.partitionBy("email").orderBy(F.desc("created_at"), F.asc("batch_id"))
    top = mine.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)
    fields = F.struct("place", *[c for c in batches.columns])
    # at most ``limit`` batches per user
    packed = top.groupBy("email").agg(F.array_sort(F.collect_list(fields)).alias("batches"))
    sums = ledger.groupBy(F.col("user_id").alias("email")).agg(
        F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).alias("credited"),
        F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0)).alias("debited"))
    profile = users.select("email", F.struct(*users.columns).alias("profile"))
    joined = profile.join(sums, "email", "left").join(packed, "email", "left")
    return redact_nested(joined)


def erase_user(tables: dict, users: DataFrame, requests: DataFrame, at: Column):
    """Remove users from every table; returns (tables, users, tombstones).

    ``tables`` maps a name to (frame, [columns that may name a user]);
    ``requests`` has email and reason.
    """
    gone = users.join(requests.select("email", "reason").dropDuplicates(["email"]), "email")
    names = gone.select(F.explode(F.array_compact(F.array("email", "username"))).alias("__who")).distinct()
    left = {}
    for name, (frame, columns) in tables.items():
        for c in columns:
            frame = frame.join(names.withColumnRenamed("__who", c), c, "left_anti").select(frame.columns)
        left[name] = frame
    stones = gone.select("email", "full_name", "username", "reason", at.alias("deleted_at"))
    return left, users.join(gone.select("email"), "email", "left_anti"), stones


def merge_tombstones(old: DataFrame, new: DataFrame) -> DataFrame:
    """One tombstone per mail, the latest."""
    both = old.unionByName(new)
    return both.groupBy("email").agg(F.max_by(F.struct(*both.columns), "deleted_at").alias("s")).select("s.*")
