"""Numbers about batches, files and hits.

Inputs are plain tables: ``hits(batch_id, filename, type, value, confidence,
page, ...)``, ``files(batch_id, filename, success, page_count, processing_time,
processed_at, ...)`` and ``batches(batch_id, user_id, ...)``.  Nothing here
gathers rows: groups are counted with partial aggregation, and arrays or maps
hold at most one entry per hit type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import strip
from .context import classify_document
from .dedupe import any_part, category_of, export_value, severity_of
from .ordered import stretch
from .running import running_totals

# Types counted as government identifiers in a profile.
GOVERNMENT_TYPES = ["aadhaar", "pan", "passport", "voter_id", "driving_license", "bank_account",
                    "ifsc", "upi", "epf", "gstin", "cin", "ration_card"]
# Name parts of high-risk types in the report.
HIGH_RISK_PARTS = ["AADHAAR", "PAN", "PASSPORT", "BANK_ACCOUNT", "CREDIT_CARD", "PASSWORD", "API_KEY"]
# Name parts of sensitive types in the header.
SENSITIVE_PARTS = ["AADHAAR", "PAN", "PASSPORT", "BANK_ACCOUNT", "IFSC", "UPI", "VOTER_ID", "DRIVING_LICENSE"]
# Risk weight of each type; others weigh 3.
RISK_WEIGHTS = {
    "AADHAAR": 10, "PAN": 10, "PASSPORT": 10, "VOTER_ID": 9, "DRIVING_LICENSE": 9,
    "BANK_ACCOUNT": 8, "CARD_NUMBER": 8, "IFSC": 7, "UPI": 7, "CVV": 9, "CARD_EXPIRY": 6,
    "PHONE": 6, "EMAIL": 5, "DOB": 6, "ADDRESS": 4,
    "EMPLOYEE_ID": 5, "CUSTOMER_ID": 5, "MEDICAL_RECORD_ID": 8, "INSURANCE_POLICY_NO": 7,
    "TAX_RECORD": 6, "TRANSACTION_ID": 4, "ORDER_ID": 3,
    "STUDENT_ROLL": 3, "MEMBERSHIP_ID": 3, "PROJECT_CODE": 2, "REFERRAL_CODE": 2,
    "VEHICLE_REG_NO": 4, "LICENSE_KEY": 5, "DEVICE_ID": 3, "SESSION_TOKEN": 4,
    "SALARY": 5, "GPS": 3,
    "IPV4": 2, "IPV6": 2, "MAC": 2, "IMEI": 4, "API_KEY": 7, "USERNAME": 3, "PASSWORD": 8,
}


def file_results(docs: DataFrame, hits: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Per document: success, error, hits, length and class."""
    counts = hits.groupBy(key).agg(F.count("*").alias("pii_count"))
    blank = F.length(strip(F.coalesce(F.col(text), F.lit("")))) == 0
    facts = docs.select(
        key, (~blank).alias("success"), F.when(blank, "No text extracted").alias("error"),
        F.length(text).alias("text_length"), classify_document(F.col(text)).alias("document_type"))
    return facts.join(counts, key, "left").fillna(0, ["pii_count"])


def type_counts(hits: DataFrame, by=("batch_id",)) -> DataFrame:
    return hits.groupBy(*by, "type").agg(F.count("*").alias("n"))


def breakdown(hits: DataFrame, by=("batch_id",)) -> DataFrame:
    """Per group: map of type to count (one entry per type), total and types."""
    return type_counts(hits, by).groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("breakdown"),
        F.sum("n").alias("piis"), F.count("*").alias("pii_types"))


def batch_stats(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Per batch, over its successful files: files, hits, breakdown, pages, time, latest."""
    good = files.filter(F.coalesce("success", F.lit(True)))
    per_file = good.groupBy("batch_id").agg(
        F.count("*").alias("files"),
        F.sum(F.coalesce("page_count", F.lit(0))).alias("pages_processed"),
        F.sum(F.coalesce("processing_time", F.lit(0.0))).alias("scan_duration"),
        F.max("processed_at").alias("processed_at"))
    of_good = hits.join(good.select("batch_id", "filename"), ["batch_id", "filename"], "left_semi")
    return per_file.join(breakdown(of_good), "batch_id", "left").fillna(0, ["piis", "pii_types"])


def list_batches(batches: DataFrame, files: DataFrame, user_id: str | None = None, limit=100) -> DataFrame:
    """Newest batches of a user (or of each user) with their number of files."""
    mine = batches if user_id is None else batches.filter(F.col("user_id") == user_id)
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("batch_id"))
    top = mine.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)
    counts = files.groupBy("batch_id").agg(F.count("*").alias("file_count"))
    return top.join(counts, "batch_id", "left").fillna(0, ["file_count"])


def user_stats(batches: DataFrame, stats: DataFrame) -> DataFrame:
    """Per user: batches, files, hits."""
    return batches.join(stats.select("batch_id", "files", "piis"), "batch_id", "left").groupBy("user_id").agg(
        F.count("*").alias("total_batches"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("piis"), F.lit(0)).alias("total_piis"))


def user_profile_stats(batches: DataFrame, hits: DataFrame) -> DataFrame:
    """Per user: government and custom hits with shares, counts by type descending."""
    # counted per batch first: the join moves one row per (batch, type), not per hit
    per_type = type_counts(hits).join(batches.select("batch_id", "user_id"), "batch_id").groupBy(
        "user_id", "type").agg(F.sum("n").alias("n"))
    gov = F.lower("type").isin(GOVERNMENT_TYPES)
    total = F.sum("n")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "type", "n")))
    return per_type.groupBy("user_id").agg(
        total.alias("total_piis"),
        F.sum(F.when(gov, F.col("n")).otherwise(0)).alias("gov_piis"),
        F.sum(F.when(gov, 0).otherwise(F.col("n"))).alias("custom_piis"),
        F.round(F.sum(F.when(gov, F.col("n")).otherwise(0)) / total * 100, 2).alias("gov_percentage"),
        F.round(F.sum(F.when(gov, 0).otherwise(F.col("n"))) / total * 100, 2).alias("custom_percentage"),
        F.transform(ranked, lambda r: F.struct(r["type"].alias("type"), r["n"].alias("count"))).alias("pii_type_list"))


def stats_by_format(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Files and hits per format, over successful files."""
    good = files.filter("success")
    per_file = hits.groupBy("batch_id", "filename").agg(F.count("*").alias("n"))
    return good.join(per_file, ["batch_id", "filename"], "left").groupBy("format").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_pii"))


def pii_statistics(files: DataFrame, hits: DataFrame) -> DataFrame:
    """One pass for the total and the counts by format, by category and by type."""
    good = files.filter("success").select("batch_id", "filename", "format")
    pre = hits.groupBy("batch_id", "filename", "category", "type").agg(F.count("*").alias("n"))
    rows = pre.join(good, ["batch_id", "filename"])
    return rows.groupingSets(
        [[F.col("format")], [F.col("category")], [F.col("type")], []],
        "format", "category", "type",
    ).agg(F.sum("n").alias("total_pii"), F.grouping_id().alias("gid")).select(
        F.when(F.col("gid") == 3, "format").when(F.col("gid") == 5, "category")
        .when(F.col("gid") == 6, "type").otherwise("total").alias("dimension"),
        F.coalesce("format", "category", "type", F.lit("all")).alias("name"), "total_pii")


def image_summary(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Per batch: hits, images with hits, total time, map of category to hits."""
    cat = hits.withColumn("category", category_of(F.col("type"), "image"))
    per_file = hits.groupBy("batch_id", "filename").agg(F.count("*").alias("n"))
    per_cat = cat.groupBy("batch_id", "category").agg(F.count("*").alias("n")).groupBy("batch_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("pii_by_category"))
    totals = files.join(per_file, ["batch_id", "filename"], "left").groupBy("batch_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_piis"),
        F.count("n").alias("images_with_pii"), F.sum("processing_time").alias("total_time"))
    return totals.join(per_cat, "batch_id", "left")


def type_distribution(hits: DataFrame, by=("batch_id",)) -> DataFrame:
    """Count and share of each type (one decimal); ``place`` is the rank."""
    counts = type_counts(hits, by)
    group = Window.partitionBy(*by)
    return counts.withColumns({
        "percentage": F.round(F.col("n") / F.sum("n").over(group) * 100, 1),
        "place": F.row_number().over(group.orderBy(F.desc("n"), F.asc("type"))),
    })


def top_types(hits: DataFrame, n=10, by=("batch_id",), width=20) -> DataFrame:
    """The n most frequent types of each group, labels cut to a width."""
    label = F.when(F.length("type") > width, F.concat(F.substring("type", 1, width), F.lit("..."))).otherwise(F.col("type"))
    return type_distribution(hits, by).filter(F.col("place") <= n).withColumn("label", label)


def remaining_types(hits: DataFrame, n=12, by=("batch_id",)) -> DataFrame:
    """All types after the first n."""
    return type_distribution(hits, by).filter(F.col("place") > n)


def risk_report(hits: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Per batch: high-risk hits, sensitive types, score of at most 100, level."""
    high = any_part(F.upper("type"), HIGH_RISK_PARTS)
    out = type_counts(hits).groupBy("batch_id").agg(
        F.sum("n").alias("total_piis"),
        F.sum(F.when(high, F.col("n")).otherwise(0)).alias("high_risk_count"),
        F.count_if(high).alias("sensitive_types"))
    if batches is not None:
        out = batches.select("batch_id").join(out, "batch_id", "left").fillna(0)
    share = F.floor(F.col("high_risk_count") / F.greatest("total_piis", F.lit(1)) * 100)
    out = out.withColumn("risk_score", F.least(F.lit(100), share.cast("int") + 20))
    return out.withColumn("risk_level", F.when(F.col("risk_score") < 40, "LOW")
                          .when(F.col("risk_score") < 70, "MEDIUM").otherwise("HIGH"))


def risk_weight(type_: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RISK_WEIGHTS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.upper(type_)), F.lit(3))


def weighted_risk(hits: DataFrame, by=("batch_id",), batches: DataFrame | None = None) -> DataFrame:
    """Per group: weighted total, percent of the maximum, hits per band, level."""
    rows = type_counts(hits, by).withColumn("w", risk_weight(F.col("type")))
    band = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    w = F.col("w")
    out = rows.groupBy(*by).agg(
        F.sum(w * F.col("n")).alias("total_risk_score"), F.sum("n").alias("total_piis"),
        band(w >= 8).alias("critical_count"), band((w >= 6) & (w < 8)).alias("high_count"),
        band((w >= 4) & (w < 6)).alias("medium_count"), band(w < 4).alias("low_count"),
        F.count("*").alias("pii_types"))
    if batches is not None:
        out = batches.select(*by).join(out, list(by), "left").fillna(0)
    exact = F.when(F.col("total_piis") > 0, F.col("total_risk_score") / (F.col("total_piis") * 10) * 100).otherwise(0.0)
    return out.withColumn("__p", exact).withColumns({
        "risk_percentage": F.round("__p", 1),
        "risk_level": F.when(F.col("__p") >= 70, "CRITICAL").when(F.col("__p") >= 50, "HIGH")
        .when(F.col("__p") >= 30, "MEDIUM").otherwise("LOW"),
        "recommendations": recommendations(F.col("critical_count"), F.col("high_count"), F.col("__p"), F.col("pii_types")),
    }).drop("__p")


def risk_by_type(hits: DataFrame, n=10, by=("batch_id",)) -> DataFrame:
    """The n types of each group with the most weighted risk."""
    rows = type_counts(hits, by).withColumn("weight", risk_weight(F.col("type")))
    rows = rows.withColumn("risk", F.col("weight") * F.col("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("risk"), F.asc("type"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def recommendations(critical: Column, high: Column, percent: Column, types: Column) -> Column:
    """The advice lines that apply."""
    lines = F.array(
        F.when(critical > 0, F.concat(F.lit("Immediate action required: "), critical.cast("string"),
                                      F.lit(" critical PIIs detected"))),
        F.when(high > 10, F.lit("High volume of sensitive data: Consider encryption at rest")),
        F.when(percent >= 50, F.lit("High risk score: Review data retention policies")),
        F.when(types > 15, F.lit("Multiple PII types: Implement comprehensive data governance")))
    return F.filter(lines, lambda x: x.isNotNull())


def header_metrics(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Per batch: the figures of the analysis header."""
    per_file = files.groupBy("batch_id").agg(
        F.count("*").alias("file_count"), F.sum(F.coalesce("page_count", F.lit(0))).alias("total_pages"),
        F.sum(F.coalesce("processing_time", F.lit(0.0))).alias("__secs"), F.max("processed_at").alias("processed_at"))
    sens = any_part(F.upper("type"), SENSITIVE_PARTS)
    per_type = type_counts(hits).groupBy("batch_id").agg(
        F.sum("n").alias("total_piis"), F.count("*").alias("pii_types_count"),
        F.min_by("type", F.struct((-F.col("n")).alias("neg"), F.col("type"))).alias("most_frequent_type"),
        F.sum(F.when(sens, F.col("n")).otherwise(0)).alias("sensitive_count"))
    m = per_file.join(per_type, "batch_id", "left").fillna(0, ["total_piis", "pii_types_count", "sensitive_count"])
    s = F.col("__secs")
    high = (F.col("sensitive_count") > 50) | (F.col("total_piis") > 200)
    mid = (F.col("sensitive_count") > 20) | (F.col("total_piis") > 100)
    half_up = lambda x: F.floor(x + 0.5).cast("bigint").cast("string")
    return m.withColumns({
        "scan_duration": F.when(s >= 60, F.concat(
            F.floor(s / 60).cast("string"), F.lit("m "), half_up(s - F.floor(s / 60) * 60), F.lit("s")))
        .otherwise(F.concat(half_up(s), F.lit("s"))),
        "avg_pii_per_file": F.round(F.col("total_piis") / F.col("file_count"), 1),
        "most_frequent_type": F.coalesce("most_frequent_type", F.lit("N/A")),
        "risk_level": F.when(high, "High").when(mid, "Medium").otherwise("Low"),
        "compliance_score": F.when(high, 25).when(mid, 60).otherwise(90),
    }).drop("__secs")


def detail_rows(hits: DataFrame, one_type: str | None = None, types=None, order=("filename", "hit_no")) -> DataFrame:
    """Hits for the detail table: defaults filled in, long values cut, filtered."""
    rows = hits.filter(F.col("type").isNotNull() & F.col("value").isNotNull())
    if one_type:
        rows = rows.filter(F.col("type") == one_type)
    if types:
        rows = rows.filter(F.col("type").isin(list(types)))
    short = F.when(F.length("value") > 20, F.concat(F.substring("value", 1, 17), F.lit("..."))).otherwise(F.col("value"))
    return rows.select(
        *[c for c in ("batch_id", *order) if c in rows.columns], "type", "value", short.alias("shown"),
        F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("confidence", F.lit(0.9)).alias("confidence"))


def distinct_types(hits: DataFrame) -> DataFrame:
    return hits.select("type").distinct().orderBy("type")


def export_rows(hits: DataFrame, types=None, order=("file_ord", "hit_no")) -> DataFrame:
    """Distinct (batch, type, value) with the file that introduced it, first seen first."""
    rows = hits.withColumns({"__t": F.upper("type"), "__v": export_value(hits)}).filter(F.col("__v") != "")
    if types:
        rows = rows.filter(F.col("__t").isin([t.upper() for t in types]))
    slim = rows.select("batch_id", F.col("__t").alias("type"), F.col("__v").alias("value"), *order, "filename")
    # of each value a task hands on one row, so that a value in very many files stays small
    seen = Window.partitionBy("batch_id", "type", "value").orderBy(*order)
    return slim.withColumn("__n", F.row_number().over(seen)).filter("__n = 1").drop("__n")


def export_metadata(exported: DataFrame) -> DataFrame:
    """Per batch: total, sorted types."""
    return exported.groupBy("batch_id", "type").agg(F.count("*").alias("n")).groupBy("batch_id").agg(
        F.sum("n").alias("total_piis"), F.array_sort(F.collect_list("type")).alias("pii_types"))


def export_files(exported: DataFrame) -> DataFrame:
    """Per batch and file: the values credited to it."""
    return exported.groupBy("batch_id", "filename").agg(F.count("*").alias("pii_count"))


def export_payload(exported: DataFrame, order=("file_ord", "hit_no"), part_values: int | None = None) -> DataFrame:
    """JSON payloads (batch_id, part, payload): {"type": ..., "values": [...]}.

    A type is one payload, its values in first-seen order, at every size, unless
    the caller asks for payloads of about ``part_values`` values, dealt by hash.
    """
    rows = exported.withColumn("__p", F.lit(0))
    if part_values:
        parts = exported.groupBy("batch_id", "type").agg(
            F.ceil(F.count("*") / part_values).cast("int").alias("__parts"))
        part = F.pmod(F.xxhash64("value"), F.col("__parts")).cast("int")
        rows = exported.join(parts, ["batch_id", "type"]).withColumn("__p", part)
    values = F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"])
    return rows.groupBy("batch_id", "type", "__p").agg(values.alias("values")).select(
        "batch_id", F.concat("type", F.lit("-"), F.col("__p").cast("string")).alias("part"),
        F.to_json(F.struct("type", "values")).alias("payload"))


def export_values(exported: DataFrame, order=("file_ord", "hit_no")) -> DataFrame:
    """One JSON row (batch_id, part, payload) for each value, the same at every size.

    ``part`` names the type and the place at which the value was first seen, which is also the order of the values.
    """
    place = [F.lpad(F.col(c).cast("string"), 20, "0") for c in order]
    return exported.select("batch_id", F.concat_ws("-", "type", *place).alias("part"),
                           F.to_json(F.struct("type", "value", "filename")).alias("payload"))


def export_document(exported: DataFrame, batches: DataFrame) -> DataFrame:
    """What stands above the values of an export: batch, name, total, sorted types, files with counts, encryption."""
    files = export_files(exported).groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("filename", "pii_count"))).alias("files"))
    names = batches.select("batch_id", F.trim("name").alias("name"))
    return export_metadata(exported).join(files, "batch_id").join(names, "batch_id", "left").withColumn(
        "encryption", F.lit("AES-GCM-256"))


def page_of(df: DataFrame, order: list, page: int, per_page: int) -> DataFrame:
    """One page of a sorted result: rows are dealt by ranges, and only the ranges that hold the page are sorted.

    To turn many pages, deal once (``ordered.into_ranges`` by the same order) and hand that table in: then a page reads
    its own ranges and nothing else moves.
    """
    return stretch(df, order, (page - 1) * per_page, per_page)


def page_count(df: DataFrame, per_page: int, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.ceil(F.count("*") / per_page).cast("bigint").alias("total_pages"))


def throughput(files: DataFrame, job="batch_id", at="processed_at", order="file_ord") -> DataFrame:
    """Per completed file: done so far, mean time, estimated time left."""
    rows = running_totals(files, [job], at, [order], {
        "completed": F.lit(1).cast("bigint"), "spent": F.col("processing_time")})
    rows = rows.join(files.groupBy(job).agg(F.count("*").alias("total")), job)
    mean = F.col("spent") / F.col("completed")
    return rows.select(
        job, order, "completed", "total", F.round(mean, 4).alias("avg_time"),
        F.floor(F.round((F.col("total") - F.col("completed")) * mean, 6)).alias("eta"))


def detector_totals(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Scans, time and hits of the detector as a whole."""
    found = hits.agg(F.count("*").alias("pii_found")).withColumn("one", F.lit(1))
    scans = files.agg(
        F.count("*").alias("scans"), F.round(F.sum("processing_time"), 2).alias("total_time"),
        F.round(F.avg("processing_time"), 4).alias("avg_time")).withColumn("one", F.lit(1))
    # both sides are a single row
    return scans.join(F.broadcast(found), "one").drop("one")


def account_strength(users: DataFrame) -> Column:
    return F.round(100 * (
        F.col("mail_verified").cast("int") + F.col("profile_complete").cast("int") + F.col("two_factor").cast("int")) / 3).cast("int")


def user_activity(users: DataFrame, batches: DataFrame) -> DataFrame:
    """Last login, last batch, last completed scan and account strength of each user."""
    scan_at = F.when(F.col("processed_at").isNotNull() | (F.col("status") == "completed"),
                     F.coalesce("processed_at", "updated_at", "created_at"))
    per_user = batches.groupBy("user_id").agg(
        F.max(F.coalesce("created_at", "updated_at")).alias("last_batch_created"),
        F.max_by(scan_at, F.when(scan_at.isNotNull(), F.struct("created_at", "batch_id"))).alias("last_pii_scan"))
    u = users.select("email", F.coalesce("last_login", "updated_at", "created_at").alias("last_login"),
                     account_strength(users).alias("account_strength"))
    return u.join(per_user.withColumnRenamed("user_id", "email"), "email", "left")


def daily_timeline(hits: DataFrame, at="processed_at") -> DataFrame:
    return hits.groupBy(F.window(at, "1 day").alias("w"), "type").agg(F.count("*").alias("events")).select(
        F.to_date("w.start").alias("day"), "type", "events")


def batch_comparison(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits, files and risk percentage of each batch side by side."""
    counts = files.groupBy("batch_id").agg(F.count("*").alias("file_count"))
    risk = weighted_risk(hits).select("batch_id", F.col("total_piis").alias("pii_count"),
                                      F.col("risk_percentage").alias("risk_score"))
    return counts.join(risk, "batch_id", "left").fillna(0)


def riskiest_files(hits: DataFrame, n=5) -> DataFrame:
    """The n files of each batch with the most weighted risk."""
    per_file = hits.groupBy("batch_id", "filename").agg(
        F.count("*").alias("pii_count"), F.sum(risk_weight(F.col("type"))).alias("risk_score"))
    order = Window.partitionBy("batch_id").orderBy(F.desc("risk_score"), F.asc("filename"))
    return per_file.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def masked_share(hits: DataFrame, masked: DataFrame, by="batch_id") -> DataFrame:
    """Masked and unmasked hits: ``masked`` lists the (batch, file) pairs already masked."""
    per_file = hits.groupBy(by, "filename").agg(F.count("*").alias("n"))
    flags = per_file.join(masked.select(by, "filename").distinct().withColumn("m", F.lit(True)), [by, "filename"], "left")
    total = F.sum("n")
    hidden = F.sum(F.when(F.col("m"), F.col("n")).otherwise(0))
    return flags.groupBy(by).agg(
        hidden.alias("masked"), (total - hidden).alias("unmasked"),
        F.round(hidden / total * 100, 1).alias("masked_percentage"))


def severity_counts(hits: DataFrame) -> DataFrame:
    """Hits by scatter category and severity."""
    return type_counts(hits, ()).groupBy(
        category_of(F.col("type"), "scatter").alias("category"), severity_of(F.col("type")).alias("severity")
    ).agg(F.sum("n").alias("hits"))
