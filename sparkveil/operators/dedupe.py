"""Cleaning up stored hits: one row per hit in, fewer or annotated rows out.

All operators take the document key and group by (document, type, value), never
by a value alone, and use partial aggregation so that hot groups are combined
before they are shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalogs import GENERIC, LABELS, TYPE_ALIASES
from ..functions.checks import digits, strip
from ..functions.folds import first_of_runs
from ..functions.many import FEW, lists_of

ROW = "hit_no"  # position of a hit in its document

# Image taxonomy.
IMAGE_CATEGORIES = {
    "government": ["AADHAAR", "PAN", "PASSPORT", "VOTER_ID", "DRIVING_LICENSE"],
    "financial": ["BANK_ACCOUNT_NUMBER", "IFSC", "CREDIT_CARD_NUMBER", "DEBIT_CARD_NUMBER", "GST"],
    "contact": ["PHONE", "EMAIL", "EMAIL_DOMAIN"],
}
# Board taxonomy.
BOARD_CATEGORIES = {
    "Government ID": ["AADHAAR", "PAN", "PASSPORT", "VOTER_ID", "DRIVING_LICENSE", "VEHICLE_REG_NO",
                      "BANK_ACCOUNT_NUMBER", "CREDIT_CARD_NUMBER", "DEBIT_CARD_NUMBER", "US_SSN", "ITIN"],
    "Secrets & Credentials": ["APIKEY", "AUTH_TOKEN", "JWT", "PASSWORD", "SECRET_KEY", "PRIVATE_KEY",
                              "CRYPTO_ADDRESS"],
}
# Scatter taxonomy, by substring of the type.
SCATTER_PARTS = [
    ("Government", "Critical", ["AADHAAR", "PAN", "VOTER", "PASSPORT", "DRIVING", "IFSC"]),
    ("Custom/Credentials", "High", ["API", "KEY", "PASSWORD", "TOKEN", "SECRET"]),
]


def _from_lists(type_: Column, lists: dict, other: str | None) -> Column:
    chain = None
    for name, types in lists.items():
        test = type_.isin(types)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(F.lit(other))


def any_part(c: Column, parts) -> Column:
    """True when the column contains one of the given substrings."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def category_of(type_: Column, taxonomy: str) -> Column:
    """Category of a type in one of the four taxonomies."""
    if taxonomy == "label":
        by = {}
        for name, cat, _ in LABELS:
            by.setdefault(cat, []).append(name)
        return _from_lists(type_, by, None)
    if taxonomy == "generic":
        by = {}
        for name, _, cat, *_ in GENERIC:
            by.setdefault(cat, []).append(name)
        return _from_lists(type_, by, None)
    if taxonomy == "image":
        return _from_lists(type_, IMAGE_CATEGORIES, "custom")
    if taxonomy == "board":
        return _from_lists(type_, BOARD_CATEGORIES, "General PII")
    (gov, _, gov_parts), (cust, _, cust_parts) = SCATTER_PARTS
    up = F.upper(type_)
    return F.when(any_part(up, gov_parts), gov).when(any_part(up, cust_parts), cust).otherwise("Other")


def severity_of(type_: Column) -> Column:
    (_, hi, gov_parts), (_, mid, cust_parts) = SCATTER_PARTS
    up = F.upper(type_)
    return F.when(any_part(up, gov_parts), hi).when(any_part(up, cust_parts), mid).otherwise("Medium")


def with_category(df: DataFrame, taxonomy: str = "label", type_col="type", out="category") -> DataFrame:
    return df.withColumn(out, category_of(F.col(type_col), taxonomy))


def normalize_type(c: Column) -> Column:
    """Canonical lower-case name of a type."""
    aliases = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(aliases, F.upper(c)), F.lower(c))


def squeeze(c: Column) -> Column:
    """Without spaces, dashes and underscores."""
    return F.translate(c, " -_", "")


def normalize_value(value: Column, type_: Column) -> Column:
    """Value in the form used to compare hits of one type."""
    v, t = squeeze(F.coalesce(value, F.lit(""))), F.upper(type_)
    d = digits(v)
    return (
        F.when(t == "AADHAAR", d)
        .when(t == "PHONE", F.when(F.startswith(d, F.lit("91")) & (F.length(d) > 10), F.right(d, F.lit(10))).otherwise(d))
        .when(t.isin("EMAIL", "UPI"), F.lower(v))
        .otherwise(v)
    )


def normalize_detections(raw: DataFrame) -> DataFrame:
    """Raw hit records with varying field names to the stored form.

    Rows without a type or any value are dropped; missing numbers get defaults.
    """
    have = set(raw.columns)
    col = lambda n, t: (F.col(n) if n in have else F.lit(None)).cast(t)
    blank = lambda c: F.when(c != "", c)
    value = F.coalesce(blank(col("value", "string")), blank(col("match", "string")))
    return (
        raw.withColumns({
            "value": value,
            "normalized": F.coalesce(col("normalized", "string"), value),
            "confidence": F.coalesce(col("confidence", "double"), F.lit(0.8)),
            "page": F.coalesce(col("page", "int"), F.lit(0)),
            "start": F.coalesce(col("start", "int"), F.lit(0)),
            "end": F.coalesce(col("end", "int"), F.lit(0)),
        })
        .filter((F.coalesce(F.col("type"), F.lit("")) != "") & F.col("value").isNotNull())
        .drop("match")
    )


def export_value(df: DataFrame) -> Column:
    """First non-empty of the four names a value may be stored under, trimmed."""
    names = [n for n in ("value", "match", "normalized", "text") if n in df.columns]
    return strip(F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names], F.lit("")))


def select_types(hits: DataFrame, types=None) -> DataFrame:
    """Keep the chosen types, ignoring case and blanks; no choice keeps all."""
    wanted = [t.strip().lower() for t in (types or [])]
    return hits.filter(F.lower(F.trim("type")).isin(wanted)) if wanted else hits


def min_confidence(hits: DataFrame, threshold: float = 0.7) -> DataFrame:
    return hits.filter(F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold)


def _first_of_group(hits: DataFrame, group: dict, order: list[str], counts: dict) -> DataFrame:
    """First row of each group in the given order, plus per-group aggregates.

    A place that is one whole number has a fixed width, so it is aggregated by hash, with partial sums on the map side;
    its row is then fetched by group and place, which spreads a hot group over all tasks.  Of rows that ``order`` does
    not tell apart one stays.
    """
    keyed, keys = hits.withColumns(group), list(group)
    if len(order) > 1 or not isinstance(hits.schema[order[0]].dataType, T.IntegralType):
        first = F.min_by(F.struct(*hits.columns), F.struct(*order)).alias("__first")
        return keyed.groupBy(*keys).agg(first, *[c.alias(n) for n, c in counts.items()]).select("__first.*", *counts)
    firsts = keyed.groupBy(*keys).agg(F.min(order[0]).alias("__at"), *[c.alias(n) for n, c in counts.items()])
    found = _fetched(keyed.drop(*counts), firsts, [*keys, order[0]], [*keys, "__at"])
    # a window of one row, which Spark applies before the shuffle too; a group has few rows here, those of its first place
    tied = Window.partitionBy(*keys).orderBy(order[0])
    one = found.withColumn("__n", F.row_number().over(tied)).filter("__n = 1")
    return one.select(*[c for c in hits.columns if c not in counts], *counts)


def _fetched(rows: DataFrame, found: DataFrame, by: list[str], theirs: list[str]) -> DataFrame:
    """``rows`` whose columns ``by`` equal ``theirs`` of ``found`` (nulls are equal), with the other columns of ``found``."""
    named = found.select(*[F.col(c).alias(f"__f{i}") for i, c in enumerate(theirs)], *[c for c in found.columns if c not in theirs])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__f{i}")) for i, c in enumerate(by)])
    return rows.join(named, same).drop(*[f"__f{i}" for i in range(len(by))])


def dedupe_exact(hits: DataFrame, doc=("doc_id",), order=(ROW,), with_instances=False) -> DataFrame:
    """One row per (document, canonical type, squeezed upper-case value).

    ``with_instances`` also gathers the group's rows and boxes, all of one
    document; ``instances_of`` gives the same as plain rows.
    """
    group = {f"__k{i}": F.col(c) for i, c in enumerate(doc)}
    group |= {"__t": normalize_type(F.col("type")), "__v": F.upper(squeeze(F.trim(F.col("value"))))}
    counts = {"occurrence_count": F.count("*")}
    if with_instances:
        row = F.struct(*order, F.struct(*hits.columns).alias("hit"))
        counts["all_instances"] = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["hit"])
        if "bbox" in hits.columns:
            boxed = F.when(F.col("bbox").isNotNull(), F.struct(*order, F.col("bbox").alias("bbox")))
            counts["all_bboxes"] = F.transform(F.array_sort(F.collect_list(boxed)), lambda r: r["bbox"])
    return _first_of_group(hits, group, list(order), counts)


def instances_of(hits: DataFrame, display: DataFrame, doc=("doc_id",)) -> DataFrame:
    """Every hit to be masked for the displayed hits."""
    key = lambda d: d.select(
        *doc, normalize_type(F.col("type")).alias("__t"), F.upper(squeeze(F.trim(F.col("value")))).alias("__v"))
    left = hits.withColumns({"__t": normalize_type(F.col("type")), "__v": F.upper(squeeze(F.trim(F.col("value"))))})
    return left.join(key(display).distinct(), [*doc, "__t", "__v"], "left_semi").drop("__t", "__v")


def dedupe_display(hits: DataFrame, doc=("doc_id",), order=(ROW,)) -> DataFrame:
    """First hit of each (upper-case type, normalized value) with its count."""
    group = {f"__k{i}": F.col(c) for i, c in enumerate(doc)}
    group |= {"__t": F.upper("type"), "__v": normalize_value(F.col("value"), F.col("type"))}
    return _first_of_group(hits, group, list(order), {
        "occurrence_count": F.count("*"), "is_deduplicated": F.count("*") > 1})


def _holders():
    """Column function (values, weakest first): for each the number of the strongest that it lies inside, or null."""
    # self-contained: workers need not have this package
    @F.pandas_udf("array<int>")
    def run(groups: pd.Series) -> pd.Series:
        import ahocorasick

        def one(values):
            if values is None:
                return None
            last = {v: i for i, v in enumerate(values)}
            machine, held = ahocorasick.Automaton(), {}
            for v in last:
                if v:
                    machine.add_word(v, v)
            if len(machine):
                machine.make_automaton()
            for v, i in last.items():
                if v:
                    for _, inner in machine.iter(v):
                        if len(inner) < len(v):
                            held[inner] = max(held.get(inner, -1), i)
            if "" in last and len(last) > 1:
                held[""] = max(i for v, i in last.items() if v)
            return [held.get(v) for v in values]

        return pd.Series([one(g) for g in groups], dtype=object)

    return run


def drop_substrings(hits: DataFrame, doc=("doc_id",), order=ROW) -> DataFrame:
    """Drop hits whose value lies inside a stronger hit of the same type.

    Stronger means more confident, then longer, then earlier.  The distinct values of a document and type, which that
    document bounds, meet in one row: a few are compared there, more go once through an automaton of all of them, in
    time of their total length.  What comes back are only the values that lie in others, with their strongest holder.
    """
    doc, order = list(doc), order if isinstance(order, str) else order[0]
    base = hits.withColumns({
        "__t": F.upper("type"), "__n": normalize_value(F.col("value"), F.col("type")),
        "__c": F.coalesce("confidence", F.lit(0.0)), "__l": F.length("value")})
    group = [*doc, "__t"]
    values = base.groupBy(*group, "__n", "__c", "__l").agg(F.min(order).alias("__o"))
    rank = F.struct(F.col("__c").alias("c"), F.col("__l").alias("l"), (-F.col("__o")).alias("o"))
    several = values.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("__n").alias("n")))).alias("__vs"),
        F.min(F.length("__n")).alias("__short"), F.max(F.length("__n")).alias("__long"))
    several = several.filter("__short < __long").drop("__short", "__long")
    many = F.size("__vs") > FEW

    def holder(v):
        longer = F.filter("__vs", lambda w: (F.length(w["n"]) > F.length(v["n"])) & F.contains(w["n"], v["n"]))
        return F.try_element_at(longer, F.lit(-1))["r"]

    at = _holders()(lists_of("string", F.transform("__vs", lambda v: v["n"]), many))
    several = several.withColumn("__at", at)
    held = F.when(many, F.transform("__vs", lambda v, i: F.struct(v["n"].alias("n"), F.get("__vs", F.get("__at", i))["r"].alias("r")))).otherwise(
        F.transform("__vs", lambda v: F.struct(v["n"].alias("n"), holder(v).alias("r"))))
    inside = F.array_sort(F.filter(held, lambda h: h["r"].isNotNull()))
    # a value that stands at several ranks has one holder, the same each time
    once = first_of_runs(inside, lambda a, b: a["n"] == b["n"])
    # through a generator that keeps empty rows, so that no test of size runs all this a second time
    inner = several.select(*group, F.explode_outer(once).alias("h")).filter("h IS NOT NULL")
    inner = inner.select(*group, F.col("h.n").alias("__n"), F.col("h.r").alias("__in"))
    own = F.struct(F.col("__c").alias("c"), F.col("__l").alias("l"), (-F.col(order)).alias("o"))
    return base.join(inner, [*group, "__n"], "left").filter(
        F.col("__in").isNull() | (F.col("__in") < own)).select(*hits.columns)


def smart_dedupe(hits: DataFrame, threshold=0.7, substrings=True, doc=("doc_id",), order=ROW):
    """(display rows, rows to mask): confidence, substrings, then first of each."""
    kept = min_confidence(hits, threshold)
    if substrings:
        kept = drop_substrings(kept, doc, order)
    return dedupe_display(kept, doc, (order,)), kept


def categorize(hits: DataFrame, doc=("doc_id",), order=(ROW,)) -> DataFrame:
    """Per document: category to label to [(value, confidence)], in text order."""
    doc = list(doc)
    rows = hits.groupBy(*doc, "category", "label").agg(
        F.array_sort(F.collect_list(F.struct(*order, "value", "confidence"))).alias("xs"))
    values = F.transform("xs", lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence")))
    labels = rows.groupBy(*doc, "category").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", values.alias("items"))))).alias("labels"))
    return labels.groupBy(*doc).agg(
        F.map_from_entries(F.collect_list(F.struct("category", "labels"))).alias("categorized"))


def summarize(hits: DataFrame, doc=("doc_id",), order=(ROW,)) -> DataFrame:
    """Per document and type: the values in text order."""
    return hits.groupBy(*doc, "type").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"]).alias("items"))
