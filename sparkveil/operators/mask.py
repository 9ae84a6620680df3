"""Masking text, and cleaning records for display or export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import strip
from ..functions.folds import first_of_runs, ordered_fold
from ..functions.many import FEW, blank_many, lists_of, mask_many
from .detect import ADDERS

BLOCK = "█"
NUMERIC = ["AADHAAR", "PHONE", "BANK_ACCOUNT", "CARD_NUMBER", "IMEI"]
CASELESS = ["EMAIL", "UPI", "USERNAME"]
SHORTEST = 3
# Keys never shown in an export.
SECRET_KEYS = ["password_hash", "password", "otp", "reset_token", "resetToken", "session_tokens", "sessions"]


def variations(value: Column, normalized: Column, type_: Column) -> Column:
    """The spellings under which a value may stand in the text, long enough to mask."""
    v, n, t = strip(F.coalesce(value, F.lit(""))), strip(F.coalesce(normalized, F.lit(""))), F.upper(type_)
    bare = F.regexp_replace(v, r"(?U)[\s\-]", "")
    spaced = F.concat_ws(" ", F.substring(bare, 1, 4), F.substring(bare, 5, 4), F.substring(bare, 9, 4))
    dashed = F.array_join(F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(bare) / 4).cast("int") - 1, F.lit(0))),
        lambda i: F.substring(bare, i * 4 + 1, F.lit(4))), "-")
    forms = F.array(
        v, n,
        F.when(t.isin(NUMERIC), bare),
        F.when((t == "AADHAAR") & (F.length(bare) == 12), spaced),
        F.when(t.isin(NUMERIC) & (F.length(bare) >= 10), dashed),
        F.when(t.isin("EMAIL", "UPI"), F.lower(v)),
        F.when(t.isin("EMAIL", "UPI"), F.upper(v)),
    )
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (F.length(x) >= SHORTEST)))


def replacements(hits: Column) -> Column:
    """Sorted array<struct<neg,value,caseless>> of what to replace, longest first.

    A caseless value stands once, in lower case, since it is looked for in any case.
    """
    def item(v, caseless):
        low = F.lower(v)
        return F.struct((-F.length(v)).alias("neg"), F.when(caseless & (F.length(low) == F.length(v)), low).otherwise(v).alias("value"),
                        caseless.alias("caseless"))

    each = F.flatten(F.transform(hits, lambda h: F.transform(
        variations(h["value"], h["normalized"], h["type"]), lambda v: item(v, F.upper(h["type"]).isin(CASELESS)))))
    return first_of_runs(F.array_sort(each), lambda a, b: a == b)


def quoted(v: Column) -> Column:
    """A pattern for the value itself."""
    return F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def replace_one(t: Column, r: Column, new: Column) -> Column:
    """Replace one item's value where it occurs, in any case for caseless items."""
    return F.when(r["caseless"], F.regexp_replace(t, F.concat(F.lit("(?iu)"), quoted(r["value"])), new)).otherwise(
        F.replace(t, r["value"], new))


def strings_of(items: Column, caseless: bool) -> Column:
    return F.transform(F.filter(items, lambda r: r["caseless"] == F.lit(caseless)), lambda r: r["value"])


def blanked(text: Column, items: Column) -> Column:
    """The text with every item's value replaced by blocks of the same length, longest first.

    A few items are replaced one after the other. More would cost a copy of the text each, so they are found in one pass
    and blanked in the same order; both give the same text. ``items`` should be a column, since it is used several times.
    """
    block = lambda r: F.repeat(F.lit(BLOCK), F.length(r["value"]))
    few = F.aggregate(items, text, lambda t, r: replace_one(t, r, block(r)))
    many = F.size(items) > FEW
    whole = mask_many(BLOCK)(F.when(many, text), *[lists_of("string", strings_of(items, c), many) for c in (False, True)])
    return F.when(many, whole).when(F.size(items) > 0, few).otherwise(text)


def spelled_hits(hits: DataFrame, key: list[str]) -> DataFrame:
    """The different hits of each document (or page), in one array: bounded by that document."""
    return hits.groupBy(*key).agg(F.collect_set(F.struct("type", "value", "normalized")).alias("__hits"))


def _with_masked(rows: DataFrame, text: str, hits: str) -> DataFrame:
    items = rows.withColumn("__items", F.coalesce(replacements(F.col(hits)), F.array().cast("array<struct<neg:int,value:string,caseless:boolean>>")))
    return items.withColumn(text, blanked(F.col(text), F.col("__items"))).drop("__items", hits)


def mask_text(docs: DataFrame, hits: DataFrame, key=("doc_id",), text="text") -> DataFrame:
    """Documents with stored hits blanked out; those without hits pass unchanged."""
    joined = docs.join(spelled_hits(hits, list(key)), list(key), "left")
    return _with_masked(joined, text, "__hits").select(docs.columns)


#: Elements of one document that are masked as one text, and what stands between them there (a noncharacter).
TOGETHER = 4096
BETWEEN = "\ufdd2"


def mask_elements(elements: DataFrame, hits: DataFrame, place="element_no") -> DataFrame:
    """Every paragraph, cell, header and footer of a document, longest value first.

    Neighbouring elements are masked as one text, so a document's hits are joined and searched once for ``TOGETHER``
    elements and not for each; a document of any number of elements makes that many groups.
    """
    rest = [c for c in elements.columns if c not in ("doc_id", "text")]
    # an element that holds the mark between elements, or no text, stands alone
    alone = F.coalesce(F.contains("text", F.lit(BETWEEN)), F.lit(True))
    group = F.when(~alone, F.floor(F.col(place) / TOGETHER))
    own = F.when(alone, F.xxhash64(*elements.columns))
    packed = F.collect_list(F.struct(*rest, "text"))
    groups = elements.groupBy("doc_id", group.alias("__group"), own.alias("__own"), alone.alias("__alone")).agg(packed.alias("__rows"))
    texts = F.transform("__rows", lambda r: r["text"])
    whole = groups.withColumn("text", F.when(~F.col("__alone"), F.array_join(texts, BETWEEN)).otherwise(F.get(texts, F.lit(0))))
    masked = mask_text(whole, hits)
    parts = F.when(F.col("__alone"), F.transform("__rows", lambda r: F.col("text"))).otherwise(F.split("text", BETWEEN, -1))
    each = masked.withColumn("__parts", parts).select("doc_id", F.explode(F.arrays_zip("__rows", "__parts")).alias("__z"))
    made = each.select("doc_id", *[F.col(f"__z.__rows.{c}").alias(c) for c in rest], F.col("__z.__parts").alias("text"))
    return made.select(elements.columns)


def mask_pages(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """A page is masked with its own hits only."""
    return mask_text(pages, hits, ("doc_id", "page"), "text")


def detect_and_mask(docs: DataFrame, kind="base", text="text", **options) -> DataFrame:
    """Detect and mask in one narrow pass: no join, no shuffle, text read once."""
    found = ADDERS[kind](docs, text=text, out="__found", **options)
    return _with_masked(found, text, "__found").select(docs.columns)


def mask_spans(docs: DataFrame, hits="hits", text="text") -> DataFrame:
    """Exact variant: the spans of a document's hits (column ``hits``) blanked by offset, overlaps merged."""
    spans = F.array_sort(F.transform(F.col(hits), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))
    rows = docs.withColumn("__spans", F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")))
    t = F.col(text)

    def step(pos, h):
        start, end = F.greatest(pos, h["start"]), F.greatest(pos, h["end"])
        return end, F.concat(F.substring(t, pos + 1, start - pos), F.repeat(F.lit(BLOCK), end - start))

    few = F.concat(F.array_join(ordered_fold(F.col("__spans"), F.lit(0), step, "string"), ""),
                   F.substring(t, F.array_max(F.transform("__spans", lambda s: s["end"])) + 1, F.length(t)))
    many = F.size("__spans") > FEW
    ends = lambda n: lists_of("int", F.transform("__spans", lambda s: s[n]), many)
    whole = blank_many(BLOCK)(F.when(many, t), ends("start"), ends("end"))
    return rows.withColumn(text, F.when(many, whole).when(F.size("__spans") > 0, few).otherwise(t)).drop("__spans")


def partial_mask(type_: Column, value: Column, masked: Column) -> Column:
    """TYPE: masked value, or X's with the last four characters kept."""
    given = (F.coalesce(masked, F.lit("")) != "") & (masked != value)
    own = F.when(F.length(value) > 4, F.concat(F.repeat(F.lit("X"), F.length(value) - 4), F.right(value, F.lit(4)))
                 ).otherwise(F.repeat(F.lit("X"), F.length(value)))
    return F.concat(type_, F.lit(": "), F.when(given, masked).otherwise(own))


def pseudonymize(value: Column, key: Column) -> Column:
    """Same value, same token: joins on the masked column still work."""
    return F.sha2(F.concat(key, value), 256)


def sanitize_text(c: Column) -> Column:
    """Without NUL, angle brackets, quotes, ampersands and line breaks; trimmed."""
    return strip(F.translate(c, "\0<>\"'&\n\r", ""))


def sanitize_nested(c: Column, t: T.DataType) -> Column:
    """``sanitize_text`` on every string inside structs, arrays and map values."""
    if isinstance(t, T.StringType):
        return sanitize_text(c)
    if isinstance(t, T.StructType):
        return F.struct(*[sanitize_nested(c[f.name], f.dataType).alias(f.name) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: sanitize_nested(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda k, v: sanitize_nested(v, t.valueType))
    return c


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.select(*[sanitize_nested(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _redacted(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if isinstance(t, T.StructType):
        keep = [f for f in t.fields if f.name not in SECRET_KEYS]
        return F.when(c.isNotNull(), F.struct(*[_redacted(c[f.name], f.dataType).alias(f.name) for f in keep]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _redacted(x, t.elementType))
    if isinstance(t, T.MapType):
        kept = F.map_filter(c, lambda k, v: ~k.isin(SECRET_KEYS)) if isinstance(t.keyType, T.StringType) else c
        return F.transform_values(kept, lambda k, v: _redacted(v, t.valueType))
    return c


def redact_nested(df: DataFrame) -> DataFrame:
    """Drop secret keys at any depth; timestamps become ISO text with Z."""
    fields = [f for f in df.schema.fields if f.name not in SECRET_KEYS]
    return df.select(*[_redacted(F.col(f.name), f.dataType).alias(f.name) for f in fields])


def mask_report(jobs: DataFrame) -> DataFrame:
    """Per batch: masked and skipped files by reason.

    ``jobs`` has batch_id, filename, success and pii_count.
    """
    name = F.col("filename")
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    state = (
        F.when(~F.col("success"), "failed")
        .when(F.coalesce(F.col("pii_count"), F.lit(0)) == 0, "no_hits")
        .when(ext.isin("png", "jpg", "jpeg", "gif", "bmp", "tiff", "svg"), "unsupported")
        .otherwise("masked")
    )
    return jobs.withColumn("state", state).groupBy("batch_id").agg(
        F.count_if(F.col("state") == "masked").alias("masked_files"),
        F.count_if(F.col("state") == "failed").alias("skipped_failed"),
        F.count_if(F.col("state") == "no_hits").alias("skipped_no_hits"),
        F.count_if(F.col("state") == "unsupported").alias("skipped_unsupported"),
    )


def masked_name(filename: Column, mask_type: str = "blur") -> Column:
    """Descriptive output name of a masked file."""
    return F.concat(F.lit(f"masked_{mask_type}_"), filename)
