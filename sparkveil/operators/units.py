"""Detection at a finer grain than the document: lines, pages, elements, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import strip
from .detect import add_base_hits, add_generic_hits, detect

PREVIEW = 100
PAGE_MARK = r"(?:\[Page (\d+)\]\n|\n--- Page (\d+) ---\n)"


def split_pages(df: DataFrame, key=("doc_id",), text="text") -> DataFrame:
    """(page, text) rows from a text carrying either kind of page marker."""
    marks = F.regexp_extract_all(F.col(text), F.lit(PAGE_MARK), F.lit(0))
    numbers = F.transform(marks, lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("int"))
    bodies = F.slice(F.split(F.col(text), PAGE_MARK, -1), 2, F.greatest(F.size(marks), F.lit(0)))
    zipped = F.arrays_zip(numbers.alias("page"), bodies.alias("text"))
    rows = df.select(*key, F.posexplode_outer(zipped).alias("page_no", "p"))
    return rows.filter(F.col("page_no").isNotNull()).select(
        *key, F.col("p")["page"].alias("page"), F.rtrim(F.col("p")["text"], F.lit("\n")).alias("text"))


def pages_processed(df: DataFrame, key=("doc_id",), text="text") -> DataFrame:
    return df.select(*key, F.regexp_count(text, F.lit(PAGE_MARK)).alias("pages_processed"))


def lines_of(df: DataFrame, key=("doc_id",), text="text") -> DataFrame:
    """Numbered lines, from 1."""
    return df.select(*key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "line")).select(
        *key, (F.col("i") + 1).alias("line_number"), "line")


def preview(c):
    return F.when(F.length(c) > PREVIEW, F.concat(F.substring(c, 1, PREVIEW), F.lit("..."))).otherwise(c)


def type_summary(hits):
    """map<type, values in position order> of a hits array."""
    types = F.array_distinct(F.transform(hits, lambda h: h["type"]))
    return F.map_from_entries(F.transform(types, lambda t: F.struct(
        t, F.transform(F.filter(hits, lambda h: h["type"] == t), lambda h: h["value"]))))


def _with_hits(found: DataFrame, hits="hits") -> DataFrame:
    """Rows that have hits. The hits pass through a generator first: a filter on
    them alone would be pushed below the projection and detect a second time."""
    rest = [c for c in found.columns if c != hits]
    once = found.select(*rest, F.explode_outer(F.array(F.struct(F.col(hits).alias(hits)))).alias("__g"))
    return once.select(*rest, F.col(f"__g.{hits}").alias(hits)).filter(F.size(hits) > 0)


def _detect_units(units: DataFrame, text: str) -> DataFrame:
    """Generic hits of each non-blank unit, with count, preview and summary."""
    found = add_generic_hits(units.filter(F.length(strip(F.col(text))) > 0), text=text)
    return (
        _with_hits(found)
        .withColumn("pii_count", F.size("hits"))
        .withColumn("content", preview(F.col(text)))
        .withColumn("summary", type_summary(F.col("hits")))
        .drop(text)
    )


def detect_by_line(df: DataFrame, key=("doc_id",), text="text") -> DataFrame:
    """Lines holding hits; row-local, so a long document needs no shuffle."""
    return _detect_units(lines_of(df, key, text), "line")


def line_totals(df: DataFrame, key=("doc_id",), text="text") -> DataFrame:
    """Per document: all lines, lines with hits, hits."""
    total = F.size(F.split(F.col(text), "\n", -1)).alias("total_lines")
    lines = detect_by_line(df, key, text).groupBy(*key).agg(
        F.count("*").alias("lines_with_pii"), F.sum("pii_count").alias("total_pii_found"))
    return (
        df.select(*key, total).join(lines, list(key), "left")
        .fillna(0, ["lines_with_pii", "total_pii_found"])
    )


def line_stats(df: DataFrame, key=("doc_id",), text="text") -> DataFrame:
    """Line counts and lengths of each document."""
    sized = df.select(*key, F.transform(F.split(F.col(text), "\n", -1), lambda x: F.struct(
        F.length(x).alias("len"), (F.length(strip(x)) > 0).alias("full"))).alias("ls"))
    total = F.aggregate("ls", F.lit(0).cast("bigint"), lambda a, x: a + x["len"])
    return sized.select(
        *key,
        F.size("ls").alias("total_lines"),
        F.size(F.filter("ls", lambda x: x["full"])).alias("non_empty_lines"),
        (total / F.size("ls")).alias("average_line_length"),
        F.array_max(F.transform("ls", lambda x: x["len"])).alias("max_line_length"),
    )


def detect_by_page(pages: DataFrame, key=("doc_id", "page"), text="text", types=None) -> DataFrame:
    """Base hits and their number for each page."""
    found = add_base_hits(pages.select(*key, text), text=text, types=types)
    return _with_hits(found).select(*key, F.size("hits").alias("pii_count"), "hits")


def detect_by_element(elements: DataFrame) -> DataFrame:
    """Generic hits of each paragraph or table row."""
    return _detect_units(elements.filter(F.col("kind").isin("paragraph", "table_row")), "text")


def element_stats(elements: DataFrame, key=("doc_id",)) -> DataFrame:
    """Structure of each document: paragraphs, tables, sections, header, footer."""
    kind = F.col("kind")
    return elements.groupBy(*key).agg(
        F.count_if(kind == "paragraph").alias("total_paragraphs"),
        F.count_distinct(F.when(kind == "table_row", F.col("table_no"))).alias("total_tables"),
        F.count_distinct("section_no").alias("total_sections"),
        F.bool_or(kind == "header").alias("has_headers"),
        F.bool_or(kind == "footer").alias("has_footers"),
    )


def scan_table(df: DataFrame, key: list[str], cols: list[str], kind="base", **options) -> DataFrame:
    """Hits in every cell of the chosen columns: key, column_name and the hit."""
    cells = df.select(*key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        key, cols, "column_name", "cell")
    return detect(cells.filter(F.col("cell").isNotNull()), kind, key=(*key, "column_name"),
                  text="cell", **options)


def column_hit_rate(df: DataFrame, key: list[str], cols: list[str], kind="base", **options) -> DataFrame:
    """Per column and type: hits, cells with a hit and their share of all rows."""
    hits = scan_table(df, key, cols, kind, **options)
    per_cell = hits.groupBy(*key, "column_name", "type").agg(F.count("*").alias("n"))
    per_type = per_cell.groupBy("column_name", "type").agg(
        F.sum("n").alias("hits"), F.count("*").alias("cells"))
    rows = df.agg(F.count("*").alias("rows")).withColumn("one", F.lit(1))
    # one row with one number: the size of this side does not grow
    return (
        per_type.withColumn("one", F.lit(1)).join(F.broadcast(rows), "one")
        .select("column_name", "type", "hits", "cells", F.round(F.col("cells") / F.col("rows"), 4).alias("hit_rate"))
    )
