"""Reading documents, admitting files, choosing a detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import strip
from ..operators.detect import add_context_hits, add_base_hits, add_label_hits, explode_hits
from ..operators.ordered import numbered

# Extensions accepted for upload, and the kinds of files.
ALLOWED_EXTENSIONS = ["pdf", "docx", "txt", "csv", "png", "jpg", "jpeg", "json"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "svg"]
LABEL_EXTENSIONS = ["pdf", "txt", "docx", "doc"]
UPLOAD_LIMIT = 500 * 1024 * 1024
API_LIMIT = 50 * 1024 * 1024
# Characters refused in a path.
BAD_PATH_CHARS = r"[<>|&;`$()]"


def decode(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1"))


def read_text_docs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file of text, CSV or JSON kind: path, filename, file_type, length, text."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"),
        extension(F.col("path")).alias("file_type"), "length", decode(F.col("content")).alias("text"))


def scan_directory(spark: SparkSession, path: str, glob="*", **options):
    """(files found, hits) of the files of one directory matching a glob."""
    docs = read_text_docs(spark, path, glob)
    routed = route_detector(docs)
    return docs.agg(F.count("*").alias("files_found")), detect_routed(routed, key=("path",), **options)


def extension(c: Column) -> Column:
    """Lower-case extension, empty when there is none."""
    return F.lower(F.regexp_extract(c, r"\.([^./\\]*)$", 1))


def admit_files(files: DataFrame, limit: int = UPLOAD_LIMIT, path="path", size="length") -> DataFrame:
    """Add ``admitted`` and ``reason`` by extension and size."""
    ext = extension(F.col(path))
    reason = (
        F.when(F.coalesce(F.col(path), F.lit("")) == "", "No filename provided")
        .when(~ext.isin(ALLOWED_EXTENSIONS), F.concat(F.lit("File type '"), ext, F.lit("' not allowed")))
        .when(F.col(size) > limit, F.concat(
            F.lit("File size "), F.col(size).cast("string"), F.lit(f" exceeds maximum {limit} bytes")))
        .when(F.col(size) == 0, "File is empty")
    )
    return files.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def safe_path(c: Column) -> Column:
    """False for empty, absolute or upward paths and for shell characters.

    A ``..`` that a preceding folder cancels out (``a/../b``) is harmless at
    any depth; empty and ``.`` parts count for nothing.
    """
    parts = F.filter(F.split(c, "/", -1), lambda p: (p != "") & (p != "."))
    climbs = lambda done, p: (p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    left = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(
        climbs(done, p), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(p))))
    flat = F.array_join(left, "/")
    return F.coalesce(
        (c != "") & ~F.startswith(c, F.lit("/")) & ~F.contains(flat, F.lit("..")) & ~flat.rlike(BAD_PATH_CHARS),
        F.lit(False))


def sanitize_filename(c: Column) -> Column:
    """Base name with other than letters, digits, dot, underscore, dash replaced."""
    return F.left(F.regexp_replace(F.substring_index(c, "/", -1), r"[^A-Za-z0-9._\-]", "_"), F.lit(255))


def skip_processed(new: DataFrame, done: DataFrame):
    """(files still to do, files skipped) by sanitised name within the batch."""
    named = new.withColumn("filename", sanitize_filename(F.col("filename")))
    known = done.select("batch_id", "filename").distinct()
    on = ["batch_id", "filename"]
    return named.join(known, on, "left_anti"), named.join(known, on, "left_semi")


def dedupe_by_content(df: DataFrame, content="text", key="doc_id") -> DataFrame:
    """One representative per identical content: content_hash, first key, copies."""
    hashed = df.select(key, F.sha2(F.col(content), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def copies_of(df: DataFrame, content="text", key="doc_id") -> DataFrame:
    """Each document with the representative whose result it shares."""
    hashed = df.select(key, F.sha2(F.col(content), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("representative"))
    return hashed.join(first, "content_hash").drop("content_hash")


def csv_as_document(df: DataFrame, file: list[str], position: str, cols: list[str],
                    block_rows: int | None = None, parity=True) -> DataFrame:
    """Tables as texts: row lines, then every cell column by column.

    ``position`` numbers the rows of a file from 0.  A file is one text at every
    size, unless the caller asks for texts of ``block_rows`` rows; with
    ``parity`` missing cells show as ``nan`` in the cell list.
    """
    texts = [F.col(c).cast("string") for c in cols]
    line = F.concat_ws(" ", *texts)
    cells = [F.coalesce(t, F.lit("nan")) if parity else t for t in texts]
    rows = df.select(
        *file, (F.floor(F.col(position) / block_rows) if block_rows else F.lit(0).cast("bigint")).alias("block"), F.col(position).alias("__p"),
        line.alias("__line"), *[c.alias(f"__c{i}") for i, c in enumerate(cells)])
    names = [f"__c{i}" for i in range(len(cols))]
    packed = F.array_sort(F.collect_list(F.struct("__p", "__line", *names)))
    blocks = rows.groupBy(*file, "block").agg(packed.alias("__rows"))
    lines = F.array_join(F.transform("__rows", lambda r: r["__line"]), "\n")
    column = lambda n: F.transform("__rows", lambda r: r[n])
    flat = F.flatten(F.array(*[column(n) for n in names]))
    flat = F.filter(flat, lambda x: x.isNotNull() & (F.length(strip(x)) > 0))
    return blocks.select(*file, "block", F.concat(lines, F.lit("\n"), F.array_join(flat, " ")).alias("text"))


def number_rows(df: DataFrame, file: list[str], order: list[str], out="position") -> DataFrame:
    """Position of each row in its file, for tables that carry none; a file of any size is spread over all tasks."""
    return numbered(df, file, order, out)


def route_detector(docs: DataFrame, name="filename") -> DataFrame:
    """Add the detector and pipeline a file's kind calls for."""
    ext = extension(F.col(name))
    image = ext.isin(IMAGE_EXTENSIONS)
    return docs.withColumns({
        "detector_used": F.when(ext.isin(LABEL_EXTENSIONS), "LABEL-BASED")
        .when((ext == "csv") | image, "ADVANCED").otherwise("LABEL-BASED (default)"),
        "pipeline_used": F.when(image, "blocks + base_detector")
        .when(ext.isin(LABEL_EXTENSIONS), "text_extraction + label_based_detector")
        .when(ext == "csv", "table_text + advanced_detector").otherwise("UNKNOWN"),
    })


def detect_routed(routed: DataFrame, key=("doc_id",), text="text") -> DataFrame:
    """Hits of routed documents: label, context, or (images) base then context.

    One scan and one projection: each catalog gets the text of its own documents
    and a null for the others, images a second look only where the base scan
    found nothing.
    """
    keys = [*key, "detector_used", "pipeline_used"]
    image = F.coalesce(F.col("pipeline_used") == "blocks + base_detector", F.lit(False))
    label = F.coalesce(F.startswith("detector_used", F.lit("LABEL")), F.lit(False)) & ~image
    table = F.coalesce(F.col("detector_used") == "ADVANCED", F.lit(False)) & ~image
    rows = routed.select(*keys, F.col(text).alias("__whole"))
    rows = add_base_hits(rows.withColumn("__own", F.when(image, F.col("__whole"))), text="__own", out="__base")
    # through a generator, so that the base hits are found once for the test and the result
    rows = rows.select(*keys, "__whole", F.explode_outer(F.array(F.struct("__base"))).alias("__g")).select(*keys, "__whole", "__g.__base")
    again = image & (F.size("__base") <= 0)
    rows = add_context_hits(rows.withColumn("__own", F.when(table | again, F.col("__whole"))), text="__own", out="__context")
    rows = add_label_hits(rows.withColumn("__own", F.when(label, F.col("__whole"))), text="__own", out="__label")
    hits = F.when(label, F.col("__label")).when(table | again, F.col("__context")).when(image, F.col("__base"))
    return explode_hits(rows.withColumn("hits", hits), keys)


def assemble_blocks(blocks: DataFrame, key="doc_id") -> DataFrame:
    """Document text from recognised text blocks, by line."""
    lines = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(lines, lambda b: b["text"]), "\n").alias("text"))


def prefer_fallback_blocks(blocks: DataFrame, other: DataFrame, threshold=0.65, given=0.75, key="doc_id") -> DataFrame:
    """Weak blocks take a longer second reading, with a fixed confidence."""
    alt = other.select(key, "line_number", F.col("text").alias("__alt"))
    take = (F.col("confidence") < threshold) & (F.coalesce(F.length("__alt"), F.lit(0)) > F.length("text"))
    return (
        blocks.join(alt, [key, "line_number"], "left")
        .withColumn("__take", take)
        .withColumns({
            "text": F.when(F.col("__take"), F.col("__alt")).otherwise(F.col("text")),
            "confidence": F.when(F.col("__take"), F.lit(given)).otherwise(F.col("confidence"))})
        .drop("__alt", "__take")
    )


def human_size(c: Column) -> Column:
    """Bytes with a unit, two decimals, base 1024; exact halves go to even.

    Worked out in decimals, so a sum of sizes may be larger than a bigint.
    """
    given = c.cast("decimal(38,6)")
    n = (given - given % 1).cast("decimal(38,0)")

    def shown(power, unit):
        size = 1024 ** power
        rest = (n % F.lit(size).cast("decimal(38,0)")).cast("bigint")
        whole = ((n - rest) / F.lit(size).cast("decimal(13,0)")).cast("decimal(38,0)")
        cents = F.floor(rest * 100 / size).cast("bigint")
        left = rest * 100 - cents * size
        up = (left * 2 > size) | ((left * 2 == size) & (cents % 2 == 1))
        cents = cents + up.cast("bigint")
        return F.concat((whole + F.floor(cents / 100)).cast("decimal(38,0)").cast("string"), F.lit("."),
                        F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))

    return (
        F.when(n < 1024, shown(0, "B")).when(n < 1024 ** 2, shown(1, "KB"))
        .when(n < 1024 ** 3, shown(2, "MB")).when(n < 1024 ** 4, shown(3, "GB")).otherwise(shown(4, "TB"))
    )
