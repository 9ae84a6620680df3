"""Line de-duplication by overlapping windows of three lines."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import stored, text_hash, to_arrow_schema

LINES = 3


def windows(text: str | None, lines: int = LINES) -> list[tuple[int, int, int, int, bool]]:
    """(two halves of the window's hash, first line, last line, whether it stood before in this text). Lines without a
    word (``[^\\x20\\x09-\\x0D]``) are passed over: a window is of lines with one."""
    data = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    at = [(i, xxhash.xxh3_128_digest(line)) for i, line in enumerate(data) if line and not line.isspace()]
    seen, out = set(), []
    for k in range(len(at) - lines + 1):
        h = xxhash.xxh3_128_digest(b"".join(d for _, d in at[k: k + lines]))
        out.append((int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), at[k][0], at[k + lines - 1][0], h in seen))
        seen.add(h)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Covered line numbers as runs that neither touch nor overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    lines, kept, at = text.split("\n"), [], 0
    for a, b in spans:
        kept += lines[at:a]
        at = b + 1
    return "\n".join(kept + lines[at:])


def later_windows(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text hash, spans): the windows of each text that stood before, in it or in a document of a lesser id.

    Only hashes move. Counts and least ids are added up on the map side, and a window that a third of all rows share
    is a skewed join on one row, which can be split.
    """
    def run(batches):
        names, kinds = ["doc_id", "t", "found"], to_arrow_schema(schema)
        for batch in batches:
            found = [[dict(zip(("h1", "h2", "first", "last", "again"), w)) for w in windows(t, lines)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kinds.field(2).type)], names=names)

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("t"))
    one = StructType.fromDDL("found array<struct<h1:long,h2:long,first:int,last:int,again:boolean>>")
    schema = StructType([given.schema["doc_id"], StructField("t", given.schema["t"].dataType), one["found"]])
    rows = stored(given.mapInArrow(run, schema), "windows").select("doc_id", "t", F.inline("found"))
    repeated = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = rows.join(repeated, ["h1", "h2"]).filter(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("owner")))
    return later.groupBy("doc_id", "t").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def drop_repeated_lines(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with later occurrences of repeated windows taken out of the text, and ``_llm_lines``: a struct of
    n_lines (with a word), n_removed (of these) and spans (first and last line number of each removed run, from 0).

    The occurrence in the document of the least id stays, and in it the first one. A removed window goes with the blank
    lines inside it; covered positions are merged. Texts of fewer than ``lines`` lines with a word keep all. Null texts
    stay null. Rows that repeat an id are one document: they are not compared with each other. Null ids come after all
    others. An empty table gives no rows; other columns are kept as they are.
    """
    spans = later_windows(docs, lines, id_col, text_col)
    spans = spans.select(F.col("doc_id").alias("_llm_id"), F.col("t").alias("_llm_t"), F.col("spans").alias("_llm_spans"))
    both = docs.join(spans, F.col(id_col).eqNullSafe(F.col("_llm_id")) & (text_hash(F.col(text_col)) == F.col("_llm_t")), "left")
    both = both.select(*(docs[c] for c in docs.columns), "_llm_spans")
    fields = StructType.fromDDL("_llm_lines struct<n_lines:long,n_removed:long,spans:array<struct<first:int,last:int>>>")
    out = StructType([*docs.schema.fields, fields["_llm_lines"]])
    kind, at, names = to_arrow_schema(fields).field(0).type, docs.columns.index(text_col), [*docs.columns, "_llm_lines"]

    def run(batches):
        for batch in batches:
            texts, told = [], []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                cut = merged([(s["first"], s["last"]) for s in spans or ()])
                words = [bool(x.strip(" \t\n\v\f\r")) for x in (text or "").split("\n")]
                told.append({"n_lines": sum(words), "n_removed": sum(sum(words[a: b + 1]) for a, b in cut), "spans": [{"first": a, "last": b} for a, b in cut]})
                texts.append(without(text, cut) if cut else text)
            cols = batch.columns[:-1]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(told, kind)], names=names)

    return both.mapInArrow(run, out)


def dedup_lines(docs: DataFrame, lines: int = LINES, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents without repeated windows, in their own columns. One that lost lines and has no word left goes;
    ``length_col``, where there is one, follows the text."""
    told = drop_repeated_lines(docs, lines, text_col=text_col)
    cut = F.col("_llm_lines.n_removed") > 0
    left = told.filter(~cut | (F.col("_llm_lines.n_removed") < F.col("_llm_lines.n_lines")))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        left = left.withColumn(length_col, F.when(cut, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return left.select(*docs.columns)
