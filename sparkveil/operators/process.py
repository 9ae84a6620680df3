"""One batch from files to ledger: skip what is known, route, detect, normalise, store, add up, debit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import detect_routed, route_detector, skip_processed
from ..sources.sinks import write_detections
from .analytics import batch_stats, file_results
from .dedupe import normalize_detections
from .ledger import price_actions

KEY = ("doc_id", "batch_id", "filename")


def process_batch(docs: DataFrame, done: DataFrame, path: str, action="scan_file", run: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file entries, batch totals, debits) of the documents that ``done`` does not name yet.

    ``docs`` has doc_id, batch_id, filename and text, ``done`` batch_id and filename. Hits are found once and written
    below ``path``, a folder that all executors share, under the name of this ``run``, so that a repeated run does not add
    them twice; all three results read them from there.
    """
    run = run or uuid.uuid4().hex
    todo, _ = skip_processed(docs, done)
    found = normalize_detections(detect_routed(route_detector(todo), KEY))
    write_detections(found, path, run=run)
    stored = docs.sparkSession.read.schema(found.withColumn("run", F.lit("")).schema)
    hits = stored.parquet(path).filter(F.col("run") == run).drop("run")
    names = todo.select("doc_id", "batch_id", "filename")
    entries = file_results(todo, hits).join(names, "doc_id")
    facts = {"page_count": F.lit(1), "processing_time": F.lit(0.0), "processed_at": F.lit(None).cast("timestamp")}
    totals = batch_stats(entries.withColumns(facts), hits).drop("processed_at", "scan_duration")
    priced = price_actions(entries.filter("success").withColumn("action", F.lit(action)))
    debits = priced.groupBy("batch_id").agg(F.sum("price").cast("bigint").alias("debit"))
    return entries, totals, debits
