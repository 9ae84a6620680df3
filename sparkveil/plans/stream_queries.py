"""Queries that run as streams over the given files, up to what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources.scratch import scratch_path
from ..streaming import streams as T
from . import corpora as C
from . import sqlgen as S
from .analytics_queries import entries
from .detection_queries import DOCS, HIT_COLS, HIT_SQL
from .ledger_queries import DEBITS, HOUR, RATE
from .registry import ORACLES, query


def _path(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _result(spark, df, name, mode="append"):
    path = _path(spark, name)
    T.run_available(df, path, mode)
    return spark.read.schema(df.schema).parquet(f"{path}/data")


@query("stream_detect", f"WITH RECURSIVE {S.base_ctes(DOCS)} SELECT {HIT_SQL} FROM kept")
def stream_detect(spark, sf):
    docs = T.stream_parquet(spark, sf, "documents.parquet")
    return _result(spark, T.stream_detect(docs), "detect").select(*HIT_COLS)


@query("stream_skip_seen", f"SELECT DISTINCT batch_id, filename FROM ({C.HITS})")
def stream_skip_seen(spark, sf):
    li = T.stream_parquet(spark, sf, "lineitem.parquet")
    p = F.col("l_partkey") % 40
    files = li.select(
        C.cat("B", F.col("l_suppkey")).alias("batch_id"),
        C.cat("file_", p, ".", C.pick(C.FORMATS, p % len(C.FORMATS))).alias("filename"),
        F.col("l_shipdate").cast("timestamp").alias("arrived_at"))
    return _result(spark, T.stream_skip_seen(files), "seen").select("batch_id", "filename")


@query("stream_batch_stats", f"""WITH h AS ({C.HITS}), f AS (SELECT batch_id, count(*) AS files, sum(page)::BIGINT AS pages_processed, max(processed_at)::TIMESTAMP AS processed_at FROM h GROUP BY 1),
 t AS (SELECT batch_id, type, count(*) AS n FROM h GROUP BY 1, 2), b AS (SELECT batch_id, sum(n)::BIGINT AS piis, count(*) AS pii_types, string_agg(concat(type, '=', n), ';' ORDER BY type) AS breakdown FROM t GROUP BY 1)
 SELECT f.batch_id, files, piis, pii_types, breakdown, pages_processed, files / 4 AS scan_duration, processed_at FROM f JOIN b USING (batch_id)""")
def stream_batch_stats(spark, sf):
    # every line item is a scanned page of one hit
    li = T.stream_parquet(spark, sf, "lineitem.parquet")
    kind = C.pick(C.TYPES, (F.col("l_partkey") * 7 + F.col("l_linenumber")) % len(C.TYPES))
    files = li.select(
        C.cat("B", F.col("l_suppkey")).alias("batch_id"), F.create_map(kind, F.lit(1).cast("bigint")).alias("breakdown"),
        F.col("l_linenumber").alias("page_count"), F.lit(0.25).alias("processing_time"), F.col("l_shipdate").cast("timestamp").alias("processed_at"))
    path = _path(spark, "stats")
    writer = T.stream_batch_stats(files, span="30 days").writeStream.outputMode("update").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}/ckpt").foreachBatch(T.upsert(f"{path}/data")).start().awaitTermination()
    out = T.batch_totals(T.latest(spark, f"{path}/data"))
    return out.select("batch_id", "files", "piis", "pii_types", entries(F.col("breakdown")).alias("breakdown"), "pages_processed",
                      "scan_duration", F.col("processed_at").cast("timestamp_ntz").alias("processed_at"))


PARTS = 4


def _replayed(spark, events, name, jitter=3600):
    """The events as files that arrive one part after the other, out of order by up to ``jitter`` seconds, then one
    event of the far future, which lets the watermark pass all others."""
    path = f"{_path(spark, name)}/in"
    at = F.unix_seconds("ts") + F.pmod(F.hash("event_id"), F.lit(jitter))
    first, last = events.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - (first or 0)) * PARTS / ((last or 0) - (first or 0) + 1)), F.lit(PARTS - 1))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(PARTS):
        events.filter(part == i).repartition(files).write.mode("append").parquet(path)
    end = spark.range(1).select(*[
        (F.to_timestamp(F.lit("2200-01-01")) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    end.write.mode("append").parquet(path)
    return T.stream_parquet(spark, path, "*.parquet", files_per_trigger=files)


def _copy(name, of):
    ORACLES[name] = ORACLES[of]


@query("stream_rate_limit")
def stream_rate_limit(spark, sf):
    e = C.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"),
        (F.col("user_id") % 4).alias("client"))
    late = _replayed(spark, e, "requests")
    return _result(spark, T.stream_rate_limit(late, RATE, HOUR, delay="2 hours", bucket_ms=24 * HOUR * 1000), "rate").select("event_id", "admitted")


_copy("stream_rate_limit", "rate_limit")


@query("stream_ledger", f"""WITH RECURSIVE d AS ({DEBITS}), w AS (
 SELECT user_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, 0::BIGINT AS amount, true AS admitted, 150::BIGINT AS balance_after FROM (SELECT DISTINCT user_id FROM d)
 UNION ALL SELECT d.user_id, d.rn, d.event_id, d.amount, d.amount <= 0 OR w.balance_after >= d.amount,
  CASE WHEN NOT (d.amount <= 0 OR w.balance_after >= d.amount) THEN w.balance_after ELSE w.balance_after - d.amount END
 FROM w JOIN d ON d.user_id = w.user_id AND d.rn = w.rn + 1)
 SELECT event_id, user_id, amount, admitted, balance_after FROM w WHERE rn > 0""")
def stream_ledger(spark, sf):
    e = C.table(spark, sf, "events")
    kind = F.col("event_type")
    # the same prices as ``price_actions``, written as a column: streams keep no price table
    named = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.when(kind == "signup", "create_batch").when(
        kind == "click", "scan_file").when(kind == "view", "download_masked_file").when(kind == "purchase", "lock_json").alias("action"))
    priced = L.price_actions(named)
    amount = F.when(F.col("action") == "create_batch", -100).otherwise(F.col("price"))
    debits = priced.select("event_id", "ts", "user_id", amount.cast("bigint").alias("amount"))
    late = _replayed(spark, debits, "debits")
    return _result(spark, T.stream_ledger(late, delay="2 hours", bucket_ms=24 * HOUR * 1000), "ledger").select("event_id", "user_id", "amount", "admitted", "balance_after")


@query("stream_progress", """SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value IS NOT NULL AND value >= 10) AS completed,
 CASE WHEN count(*) FILTER (WHERE value >= 10) > 0 THEN round((epoch(max(date_trunc('second', ts)) FILTER (WHERE value >= 10))::BIGINT - epoch(min(date_trunc('second', ts)) FILTER (WHERE value >= 10))::BIGINT)
  * (count(*) - count(*) FILTER (WHERE value >= 10)) / count(*) FILTER (WHERE value >= 10), 1) END AS seconds_left FROM events GROUP BY 1""")
def stream_progress(spark, sf):
    events = T.stream_parquet(spark, sf, "events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    done = _result(spark, events.filter("value >= 10"), "progress")
    return T.progress(done, C.table(spark, sf, "events"), ["event_type"], "ts").drop("first", "last")
