"""The same operators on documents and events that keep arriving."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.detect import ADDERS, explode_hits

#: Keyed state with lists and timers lives in this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_parquet(spark: SparkSession, folder: str, glob: str, files_per_trigger: int = 8) -> DataFrame:
    """New parquet files of a folder as a stream, with the schema of those there.

    What ``glob`` names may be files or folders of files.
    """
    spec = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{glob}")
    named = spec.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spec) or []
    path, only = (spec.toString(), {}) if any(f.isDirectory() for f in named) else (folder, {"pathGlobFilter": glob})
    schema = spark.read.options(**only).parquet(path).schema
    return spark.readStream.schema(schema).options(**only).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(df: DataFrame, path: str, mode="append", partition_by=()):
    """Process everything there is, exactly once, into parquet; returns the query."""
    writer = df.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.option("checkpointLocation", f"{path}/_ckpt").start(f"{path}/data")
    query.awaitTermination()
    return query


def stream_detect(docs: DataFrame, kind="base", key=("doc_id",), text="text", **options) -> DataFrame:
    """Hits of arriving documents; row-local, so no state is kept."""
    return explode_hits(ADDERS[kind](docs.select(*key, text), text=text, **options), list(key))


def stream_skip_seen(files: DataFrame, arrived="arrived_at", delay="1 day") -> DataFrame:
    """The same file name in a batch only once within the watermark's delay."""
    return files.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["batch_id", "filename"])


def stream_batch_stats(files: DataFrame, arrived="processed_at", delay="1 hour", span="1 hour") -> DataFrame:
    """Totals of arriving files by batch, type and stretch of time, to be kept by ``upsert``.

    ``files`` has batch_id, page_count, processing_time, ``breakdown`` (hits by type) and, if some failed, ``success``.
    A row without a type holds the totals of the files themselves.  A stretch of ``span`` is part of the key, so its
    state goes once the watermark has passed it; the totals of a batch are the sums over its stretches (``batch_totals``).
    """
    good = files.filter(F.coalesce("success", F.lit(True))) if "success" in files.columns else files
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    whole = F.struct(none.alias("type"), F.lit(1).cast("bigint").alias("files"), zero.alias("n"),
                     n("page_count").cast("bigint").alias("pages"), n("processing_time").cast("double").alias("spent"))
    by_type = F.transform(F.map_entries(F.coalesce("breakdown", F.create_map().cast("map<string,bigint>"))), lambda e: F.struct(
        e["key"].alias("type"), zero.alias("files"), e["value"].cast("bigint").alias("n"), zero.alias("pages"), F.lit(0.0).alias("spent")))
    rows = good.withWatermark(arrived, delay).select("batch_id", arrived, F.explode(F.concat(F.array(whole), by_type)).alias("r"))
    return rows.groupBy(F.window(arrived, span).alias("stretch"), "batch_id", F.col("r.type").alias("type")).agg(
        F.sum("r.files").alias("files"), F.sum("r.n").alias("n"), F.sum("r.pages").alias("pages_processed"),
        F.sum("r.spent").alias("scan_duration"), F.max(arrived).alias("processed_at"))


STRETCH = ("stretch", "batch_id", "type")
#: Every so many micro-batches all newest rows are written together, so that a reader needs no older ones.
COMPACT_EVERY = 20


def _newest(rows: DataFrame, keys) -> DataFrame:
    # field by field, all at the same newest version: numbers and times are hashed, where a struct of them would be sorted
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "v").alias(c) for c in rest])


def upsert(path: str, keys=STRETCH, every: int = COMPACT_EVERY):
    """A foreachBatch function that keeps the newest row of each key.

    A micro-batch writes the rows that changed as version ``v``; replaying it overwrites itself.  Each version that
    ``every`` divides holds all newest rows instead.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("v", F.lit(number))
        if number and number % every == 0:
            rows = _newest(rows.unionByName(_readable(batch.sparkSession, path, every, number)), keys)
        rows.drop("v").write.mode("overwrite").parquet(f"{path}/v={number}")
    return write


def _readable(spark: SparkSession, path: str, every: int, below: int | None = None) -> DataFrame:
    """The versions from the last whole one on (before ``below``)."""
    rows = spark.read.parquet(path)
    if below is not None:
        rows = rows.filter(F.col("v") < below)
    whole = rows.filter(F.col("v") % every == 0).agg(F.max("v")).first()[0] or 0
    return rows.filter(F.col("v") >= whole)


def latest(spark: SparkSession, path: str, keys=STRETCH, every: int = COMPACT_EVERY) -> DataFrame:
    """The newest row of each key that ``upsert`` keeps."""
    return _newest(_readable(spark, path, every), keys).drop("v")


def batch_totals(stretches: DataFrame) -> DataFrame:
    """Per batch, over all its stretches: files, hits, types, breakdown, pages, time, latest."""
    per_type = stretches.groupBy("batch_id", "type").agg(
        F.sum("files").alias("files"), F.sum("n").alias("n"), F.sum("pages_processed").alias("pages"),
        F.sum("scan_duration").alias("spent"), F.max("processed_at").alias("at"))
    typed = F.when(F.col("type").isNotNull(), F.struct("type", "n"))
    return per_type.groupBy("batch_id").agg(
        F.sum("files").alias("files"), F.sum("n").alias("piis"), F.count("type").alias("pii_types"),
        F.map_from_entries(F.array_sort(F.collect_list(typed))).alias("breakdown"),
        F.sum("pages").alias("pages_processed"), F.sum("spent").alias("scan_duration"), F.max("at").alias("processed_at"))


#: Waiting events that a key holds beside its state; more of them are filed by bucket.
FEW_WAITING = 1024


def in_order(events: DataFrame, keys: list[str], ts: str, order: str, carry: list[str], delay: str, bucket_ms: int,
             opening, decide, forget, report: str) -> DataFrame:
    """Decide a stream's events key by key in the order of (ts, order), whatever order they arrive in.

    Events wait in buckets of ``bucket_ms`` until the watermark (``delay`` behind the newest event of all) has passed a
    bucket; then ``decide(state, rows)`` sees its rows in order and returns the next state and a report for each row.
    A key holds its state, a few waiting events beside it, and more of them in buckets, of which one is read at a time.
    It has one timer at a time, which decides all that the watermark has passed: a micro-batch costs a key a handful of
    calls to the state store, however many buckets its events lie in.  ``forget(state, now)`` returns what
    of the state still counts at a time, and when to ask again (null: never); a state that is null is given back.
    Events later than the watermark are dropped by Spark; events without a time are decided in the next micro-batch.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    width, few = bucket_ms * 1000, FEW_WAITING
    names = ["__at", order, *carry]

    class InOrder(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "bucket bigint", "rows binary")
            self.state = handle.getValueState("state", "held binary")

        def held(self):
            """The state, the rows that wait beside it, the buckets of those filed, and the time of the next timer."""
            got = self.state.get()
            return pickle.loads(got[0]) if got else (None, [], set(), None)

        def file(self, rows, filed):
            parts = {}
            for r in rows:
                parts.setdefault(r[0] // width, []).append(r)
            for bucket, part in parts.items():
                if bucket in filed:
                    part = pickle.loads(self.waiting.getValue((bucket,))[0]) + part
                self.waiting.updateValue((bucket,), (pickle.dumps(part),))
                filed.add(bucket)

        def handleInputRows(self, key, frames, timerValues):
            state, rows, filed, timer = self.held()
            for frame in frames:
                frame = frame.set_axis(given, axis=1)  # by place: computed columns come without their names
                new = list(frame[names].itertuples(index=False, name=None))
                due = (min(r[0] for r in new) // width + 1) * bucket_ms
                if timer is None or due < timer:
                    self.handle.registerTimer(due)
                    timer = due
                rows += new
                if len(rows) > few:
                    self.file(rows, filed)
                    rows = []
            self.state.update((pickle.dumps((state, rows, filed, timer)),))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
            passed = now // width  # buckets before this one are complete
            state, rows, filed, _ = self.held()
            state = opening if state is None else state
            due = {}  # one bucket after the other where some are filed, else all at once
            for r in rows:
                if r[0] // width < passed:
                    due.setdefault(r[0] // width if filed else 0, []).append(r)
            rows = [r for r in rows if r[0] // width >= passed]
            for bucket in sorted({b for b in filed if b < passed}.union(due)):
                part = due.pop(bucket, [])
                if bucket in filed:
                    part += pickle.loads(self.waiting.getValue((bucket,))[0])
                    self.waiting.removeKey((bucket,))
                    filed.remove(bucket)
                part.sort(key=lambda r: r[:2])
                state, reports = decide(state, part)
                out = pd.DataFrame([(*key, *r, *x) for r, x in zip(part, reports)])
                yield out.set_axis([*keys, *names, *reported], axis=1)
            # what waits still may be as old as the start of the bucket that this time lies in
            state, again = forget(state, passed * width)
            times = [(b + 1) * bucket_ms for b in filed.union(r[0] // width for r in rows)]
            if state is not None and again is not None:
                times.append((again // width + 1) * bucket_ms)
            if state is None and not times:
                self.state.clear()
            else:
                self.state.update((pickle.dumps((state, rows, filed, min(times, default=None))),))
            if times:
                self.handle.registerTimer(min(times))

        def close(self):
            pass

    reported = [f.split()[0] for f in report.split(", ")]
    at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0)).alias("__at")
    timed = events.withWatermark(ts, delay).select(*keys, ts, at, order, *carry)
    given, kinds = timed.columns, {f.name: f.dataType.simpleString() for f in timed.schema.fields}
    shape = ", ".join([f"`{c}` {kinds[c]}" for c in [*keys, *names]] + [report])
    out = timed.groupBy(*keys).transformWithStateInPandas(InOrder(), shape, "append", "EventTime")
    return out.select(*keys, F.when(F.col("__at") != 0, F.timestamp_micros("__at")).cast(kinds[ts]).alias(ts), order, *carry, *reported)


def stream_rate_limit(events: DataFrame, most: int, window: float, keys=("endpoint", "client"), ts="ts",
                      order="event_id", delay="1 hour", bucket_ms: int = 60_000) -> DataFrame:
    """Exact limiter on a stream (``in_order``).  State per key: at most ``most`` admitted times, given back once the
    watermark has passed the last of them by a window."""
    limit = int(window * 1_000_000)

    def decide(times, rows):
        passed = []
        for row in rows:
            times = [t for t in times if row[0] - t < limit]
            passed.append((len(times) < most,))
            if passed[-1][0]:
                times.append(row[0])
        return times, passed

    def forget(times, now):
        live = [t for t in times if now - t < limit]
        return (live, max(live) + limit) if live else (None, None)

    return in_order(events, list(keys), ts, order, [], delay, bucket_ms, [], decide, forget, "admitted boolean")


def stream_ledger(events: DataFrame, user="user_id", ts="ts", order="event_id", start=150, delay="1 hour", bucket_ms: int = 60_000) -> DataFrame:
    """Debits admitted on a stream (``in_order``).  State per user: one number, the balance, which must outlive any
    silence and so is never given back."""
    def decide(balance, rows):
        out = []
        for row in rows:
            amount = row[2]
            if amount is None or amount != amount:  # null, as pandas may show it
                out.append((None, None))
                continue
            ok = amount <= 0 or balance >= amount
            balance -= int(amount) if ok else 0
            out.append((ok, balance))
        return balance, out

    return in_order(events, [user], ts, order, ["amount"], delay, bucket_ms, start, decide, lambda balance, now: (balance, None),
                    "admitted boolean, balance_after bigint")


def progress(done: DataFrame, given: DataFrame, by: list[str], at: str) -> DataFrame:
    """Per group of ``by``: rows completed, of how many, first and last time, and seconds left at the rate so far.

    Read from the sink's own table and the source, so nothing is forgotten however many micro-batches there were.
    """
    total = given.groupBy(*by).agg(F.count("*").alias("total"))
    sofar = done.groupBy(*by).agg(F.count("*").alias("completed"), F.min(at).alias("first"), F.max(at).alias("last"))
    spent = F.unix_timestamp("last") - F.unix_timestamp("first")
    return total.join(sofar, by, "left").fillna(0, ["completed"]).withColumn(
        "seconds_left", F.when(F.col("completed") > 0, F.round(spent * (F.col("total") - F.col("completed")) / F.col("completed"), 1)))
