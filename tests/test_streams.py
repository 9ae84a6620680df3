import random

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import ledger as L
from sparkveil.operators import limits as R
from sparkveil.streaming import streams as T

START = 1_700_000_000


def arriving(spark, path, rows, shape, parts, jitter, rng):
    """Files out of order by up to ``jitter`` seconds, then one event of the far future."""
    placed = sorted(rows, key=lambda r: r[1] + rng.randint(0, jitter))
    size = len(placed) // parts + 1
    chunks = [placed[i:i + size] for i in range(0, len(placed), size)]
    for chunk in [*chunks, [(None, START + 10**8, *[None] * (len(rows[0]) - 2))]]:
        rng.shuffle(chunk)
        spark.createDataFrame(chunk, shape).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    return T.stream_parquet(spark, path, "*.parquet", files_per_trigger=1)


def run(spark, frame, path):
    query = T.run_available(frame, path)
    return query, spark.read.schema(frame.schema).parquet(f"{path}/data")


@pytest.mark.parametrize("most", [2, 0])
def test_limiter_on_late_files_like_batch(spark, tmp_path, most):
    rng = random.Random(9)
    rows = [(i, START + rng.randint(0, 4000), "e", rng.choice([0, 0, 0, 1, None])) for i in range(500)]
    shape = "event_id bigint, s bigint, endpoint string, client int"
    events = arriving(spark, str(tmp_path / "in"), rows, shape, 3, 300, rng)
    query, got = run(spark, T.stream_rate_limit(events, most, 60, delay="10 minutes", bucket_ms=90_000), str(tmp_path / "out"))
    e = spark.createDataFrame(rows, shape).withColumn("ts", F.timestamp_seconds("s"))
    want = {r.event_id: r.admitted for r in R.rate_limit(e, most, 60).collect()} if most else {r[0]: False for r in rows}
    assert {r.event_id: r.admitted for r in got.collect()} == want
    assert {(r.event_id, r.ts) for r in got.collect()} == {(r.event_id, r.ts) for r in e.collect()}
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left < 20  # the far event waits; nothing else is kept


def test_ledger_on_late_files_like_batch(spark, tmp_path):
    rng = random.Random(10)
    rows = [(i, START + rng.randint(0, 4000), rng.choice(["hot", "hot", "b"]), rng.choice([2, 5, 50, -60, 0])) for i in range(400)]
    shape = "event_id bigint, s bigint, user_id string, amount bigint"
    events = arriving(spark, str(tmp_path / "in"), rows, shape, 3, 300, rng)
    _, got = run(spark, T.stream_ledger(events, delay="10 minutes", bucket_ms=120_000), str(tmp_path / "out"))
    e = spark.createDataFrame(rows, shape).withColumns({
        "ts": F.timestamp_seconds("s"), "unlimited": F.lit(False), "start_balance": F.lit(150).cast("bigint")})
    want = {r.event_id: (r.admitted, r.balance_after) for r in L.admit_debits(e).collect()}
    assert {r.event_id: (r.admitted, r.balance_after) for r in got.collect()} == want


def test_a_key_costs_few_timers_and_may_file_its_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FEW_WAITING", 60)
    rng = random.Random(12)
    rows = [(i, START + rng.randint(0, 6000), rng.choice(["hot", "hot", "hot", "b"]), rng.choice([2, 5, 50, -60, None])) for i in range(400)]
    shape = "event_id bigint, s bigint, user_id string, amount bigint"
    events = arriving(spark, str(tmp_path / "in"), rows, shape, 3, 300, rng)
    query, got = run(spark, T.stream_ledger(events, delay="10 minutes", bucket_ms=60_000), str(tmp_path / "out"))
    e = spark.createDataFrame(rows, shape).withColumns({
        "ts": F.timestamp_seconds("s"), "unlimited": F.lit(False), "start_balance": F.lit(150).cast("bigint")})
    want = {r.event_id: (r.admitted, r.balance_after) for r in L.admit_debits(e).collect()}
    found = {r.event_id: (r.admitted, r.balance_after) for r in got.collect()}
    assert {k: v for k, v in found.items() if v[0] is not None} == {k: v for k, v in want.items() if v[0] is not None}
    assert set(found) == set(want)
    # about a hundred buckets for each of two keys, but only a few timers in each of the micro-batches
    timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < sum(timers) < 40


def test_batch_totals_with_expiry_and_compaction(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, START + i * 100 + rng.randint(0, 50), f"B{rng.randint(0, 3)}", rng.choice([{"PAN": 2, "EMAIL": 1}, {"PAN": 1}, {}, None]), rng.randint(1, 9), rng.random() > .2) for i in range(600)]
    shape = "id bigint, s bigint, batch_id string, breakdown map<string,bigint>, page_count int, success boolean"
    events = arriving(spark, str(tmp_path / "in"), rows, shape, 9, 300, rng).filter("batch_id IS NOT NULL")
    events = events.withColumns({"processed_at": F.col("ts"), "processing_time": F.lit(0.5)})
    sizes = []
    keep = T.upsert(str(tmp_path / "data"), every=4)

    def write(batch, number):
        keep(batch, number)
        keep(batch, number)  # a replayed micro-batch changes nothing

    stats = T.stream_batch_stats(events, delay="10 minutes", span="20 minutes")
    query = stats.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(write).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    stretches = T.latest(spark, str(tmp_path / "data"), every=4)
    assert max(sizes) < stretches.count() / 2  # state holds the open stretches, not all there ever were
    got = {r.batch_id: r for r in T.batch_totals(stretches).collect()}
    for b in {r[2] for r in rows}:
        good = [r for r in rows if r[2] == b and r[5]]
        want = {}
        for r in good:
            for k, n in (r[3] or {}).items():
                want[k] = want.get(k, 0) + n
        r = got[b]
        assert (r.files, r.breakdown, r.piis, r.pii_types) == (len(good), want, sum(want.values()), len(want))
        assert (r.pages_processed, r.scan_duration) == (sum(x[4] for x in good), len(good) / 2)


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"mail a{i}@b.com") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows[:5], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/other")
    for glob, n in (("documents.parquet", 40), ("part-*.parquet", 5)):
        df = T.stream_parquet(spark, str(tmp_path) if glob.startswith("doc") else f"{tmp_path}/other", glob)
        out = f"{tmp_path}/out-{n}"
        T.run_available(T.stream_detect(df), out)
        assert spark.read.parquet(f"{out}/data").filter("type = 'EMAIL'").count() == n


def test_newest_rows_are_hashed_and_not_sorted(spark, tmp_path):
    keep = T.upsert(str(tmp_path / "d"))
    shape = "stretch struct<start:timestamp,end:timestamp>, batch_id string, type string, files bigint, n bigint, pages_processed bigint, scan_duration double, processed_at timestamp"
    row = lambda kind, n, pages: ((None, None), "B1", kind, 0, n, pages, 0.5, None)
    for number, rows in enumerate([[row(None, 1, 1), row("PAN", 2, 9)], [row(None, 3, None)]]):
        keep(spark.createDataFrame(rows, shape), number)
    newest = T.latest(spark, str(tmp_path / "d"))
    assert sorted((r.type or "", r.n, r.pages_processed) for r in newest.collect()) == [("", 3, None), ("PAN", 2, 9)]
    assert "SortAggregate" not in newest._jdf.queryExecution().executedPlan().toString()
