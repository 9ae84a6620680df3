import random

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import ledger as L
from sparkveil.operators.admission import admit


def loop(amounts, balance):
    out = []
    for a in amounts:
        ok = a <= 0 or balance >= a
        balance -= a if ok else 0
        out.append((ok, balance))
    return out


@pytest.mark.parametrize("kind", ["prices", "cents", "rich"])
@pytest.mark.parametrize("stretch", [7, 300])
def test_one_busy_account_like_a_loop(spark, kind, stretch):
    rng = random.Random(8)
    pick = {"prices": lambda: rng.choice([2, 5, 5, 50, 100, -100]), "cents": lambda: rng.choice([-5000, 1, 1]) * rng.randint(1, 99_999),
            "rich": lambda: rng.randint(1, 9)}[kind]
    rows = [(i, rng.choice(["hot"] * 8 + ["b", None]), i // 50, pick()) for i in range(3000)]
    start = {"rich": 5000}.get(kind, 150)
    e = spark.createDataFrame(rows, "event_id bigint, who string, at int, amount bigint").withColumn("start", F.lit(start))
    out = admit(e, ["who", "start"], ["at", "event_id"], "start", F.lit(False), ranges=13, stretch=stretch)
    got = {r.event_id: (r.admitted, r.balance_after) for r in out.collect()}
    for who in ("hot", "b", None):
        ids = [i for i, w, _, _ in rows if w == who]
        assert [got[i] for i in ids] == loop([rows[i][3] for i in ids], start)
    assert out.columns == [*e.columns, "admitted", "balance_after"]


def test_a_million_events_of_one_user_take_no_job_for_each_slice(spark):
    n = 1_000_000
    e = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") / 7).alias("ts"), F.lit("one").alias("user_id"),
        F.when(F.col("id") % 11 == 0, -40).otherwise(2 + F.pmod(F.hash("id"), F.lit(9))).cast("bigint").alias("amount"),
        F.lit(False).alias("unlimited"), F.lit(150).cast("bigint").alias("start_balance"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("admit", "")
    jobs = {}
    for ranges in (8, 64):
        before = len(tracker.getJobIdsForGroup("admit"))
        out = L.admit_debits(e, ranges=ranges)
        total = out.agg(F.count("*").alias("n"), F.sum(F.col("admitted").cast("int")).alias("ok"), F.max_by("balance_after", "event_id").alias("last")).first()
        jobs[ranges] = len(tracker.getJobIdsForGroup("admit")) - before
        amounts = [r.amount for r in e.select("amount").collect()] if ranges == 8 else amounts
        want = loop(amounts, 150)
        assert (total.n, total.ok, total["last"]) == (n, sum(ok for ok, _ in want), want[-1][1])
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert jobs[64] <= jobs[8] + 2


def test_no_events_and_rows_without_amount(spark):
    shape = "event_id bigint, ts timestamp, user_id string, amount bigint, unlimited boolean, start_balance bigint"
    assert L.admit_debits(spark.createDataFrame([], shape)).count() == 0
    e = spark.createDataFrame([(1, None, "a", None, False, 9), (2, None, "a", 9, False, 9), (3, None, "a", 9, True, 9), (4, None, "c", 1, None, None)], shape)
    got = {r.event_id: (r.admitted, r.balance_after) for r in L.admit_debits(e).collect()}
    assert got == {1: (None, None), 2: (True, 0), 3: (True, None), 4: (False, 0)}
