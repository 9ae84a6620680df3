import random

from pyspark.sql import functions as F

from sparkveil.operators import ordered as O
from sparkveil.operators.analytics import page_of
from sparkveil.operators.running import running_totals


def test_running_sums_like_a_loop_with_nulls_and_ties(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "hot", "hot", "hot", "b"]), rng.choice([None, 1, 1, 1, 2]), rng.choice([None, 3, -2])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, k string, at int, v int")
    got = {r.id: (r.total, r.n) for r in O.running_sums(frame, ["k"], ["at", "id"], {"total": F.col("v"), "n": F.lit(1)}, ranges=7).collect()}
    sums, want = {}, {}
    for i, k, at, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        t, n = sums.get(k, (None, 0))
        sums[k] = (t if v is None else (t or 0) + v, n + 1)
        want[i] = sums[k]
    assert got == want


def test_one_instant_of_one_key_is_spread(spark):
    frame = spark.range(100_000).selectExpr("id", "'k' AS k", "timestamp'2024-01-01 00:00:00' AS at", "1 AS v")
    rows = running_totals(frame, ["k"], "at", ["id"], {"total": F.col("v")})
    assert rows.filter("total <> id + 1").count() == 0
    sizes = [r["count"] for r in O.into_ranges(frame, ["k", "at", "id"], 8).groupBy(O.RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100_000 / 4


def test_a_deep_page_reads_the_ranges_that_hold_it(spark):
    frame = spark.range(50_000).selectExpr("id", "pmod(hash(id), 97) AS h")
    dealt = O.into_ranges(frame, ["h", "id"], 16)
    want = [tuple(r) for r in frame.orderBy("h", "id").offset(40_020 - 20).limit(20).collect()]
    page = page_of(dealt, ["h", "id"], 2001, 20)
    assert sorted(map(tuple, page.collect())) == sorted(want)
    assert sorted(map(tuple, page_of(frame, ["h", "id"], 2001, 20).collect())) == sorted(want)
    assert "PushedFilters: [IsNotNull(__range), EqualTo(__range," in page._jdf.queryExecution().toString()
    assert page_of(frame, ["h", "id"], 9999, 20).count() == 0 and page_of(frame.limit(0), ["h", "id"], 1, 20).count() == 0


def test_numbers_start_where_asked(spark):
    frame = spark.range(100).selectExpr("id", "id % 3 AS k", "'old' AS n")
    got = {(r.k, r.n) for r in O.numbered(frame, ["k"], ["id"], "n", first=1).collect()}
    assert got == {(k, n) for k in range(3) for n in range(1, 35 if k == 0 else 34)}
