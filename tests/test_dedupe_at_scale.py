"""De-duplication, boxes and sinks on groups that hold much."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import geometry as G
from sparkveil.operators import analytics as A
from sparkveil.operators import dedupe as H
from sparkveil.operators import limits as R
from sparkveil.sources import sinks as W

HITS = "doc_id bigint, hit_no int, type string, value string, confidence double"


def kept_by_loop(rows):
    """Strongest first; a value goes if it lies strictly inside any stronger one, kept or not."""
    out = []
    for i, (t, v, c) in enumerate(rows):
        rank = (c, len(v), -i)
        if not any(t == t2 and len(v) < len(v2) and v in v2 and (c2, len(v2), -j) > rank for j, (t2, v2, c2) in enumerate(rows)):
            out.append(i)
    return out


@pytest.mark.parametrize("few", [0, 2, 10_000])
def test_contained_values_like_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(H, "FEW", few)
    rng = random.Random(13)
    docs = {d: [(rng.choice("AB"), "".join(rng.choice("12") for _ in range(rng.randint(0, 6))), rng.choice([0.5, 0.7, 0.9])) for _ in range(40)] for d in range(8)}
    df = spark.createDataFrame([(d, i, *r) for d, rows in docs.items() for i, r in enumerate(rows)], HITS)
    got = sorted((r.doc_id, r.hit_no) for r in H.drop_substrings(df).collect())
    assert got == sorted((d, i) for d, rows in docs.items() for i in kept_by_loop(rows))


def test_long_values_take_time_of_their_length(spark):
    rng = random.Random(14)
    long = ["".join(rng.choice("0123456789abcdef") for _ in range(10_000)) for _ in range(100)]
    inner = [v[s:s + 40] for v in long for s in (5, 9_000)]
    rows = [(1, i, "KEY", v, 0.9) for i, v in enumerate(long + inner)]
    df = spark.createDataFrame(rows, HITS).cache()
    df.count()
    start = time.time()
    assert {r.hit_no for r in H.drop_substrings(df).select("hit_no").collect()} == set(range(100))
    assert time.time() - start < 60


def test_first_of_group_is_hashed_and_like_a_loop(spark):
    rng = random.Random(15)
    rows = [(rng.choice([1, 2, None]), i, rng.choice(["PHONE", "phone", None]), rng.choice(["98765 43210", "9876543210", "x", None]), 0.9) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, HITS)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    out = H.dedupe_exact(df)
    assert "SortAggregate" not in plan(out) and out.columns == [*df.columns, "occurrence_count"]
    want = {}
    for d, i, t, v, _ in sorted(rows, key=lambda r: r[1]):
        k = (d, t and t.upper(), v and v.replace(" ", "").upper())
        want.setdefault(k, [i, 0])[1] += 1
    assert sorted((r.hit_no, r.occurrence_count) for r in out.collect()) == sorted(map(tuple, want.values()))
    exported = A.export_rows(df.select(F.lit("B").alias("batch_id"), "type", "value", (F.col("hit_no") % 7).alias("file_ord"), "hit_no", F.lit("f").alias("filename")))
    assert "SortAggregate" not in plan(exported)
    first = {}
    for d, i, t, v, _ in rows:
        if v:
            k = (t and t.upper(), v)
            first[k] = min(first.get(k, (9, 0)), (i % 7, i))
    assert {(r.type, r.value): (r.file_ord, r.hit_no) for r in exported.collect()} == first


def test_rows_that_share_their_place_are_one(spark):
    rows = [(1, 7, "PAN", "ABCDE1234F", .9), (1, 7, "PAN", "ABCDE1234F", .9), (1, 9, "PAN", "ABCDE 1234F", .5), (2, None, "PAN", "X", .5), (2, None, "PAN", "X", .5)]
    df = spark.createDataFrame(rows, HITS)
    for dedupe in (H.dedupe_exact, H.dedupe_display):
        got = sorted((r.doc_id, r.hit_no, r.occurrence_count) for r in dedupe(df).collect())
        assert got == [(1, 7, 3), (2, None, 2)]


@pytest.mark.parametrize("few", [0, 10_000])
def test_boxes_like_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    rng = random.Random(16)
    rows = [(p, i, rng.randint(-50, 300), rng.randint(-50, 300), rng.choice([1, 5, 20, 90, 200]), rng.choice([0, 3, 20, 150])) for p in range(5) for i in range(80)]
    df = spark.createDataFrame(rows, "page int, box_no int, x int, y int, w int, h int")
    df = df.select("page", "box_no", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("bbox"))
    got = sorted((r.page, r.box_no) for r in G.drop_overlapping_boxes(df, page=("page",)).collect())
    want = []
    for p in range(5):
        kept = []
        for _, i, x, y, w, h in (r for r in rows if r[0] == p):
            def meets(k):
                dx, dy = min(x + w, k[0] + k[2]) - max(x, k[0]), min(y + h, k[1] + k[3]) - max(y, k[1])
                return dx > 0 and dy > 0 and dx * dy > min(w * h, k[2] * k[3]) * 0.5
            if not any(map(meets, kept)):
                kept.append((x, y, w, h))
                want.append((p, i))
    assert got == sorted(want)


def test_a_page_of_many_boxes(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("box_no"), G.box(
        (F.col("id") % 316) * 30, F.floor(F.col("id") / 316) * 12, F.lit(40), F.lit(10)).alias("bbox"))
    start = time.time()
    assert G.drop_overlapping_boxes(df, page=("page",)).count() == n  # neighbours share a quarter
    assert time.time() - start < 60


def test_boxes_of_values_like_a_scan(spark):
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    blocks = [(d, i, word(rng.randint(0, 12)), i) for d in range(6) for i in range(30)] + [(7, 0, None, 0)]
    values = [(d, i, word(rng.randint(0, 7))) for d in range(8) for i in range(40)]
    b = spark.createDataFrame(blocks, "doc_id int, line_number int, text string, n int").select("doc_id", "line_number", "text", G.box(*[F.col("n")] * 4).alias("bbox"))
    h = spark.createDataFrame(values, "doc_id int, hit_no int, value string")
    got = {(r.doc_id, r.hit_no): r.bbox and r.bbox.x for r in G.attach_bbox(h, b).collect()}
    assert got == {(d, i): next((n for d2, _, t, n in blocks if d2 == d and (not v or v in (t or ""))), None) for d, i, v in values}


def test_many_values_and_blocks_of_one_document(spark):
    n = 10_000
    b = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("line_number"),
                              F.concat(F.lit("item "), F.md5(F.col("id").cast("string"))).alias("text"), G.box(*[F.col("id")] * 4).alias("bbox"))
    h = b.select("doc_id", F.col("line_number").alias("hit_no"), F.substring("text", 10, 20).alias("value"))
    out = G.attach_bbox(h, b)
    assert out.filter("bbox.x = hit_no").count() == n


def test_gaps_of_a_hot_key_without_a_window_over_it(spark):
    rng = random.Random(18)
    rows = [(i, None if rng.random() < .03 else rng.randint(0, 3000), rng.choice(["hot", "hot", "hot", "b", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "event_id bigint, s bigint, k string").withColumn("ts", F.timestamp_seconds("s"))
    cut = R.cut_at_gaps(df, ["k"], "ts", "event_id", 5, ranges=11)
    got = {r.event_id: r["__segment"] for r in cut.collect()}
    for k in ("hot", "b", None):
        line = sorted(((-1 if s is None else s), i, s) for i, s, k2 in rows if k2 == k)
        seen, before, start = {}, None, None
        for _, i, s in line:
            if s is not None and before is not None and s - before >= 5:
                start = s
            before = s if s is not None else before
            seen.setdefault(start, set()).add(got[i])
        assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_a_large_batch_is_written_by_many_tasks_and_a_repeated_run_once(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        rows = spark.range(0, 60_000, 1, 24).select(F.when(F.col("id") % 20 == 0, "small").otherwise("large").alias("batch_id"), F.sha2(F.col("id").cast("string"), 256).alias("value"))
        for _ in range(2):
            W.write_detections(rows, str(tmp_path / "d"), run="one")
        W.write_detections(rows.limit(10), str(tmp_path / "d"), run="two")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.count() == 60_010 and back.filter("run = 'one'").select("value").distinct().count() == 60_000
    assert len(list((tmp_path / "d" / "batch_id=large" / "run=one").glob("*.parquet"))) > 5
    assert len(list((tmp_path / "d" / "batch_id=small" / "run=one").glob("*.parquet"))) <= 3
