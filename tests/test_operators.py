"""De-duplication, masking, ledger, limits, sources and streams on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import geometry as G
from sparkveil.operators import analytics as A
from sparkveil.operators import crypto as K
from sparkveil.operators import dedupe as H
from sparkveil.operators import ledger as L
from sparkveil.operators import limits as R
from sparkveil.operators import mask as M
from sparkveil.operators.context import classify_document, filter_by_context
from sparkveil.sources import files as S
from sparkveil.sources import sinks as W

HITS = "doc_id bigint, hit_no int, type string, value string, normalized string, confidence double"


def hits(spark, *rows):
    return spark.createDataFrame([(1, i, t, v, v, c) for i, (t, v, c) in enumerate(rows)], HITS)


def test_substrings_like_a_loop(spark):
    rng = random.Random(3)
    rows = [("A", "".join(rng.choice("12") for _ in range(rng.randint(1, 6))), rng.choice([0.5, 0.9])) for _ in range(120)]
    got = [(r.hit_no) for r in H.drop_substrings(hits(spark, *rows)).collect()]
    ranked = sorted(enumerate(rows), key=lambda x: (x[1][2], len(x[1][1])), reverse=True)
    kept = []
    for i, (_, v, _c) in ranked:
        if not any(v in k and v != k for _, k in kept):
            kept.append((i, v))
    assert sorted(got) == sorted(i for i, _ in kept)
    assert [r.value for r in H.drop_substrings(hits(spark, ("A", "12345", .9), ("A", "1234", .9), ("A", "234", .9))).collect()] == ["12345"]


def test_exact_and_display(spark):
    h = hits(spark, ("PHONE", "+91 98765 43210", .8), ("MOBILE", "9876543210", .9), ("PHONE", "9876543210", .9))
    rows = H.dedupe_exact(h, with_instances=True).orderBy("hit_no").collect()
    assert [(r.value, r.occurrence_count, len(r.all_instances)) for r in rows] == [("+91 98765 43210", 1, 1), ("9876543210", 2, 2)]
    rows = H.dedupe_display(h).orderBy("hit_no").collect()
    assert [(r.type, r.occurrence_count, r.is_deduplicated) for r in rows] == [("PHONE", 2, True), ("MOBILE", 1, False)]
    again = H.dedupe_exact(H.dedupe_exact(h).drop("occurrence_count"))
    assert again.count() == 2


def test_classes_and_their_hits(spark):
    docs = spark.createDataFrame([(1, "the company"), (2, "plain"), (3, "hospital doctor and policy")], "doc_id bigint, text string")
    got = {r.doc_id: r.c for r in docs.select("doc_id", classify_document(F.col("text")).alias("c")).collect()}
    assert got == {1: "PAN", 2: "GENERIC", 3: "MEDICAL_RECORD"}
    h = spark.createDataFrame([
        (1, 0, "PHONE", "9", "9", .5), (1, 1, "PAN", "A", "A", .9), (1, 2, "DOB", "1", "1", .7), (1, 3, "MOBILE", "8", "8", .6),
        (1, 4, "EMAIL", "x", "x", .9), (2, 0, "EMAIL", "x", "x", .9)], HITS)
    rows = filter_by_context(h, docs).orderBy("doc_id", "place", "hit_no").collect()
    assert [(r.doc_id, r.type, r.value) for r in rows] == [
        (1, "pan", "A"), (1, "dob", "1"), (1, "phone", "8"), (2, "EMAIL", "x")]


def test_masking_longest_first(spark):
    docs = spark.createDataFrame([(1, "b12 ab12c a.b@x.io A.B@X.IO")], "doc_id bigint, text string")
    h = hits(spark, ("X", "b12", .9), ("X", "ab12c", .9), ("EMAIL", "a.b@x.io", .9))
    out = M.mask_text(docs, h).first().text
    assert out == "███ █████ ████████ ████████"
    tricky = spark.createDataFrame([(1, r"a\E.b@x.io z")], "doc_id bigint, text string")
    assert M.mask_text(tricky, hits(spark, ("EMAIL", r"a\E.b@x.io", .9))).first().text == "█" * 10 + " z"


def test_sealing_round_trip_and_wrong_password(spark):
    docs = spark.createDataFrame([("B1", 1, "call 9876543210 now"), ("B2", 2, "nothing")], "batch_id string, doc_id bigint, text string")
    masked, side = K.hash_mask_text(docs, hits(spark, ("PHONE", "9876543210", .9)), "pw")
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert "9876543210" not in texts[1] and texts[2] == "nothing"
    assert [r.text for r in K.unmask_text(masked, side, "pw").collect()] == ["call 9876543210 now"]
    assert K.unmask_text(masked, side, "other").count() == 0
    # tokens are fresh on every run, and equal within one
    other, _ = K.hash_mask_text(docs, hits(spark, ("PHONE", "9876543210", .9)), "pw")
    assert {r.text for r in other.filter("doc_id = 1").collect()} != {texts[1]}
    assert masked.filter("doc_id = 1").first().text == texts[1]
    plan = masked._jdf.queryExecution().toString()
    assert "pw" not in plan.split() and K.derive_key("pw", b"s").hex() not in plan


def test_locked_export_layouts(spark):
    p = spark.createDataFrame([("B1", "T-0", '{"a":1}')], "batch_id string, part string, payload string")
    locked = K.lock_export(p, "pw")
    assert K.unlock_export(locked, "pw").first().payload == '{"a":1}'
    bad = K.unlock_export(locked, "no").first()
    assert bad.payload is None and bad.error == "wrong password or damaged data"
    nested = locked.select("batch_id", F.struct("salt", "iv", "ciphertext", "kdf").alias("data"))
    assert K.unlock_export(nested, "pw").first().payload == '{"a":1}'
    assert K.unlock_export(locked.drop("iv"), "pw").first().error == "missing fields"


def brute_debits(rows, start):
    balance, out = start, {}
    for ts, eid, amount in sorted(rows):
        ok = amount <= 0 or balance >= amount
        balance -= amount if ok else 0
        out[eid] = (ok, balance)
    return out


@pytest.mark.parametrize("slice_rows", [10_000, 40])
def test_debits_like_a_loop_whole_and_sliced(spark, slice_rows):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 400), "hot" if rng.random() < .7 else f"u{i % 9}", rng.choice([2, 5, 50, -60, 0])) for i in range(900)]
    e = spark.createDataFrame(rows, "event_id bigint, s bigint, user_id string, amount bigint").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "amount", F.lit(False).alias("unlimited"),
        F.lit(150).cast("bigint").alias("start_balance"))
    got = {r.event_id: (r.admitted, r.balance_after) for r in L.admit_debits(e, ranges=9 if slice_rows < 1000 else 1).collect()}
    want = {}
    for u in {r[2] for r in rows}:
        want |= brute_debits([(s, i, a) for i, s, w, a in rows if w == u], 150)
    assert got == want


@pytest.mark.parametrize("slice_rows", [10_000, 25])
def test_rate_limits_like_a_loop_whole_and_sliced(spark, slice_rows):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 900), "hot" if rng.random() < .6 else f"c{i % 5}") for i in range(500)]
    e = spark.createDataFrame(rows, "event_id bigint, s bigint, client string").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), F.lit("e").alias("endpoint"), "client")
    exact = {r.event_id: r.admitted for r in R.rate_limit(e, 4, 60, slice_rows=slice_rows).collect()}
    count = {r.event_id: r.admitted for r in R.rate_limit_counter(e, 4, 60, slice_rows=slice_rows).collect()}
    screen = {r.event_id: r.recent for r in R.rate_screen(e, 4, 60).collect()}
    live, opened = {}, {}
    for s, i, c in sorted((s, i, c) for i, s, c in rows):
        live[c] = [t for t in live.get(c, []) if s - t < 60]
        assert exact[i] == (len(live[c]) < 4)
        if len(live[c]) < 4:
            live[c].append(s)
        start, n = opened.get(c, (s, 0))
        start, n = (s, 1) if n == 0 or s - start >= 60 else (start, n + 1)
        opened[c] = (start, n)
        assert count[i] == (n <= 4)
        assert screen[i] == sum(1 for _, s2, c2 in rows if c2 == c and s - 60 < s2 <= s)


@pytest.mark.parametrize("slice_rows", [10_000, 40])
def test_rows_without_key_or_time_are_replayed_whole_and_sliced(spark, slice_rows):
    rng = random.Random(6)
    rows = [(i, None if i % 11 == 0 else rng.randint(0, 400), rng.choice(["hot", "hot", None, "a"]), rng.choice([2, 5, 50, -60])) for i in range(600)]
    e = spark.createDataFrame(rows, "event_id bigint, s bigint, user_id string, amount bigint").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "amount", F.lit(False).alias("unlimited"),
        F.lit(150).cast("bigint").alias("start_balance"))
    admitted = L.admit_debits(e, ranges=1 if slice_rows > 40 else 9)
    got = {r.event_id: (r.admitted, r.balance_after) for r in admitted.collect()}
    want = {}
    for u in {r[2] for r in rows}:
        want |= brute_debits([(-1 if s is None else s, i, a) for i, s, w, a in rows if w == u], 150)
    assert got == want and admitted.count() == len(rows)
    used = {r.user_id: (r.tokens_used, r.refused) for r in L.usage_after(admitted).collect()}
    assert used == {u: (sum(a for i, _, w, a in rows if w == u and a > 0 and want[i][0]), sum(w == u and not want[i][0] for i, _, w, _ in rows))
                    for u in {r[2] for r in rows}}
    asked = e.select("event_id", "ts", F.col("user_id").alias("client"), F.when(F.col("event_id") % 7 > 0, "e").alias("endpoint"))
    for limit in (R.rate_limit, R.rate_limit_counter):
        whole = {r.event_id: r.admitted for r in limit(asked, 4, 60).collect()}
        assert len(whole) == len(rows)
        assert {r.event_id: r.admitted for r in limit(asked, 4, 60, slice_rows=slice_rows).collect()} == whole


def test_small_limits(spark):
    e = spark.createDataFrame([(i, i, "a", 1) for i in range(5)], "event_id bigint, s bigint, endpoint string, client int").withColumn(
        "ts", F.timestamp_seconds("s"))
    assert R.rate_limit(e, 5, 60).filter("admitted").count() == 5
    assert [r.admitted for r in R.rate_limit(e.filter("s < 3"), 2, 60).orderBy("event_id").collect()] == [True, True, False]


def test_boxes(spark):
    rows = [(1, 0, 0, 0, 10, 10), (1, 1, 2, 2, 10, 10), (1, 2, 8, 8, 10, 10), (1, 3, 30, 0, 5, 5)]
    b = spark.createDataFrame(rows, "page int, box_no int, x int, y int, w int, h int").select(
        F.lit(1).alias("doc_id"), "page", "box_no", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("bbox"))
    assert [r.box_no for r in G.drop_overlapping_boxes(b).orderBy("box_no").collect()] == [0, 2, 3]


def test_zero_hits_risk(spark):
    none = spark.createDataFrame([], "batch_id string, filename string, type string")
    b = spark.createDataFrame([("B1",)], "batch_id string")
    r = A.risk_report(none, b).first()
    assert (r.risk_score, r.risk_level) == (20, "LOW")
    w = A.weighted_risk(none, batches=b).first()
    assert (w.risk_percentage, w.risk_level) == (0.0, "LOW")


def test_payload_parts_hold_every_value(spark):
    rows = spark.range(500).select(F.lit("B").alias("batch_id"), F.lit("PAN").alias("type"), F.col("id").cast("string").alias("value"),
                                   F.lit(0).alias("file_ord"), F.col("id").alias("hit_no"))
    out = A.export_payload(rows, part_values=100)
    values = out.select(F.explode(F.from_json("payload", "type string, values array<string>")["values"]).alias("v"))
    assert out.count() > 1 and values.distinct().count() == 500 == values.count()


def test_more_values_than_ten_thousand_keep_one_layout(spark):
    n = 10_001
    rows = spark.range(n).select(F.lit("B").alias("batch_id"), F.lit("PAN").alias("type"), F.concat(F.lit("v"), F.col("id")).alias("value"),
                                 F.lit(0).alias("file_ord"), F.col("id").alias("hit_no"))
    out = A.export_payload(rows)
    opened = K.unlock_export(K.lock_export(out, "pw"), "pw").collect()
    for got in (out.collect(), opened):
        assert [(r.part, json.loads(r.payload)["values"]) for r in got] == [("PAN-0", [f"v{i}" for i in range(n)])]
    table = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("pos"), F.concat(F.lit("a"), F.col("id")).alias("a"), F.lit("b").alias("b"))
    texts = S.csv_as_document(table, ["file"], "pos", ["a", "b"]).collect()
    lines, cells = "\n".join(f"a{i} b" for i in range(n)), " ".join([f"a{i}" for i in range(n)] + ["b"] * n)
    assert [r.text for r in texts] == [f"{lines}\n{cells}"]


def test_paths_files_and_text(spark, tmp_path):
    cases = {"test/file.pdf": True, "results/batch_123/file.json": True, "../etc/passwd": False, "../../etc/passwd": False,
             "/etc/passwd": False, "test;rm -rf /": False, "test|cat /etc/passwd": False, "test&rm -rf /": False, "": False, "a/../b": True,
             "a/../../b": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.ok for r in df.select("p", S.safe_path(F.col("p")).alias("ok")).collect()} == cases
    f = spark.createDataFrame([("test.pdf", 12), ("test.exe", 5), ("test.pdf", 0), ("big.pdf", 600_000_000)], "path string, length bigint")
    assert [r.admitted for r in S.admit_files(f).collect()] == [True, False, False, False]
    (tmp_path / "a.txt").write_bytes("naïve Password: x1".encode())
    (tmp_path / "b.txt").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "c.csv").write_text("call 9876543210")
    got = {r.filename: r.text for r in S.read_text_docs(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "naïve Password: x1" and got["b.txt"] == "naïve"
    n, hits_ = S.scan_directory(spark, str(tmp_path), "*.txt")
    assert n.first().files_found == 2
    assert [(r.type, r.value) for r in hits_.collect()] == [("PASSWORD", "x1")]
    _, hits_ = S.scan_directory(spark, str(tmp_path), "*.csv")
    assert "PHONE" in {r.type for r in hits_.collect()}


def test_long_tables_become_several_texts(spark):
    t = spark.range(25).select(F.lit("f").alias("file"), F.col("id").alias("pos"), F.col("id").cast("string").alias("a"),
                               F.when(F.col("id") % 2 == 0, "x").alias("b"))
    rows = S.csv_as_document(t, ["file"], "pos", ["a", "b"], block_rows=10).orderBy("block").collect()
    assert len(rows) == 3
    assert rows[2].text == "20 x\n21\n22 x\n23\n24 x\n20 21 22 23 24 x nan x nan x"


def test_sanitize(spark):
    df = spark.createDataFrame([("test<script>alert('xss')</script>",)], "t string")
    assert df.select(M.sanitize_text(F.col("t")).alias("t")).first().t == "testscriptalert(xss)/script"


def test_sinks(spark, tmp_path):
    h = hits(spark, ("PAN", "A", .9)).withColumn("batch_id", F.lit("B1"))
    W.write_detections(h, str(tmp_path / "d"))
    W.write_detections(h, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    docs = spark.createDataFrame([("B1", 1, "text")], "batch_id string, doc_id bigint, text string")
    W.write_masked_lines(docs, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "text"
    W.write_export(spark.createDataFrame([("B1", "p", "{}")], "batch_id string, part string, payload string"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first().payload == "{}"
