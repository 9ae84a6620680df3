"""Detection against plain loops and against small inputs."""

import re

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import catalogs as cat
from sparkveil.functions import checks
from sparkveil.operators import detect as D
from sparkveil.operators.units import detect_by_element, detect_by_line, split_pages


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def found(spark, kind, *texts, **kw):
    rows = D.detect(docs(spark, *texts), kind, **kw).orderBy("doc_id", "hit_no").collect()
    return [(r.type, r.value) for r in rows]


def loop(patterns, text):
    """All matches of a catalog, found one by one."""
    out = []
    for i, p in enumerate(patterns):
        flags = re.I | re.M | re.S if p.ignore_case else 0
        for m in re.finditer(p.regex, text, flags):
            value = m.group(p.group) if p.group and m.group(p.group) else m.group(0)
            out.append((i, m.start(), m.end(), value))
    return out


@pytest.mark.parametrize("catalog", [cat.shape_catalog(), cat.label_catalog(), cat.generic_catalog()])
def test_same_matches_as_a_loop_on_every_document(spark, sf, catalog):
    extra = docs(spark, "é9876543210 x 9876543210", "😀 user@example.com 4111 1111 1111 1111\n// Password: a'b",
                 "token=abc﷐def 1234567890", "aa@gmail.com bb@okaxis ₹1,200 A₹1,200", "ſalary: 12 Password = x1")
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(
        extra.select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    got = {r.doc_id: [(m.ord, m.start, m.end, m.value) for m in r.hits]
           for r in D._find(texts, "text", catalog, "hits").select("doc_id", "hits").collect()}
    for r in texts.collect():
        clean = r.text.replace("﷐", "�")
        assert got[r.doc_id] == loop(catalog, clean), r.doc_id


def test_near_repeats_compare_with_the_last_kept(spark):
    rows = D.detect_base(docs(spark, "CUST000001     CUST000001     CUST000001")).collect()
    assert [(r.type, r.start) for r in rows if r.type == "CUSTOMER_ID"] == [("CUSTOMER_ID", 0), ("CUSTOMER_ID", 30)]


def test_near_repeats_like_a_loop(spark):
    import random
    rng = random.Random(7)
    texts = ["".join(rng.choice(["CUST000001", "CUST000002", "ORD12345678", " x ", "   "]) + " " for _ in range(700)) for _ in range(5)]
    got = D.detect(docs(spark, *texts), "context", types=["CUSTOMER_ID", "ORDER_ID"]).collect()
    for i, text in enumerate(texts):
        hits = sorted((m.start(), m.end(), m.group()) for m in re.finditer(r"\b(?:CUST\d{6}|ORD\d{8})\b", text))
        last, want = {}, []
        for s, e, v in hits:
            if v in last and (min(last[v][1], e) > max(last[v][0], s) or abs(last[v][0] - s) < 20):
                continue
            last[v] = (s, e)
            want.append((s, v))
        assert sorted((r.start, r.value) for r in got if r.doc_id == i) == want


def test_paragraph_with_several_kinds(spark):
    text = ("John Doe, PAN ABCDE1234F, Aadhaar 1234 5678 9012, john.doe@example.com, "
            "+91 9876543210, IFSC HDFC0001234")
    rows = {r.type: r for r in D.detect_base(docs(spark, text)).collect()}
    assert {"PAN", "EMAIL", "PHONE", "AADHAAR", "IFSC"} <= set(rows)
    assert "UPI" not in rows
    assert rows["AADHAAR"].confidence == 0.7
    assert rows["PHONE"].value == "9876543210" and text[rows["PHONE"].start:].startswith("91")


def test_first_rule_lets_the_stronger_type_keep_an_equal_value(spark):
    types = {t for t, _ in found(spark, "base", "mail john.doe@example.com", same_span="first")}
    assert "UPI" in types and "EMAIL" not in types


def test_ids_follow_the_patterns(spark):
    types = {t for t, _ in found(spark, "base", "Employee ID: EMP-12345 Customer ID: CUST-67890 Vehicle Number: MH12AB1234")}
    assert "VEHICLE_REG_NO" in types and not types & {"EMPLOYEE_ID", "CUSTOMER_ID"}


@pytest.mark.parametrize("text, want", [
    ("// Username: nirvi88", [("USERNAME", "nirvi88"), ("NAME", "nirvi")]),
    ("// Password: Q4dp5WTd'Q", [("PASSWORD", "Q4dp5WTd'Q")]),
    ('apiKey: "sk_live_20384156052579398"', [("API_KEY", '"sk_live_20384156052579398"')]),
    ("// Contact: samitha.reddy86@company.in", [("ADMIN_EMAIL", "samitha.reddy86@company.in"), ("CONTACT", "samitha")]),
    ("// Account: 8050909387", [("BANK_ACCOUNT", "8050909387"), ("ACCOUNT_NUMBER_FIELD", "8050909387")]),
    ("// IFSC: ICIC0100", [("IFSC", "ICIC0100")]),
    ('merchantId: "TXN858472"', [("MERCHANT_ID", '"TXN858472"'), ("MERCHANT_ID", "TXN858472")]),
])
def test_labels(spark, text, want):
    assert sorted(found(spark, "label", text)) == sorted(want)


def test_card_alternation_and_mail_or_upi(spark):
    assert ("CARD_NUMBER", "4111111111111111") in found(spark, "context", "41111111111111112222")
    assert ("CARD_NUMBER", "12345678901234567") in found(spark, "context", "x12345678901234567")
    types = {t for t, _ in found(spark, "base", "joe.b@gmail.com")}
    assert "EMAIL" in types and "UPI" not in types
    rows = {r.type: r.confidence for r in D.detect_base(docs(spark, "ravi@okaxis")).collect()}
    assert rows["UPI"] == 0.85 and "EMAIL" not in rows


def test_offsets_count_code_points(spark):
    rows = D.detect_base(docs(spark, "é9876543210 x 9876543210"), types=["PHONE"]).collect()
    assert [r.start for r in rows] == [14]
    rows = D.detect_base(docs(spark, "😀 CUST123456"), types=["CUSTOMER_ID"]).collect()
    assert [r.start for r in rows] == [2]


@pytest.mark.parametrize("kind", ["base", "context", "label", "generic"])
def test_short_texts_have_no_hits(spark, kind):
    frame = spark.createDataFrame([(1, ""), (2, " "), (3, "7"), (4, None)], "doc_id bigint, text string")
    assert D.detect(frame, kind).count() == 0


def test_checksums(spark):
    df = spark.createDataFrame([(x,) for x in (
        "234123412346", "123456789012", "4111111111111111", "490154203237518", "123456789012345", "4111111111111")], "v string")
    rows = {r.v: (r.a, r.l) for r in df.select("v", checks.verhoeff_ok(F.col("v")).alias("a"), checks.luhn_ok(F.col("v")).alias("l")).collect()}
    assert rows["234123412346"][0] and not rows["123456789012"][0]
    assert rows["4111111111111111"][1] and rows["490154203237518"][1]
    assert not rows["123456789012345"][1] and not rows["4111111111111"][1]
    pans = {"ABCDE1234F": True, "XYZAB5678C": True, "ABCD1234F": False, "ABCDE12345F": False, "12345ABCDE": False, "ABCDE1234": False}
    df = spark.createDataFrame([(k,) for k in pans], "v string")
    assert {r.v: r.ok for r in df.select("v", checks.valid_pan(F.col("v")).alias("ok")).collect()} == pans


def test_context_raises_confidence(spark):
    near, far = D.detect_context(docs(spark, "customer phone 9876543210", "x" * 150 + " 9876543210"), types=["PHONE"]).orderBy("doc_id").collect()
    assert (near.confidence, near.context) == (0.9, True)
    assert (far.confidence, far.context) == (0.8, False)


def test_units(spark):
    rows = detect_by_line(docs(spark, "nothing\n\nuser: ann" + "x" * 120)).collect()
    assert [(r.line_number, r.content[-3:]) for r in rows] == [(3, "...")]
    pages = split_pages(docs(spark, "[Page 1]\nfirst\n\n[Page 2]\nsecond\n--- Page 3 ---\nthird")).collect()
    assert [(p.page, p.text) for p in pages] == [(1, "first"), (2, "second"), (3, "third")]
    el = spark.createDataFrame([(1, "paragraph", 0, 1, "a@b.com"), (1, "table_row", 1, 1, "none | x"), (1, "header", 0, 1, "c@d.com")],
                               "doc_id bigint, kind string, table_no int, element_no int, text string")
    assert [(r.kind, r.pii_count) for r in detect_by_element(el).collect()] == [("paragraph", 1)]


def test_detection_needs_no_shuffle_and_reads_two_columns(spark, sf):
    df = D.detect_base(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("posexplode") == 1 and "EvalPython" not in plan


def test_values_that_come_again_are_dropped_as_before(spark):
    """Near and overlapping repeats go, far ones stay, in short and in long lists of hits; a hit without a type is no repeat."""
    rows = []
    for doc, far in ((1, 0), (2, 30)):  # few hits, and more than one block of the fold
        rows += [(doc, "PAN", "Ab", 0.9, 0, 2), (doc, "PAN", "aB", 0.8, 10, 12), (doc, "PAN", "ab", 0.95, 40, 42), (doc, None, "ab", 0.5, 500, 502)]
        rows += [(doc, f"T{i}", f"v{i}", 0.5, 100 + i, 101 + i) for i in range(far)]
    hits = spark.createDataFrame(rows, "doc int, type string, normalized string, confidence double, start int, end int")
    full = F.struct("type", F.lit("c").alias("category"), F.lit("l").alias("label"), F.col("normalized").alias("value"), "normalized",
                    "confidence", "start", "end", F.lit(False).alias("context"), F.lit("s").alias("source"), F.lit(1).alias("ord"))
    kept = hits.groupBy("doc").agg(F.collect_list(full).alias("hits")).select("doc", D.dedupe_nearby(F.col("hits")).alias("hits"))
    got = {r["doc"]: [(h["type"], h["start"]) for h in r["hits"]] for r in kept.collect()}
    assert got[1] == [("PAN", 0), ("PAN", 40), (None, 500)]
    assert got[2][:2] == got[1][:2] and got[2][-1] == got[1][-1] and len(got[2]) == 33


def test_folds_over_hits_carry_marks_and_not_the_hits(spark):
    """A hit that rides along in a fold is copied at every step of it."""
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")
    for same_span in ("confidence", "first"):
        plan = D.add_base_hits(df, same_span=same_span)._jdf.queryExecution().analyzed().toString()
        assert "keep:boolean,hit:" not in plan and "challenges:boolean,hit:" not in plan


def test_context_words_and_blanks_in_texts_of_any_characters(spark):
    df = spark.createDataFrame([(1, "PAN no ABCDE1234F"), (2, "pan no ABCDE1234F"), (3, "pań no ABCDE1234F é"),
                                (4, "é Permanent Account ABCDE1234F")], "doc_id long, text string")
    got = {r["doc_id"]: r["context"] for r in D.detect_context(df, types=["PAN"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}
    blanks = spark.createDataFrame([(" \x1c\tx y\n\x1f",), (" x y\u0085\n",), ("\n",), (None,)], "v string")
    assert [r[0] for r in blanks.select(checks.strip(F.col("v"))).collect()] == ["x y", "x y", "", None]
