"""Masking, sealing and opening texts that hold many values."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkveil.operators import crypto as K
from sparkveil.operators import mask as M

HITS = "doc_id bigint, type string, value string, normalized string"


def masked_by_loop(text, values):
    import re
    for v, loose in sorted(values, key=lambda x: (-len(x[0]), x[0], x[1])):
        text = re.sub(re.escape(v), "█" * len(v), text, flags=re.I) if loose else text.replace(v, "█" * len(v))
    return text


def frames(spark, rows):
    """rows: (doc_id, text, [(type, value)])"""
    docs = spark.createDataFrame([(i, "B", t) for i, t, _ in rows], "doc_id bigint, batch_id string, text string")
    hits = spark.createDataFrame([(i, t, v, v) for i, _, vs in rows for t, v in vs], HITS)
    return docs, hits


@pytest.fixture(params=[0, 10_000], ids=["in one pass", "one by one"])
def few(request, monkeypatch):
    monkeypatch.setattr(M, "FEW", request.param)
    monkeypatch.setattr(K, "FEW", request.param)


def test_overlaps_ties_and_cases_like_a_loop(spark, few):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcAB é") for _ in range(120))
        cut = lambda: text[(s := rng.randrange(110)):s + rng.randint(3, 9)].strip()
        rows.append((i, text, [(rng.choice(["NAME", "USERNAME"]), v) for v in (cut() for _ in range(9)) if len(v) >= 3]))
    rows += [(100, "nothing here", []), (101, None, [("NAME", "abc")]), (102, "", [("NAME", "abc")])]
    docs, hits = frames(spark, rows)
    got = {r.doc_id: r.text for r in M.mask_text(docs, hits).collect()}
    for i, text, values in rows:
        want = text and masked_by_loop(text, {(v.lower() if t == "USERNAME" else v, t == "USERNAME") for t, v in values})
        assert got[i] == want
    masked, side = K.hash_mask_text(docs, hits, "pw")
    shown = {r.doc_id: r.text for r in masked.collect()}
    for i, text, values in rows:
        assert text is None or not any(v in shown[i].replace("⟦", "\0⟦") for _, v in values if len(v) >= 9 and " " in v)
    opened = {r.doc_id: r for r in K.unmask_text(masked, side, "pw", keep_all=True).collect()}
    assert all(opened[i].text == text and opened[i].failed == 0 for i, text, _ in rows)
    assert {r.pii_type for r in side.select("pii_type").distinct().collect()} == {"NAME", "USERNAME"}


def test_a_value_in_another_case_does_not_leak(spark, few):
    docs, hits = frames(spark, [(1, "a.B@x.io and A.b@X.io and A.B@X.IO", [("EMAIL", "a.B@x.io")])])
    assert M.mask_text(docs, hits).first().text == "████████ and ████████ and ████████"
    masked, side = K.hash_mask_text(docs, hits, "pw")
    assert "@" not in masked.first().text and K.unmask_text(masked, side, "pw").first().text == docs.first().text


def test_ten_thousand_values_in_a_text_of_a_megabyte(spark):
    rng = random.Random(7)
    values = [f"9{rng.randrange(10**9):09d}" for _ in range(10_000)]
    texts = {n: " ".join(f"call {values[k % n]} or write to nobody in particular about the matter, then wait for the answer to come" for k in range(n)) for n in (2_500, 10_000)}
    spent = {}
    for n, text in texts.items():
        docs, hits = frames(spark, [(1, text, [("PHONE", v) for v in values[:n]])])
        docs, hits = docs.cache(), hits.cache()
        docs.count(), hits.count()
        start = time.time()
        masked = M.mask_text(docs, hits).first().text
        assert masked == text.translate(str.maketrans("0123456789", "█" * 10))
        sealed, side = K.hash_mask_text(docs, hits, "pw")
        assert not any(c in sealed.first().text.split(" or ")[0] for c in values[:1]) and side.count() == len(set(values[:n]))
        opened = K.unmask_text(sealed, side, "pw").first()
        assert opened.text == text and opened.decrypted == len(set(values[:n]))
        spent[n] = time.time() - start
    assert len(texts[10_000]) > 950_000 and spent[10_000] < 8 * spent[2_500] and spent[10_000] < 120


def test_elements_are_masked_together_and_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(M, "TOGETHER", 3)
    rows = [(1, 0, "ab"), (1, 1, "cd abcd"), (1, 2, None), (1, 3, ""), (1, 4, "abcd"), (1, 5, f"x{M.BETWEEN}abcd"), (2, 0, "abcd"), (1, 4, "abcd")]
    el = spark.createDataFrame(rows, "doc_id bigint, element_no int, text string").withColumn("kind", F.lit("p"))
    hits = spark.createDataFrame([(1, "NAME", "abcd", "abcd"), (1, "NAME", "abcd", "abcd")], HITS)
    got = sorted((r.doc_id, r.element_no, r.text or "-", r.kind) for r in M.mask_elements(el, hits).collect())
    want = [(1, 0, "ab"), (1, 1, "cd ████"), (1, 2, "-"), (1, 3, "-"), (1, 4, "████"), (1, 4, "████"), (1, 5, f"x{M.BETWEEN}████"), (2, 0, "abcd")]
    assert got == sorted((*w, "p") for w in want)


def test_spans_by_offset(spark, few):
    rows = [(1, "0123456789" * 5, [(3, 5), (4, 8), (20, 21), (6, 7)]), (2, "abc", []), (3, None, [(0, 1)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, hits array<struct<start:int,end:int>>")
    got = {r.doc_id: r.text for r in M.mask_spans(df).collect()}
    text = list("0123456789" * 5)
    for a, b in rows[0][2]:
        text[a:b] = "█" * (b - a)
    assert got == {1: "".join(text), 2: "abc", 3: None}


def test_workers_need_not_have_the_package(tmp_path):
    import os
    import subprocess
    import sys

    code = """
import sys
sys.path.insert(0, sys.argv[1])
from compare import session
from sparkveil.functions import geometry as G
from sparkveil.operators import admission, crypto as K, dedupe as H, mask as M
from pyspark.sql import functions as F
spark = session(2)
M.FEW = K.FEW = H.FEW = G.FEW = 0
docs = spark.createDataFrame([(1, 'B', 'call 9876543210 now')], 'doc_id bigint, batch_id string, text string')
hits = spark.createDataFrame([(1, 0, 'PHONE', '9876543210', '9876543210', .9), (1, 1, 'PHONE', '98765', '98765', .5)], 'doc_id bigint, hit_no int, type string, value string, normalized string, confidence double')
sealed, side = K.hash_mask_text(docs, hits, 'pw')
assert K.unmask_text(sealed, side, 'pw').first().text == docs.first().text
assert H.drop_substrings(hits).count() == 1 and '987' not in M.mask_text(docs, hits).first().text
assert G.drop_overlapping_boxes(hits.select('doc_id', F.lit(1).alias('page'), F.col('hit_no').alias('box_no'), G.box(*[F.lit(5)] * 4).alias('bbox'))).count() == 1
e = spark.range(99).select('id', F.lit('u').alias('k'), F.lit(2).alias('amount'), F.lit(100).alias('start'))
assert admission.admit(e, ['k', 'start'], ['id'], 'start', F.lit(False), ranges=4).filter('admitted').count() == 50
print('done')
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-3000:]


def test_few_values_reach_the_arrow_functions_as_empty_lists(spark, monkeypatch):
    """A run of null lists costs the square of its length in an Arrow batch."""
    from sparkveil.functions import geometry as G
    from sparkveil.operators import dedupe as H

    def strict(kind):
        def maker(*_):
            @F.pandas_udf(kind)
            def run(*cols: pd.Series) -> pd.Series:
                lists = cols if kind.startswith("array") else cols[1:]
                if any(x is None for c in lists for x in c):
                    raise ValueError("a null list")
                return pd.Series([None] * len(cols[0]), dtype=object)
            return run
        return maker

    for module, name, kind in [(G, "_kept_boxes", "array<boolean>"), (H, "_holders", "array<int>"), (M, "mask_many", "string"),
                               (M, "blank_many", "string"), (K, "cut_many", "string"), (K, "put_many", "string")]:
        monkeypatch.setattr(module, name, strict(kind))
    boxes = spark.range(5).select(F.col("id").alias("doc_id"), F.lit(0).alias("page"), "id", G.box(*[F.col("id")] * 4).alias("bbox"))
    assert G.drop_overlapping_boxes(boxes, order="id").count() == 5
    docs, hits = frames(spark, [(1, "a 9876543210 b", [("PHONE", "9876543210"), ("PHONE", "98765")]), (2, "nothing", []), (3, None, [])])
    assert {r.doc_id: r.text for r in M.mask_text(docs, hits).collect()} == {1: "a ██████████ b", 2: "nothing", 3: None}
    spans = docs.withColumn("hits", F.expr("if(doc_id = 1, array(named_struct('start', 2, 'end', 5)), null)"))
    assert {r.doc_id: r.text for r in M.mask_spans(spans).collect()} == {1: "a ███6543210 b", 2: "nothing", 3: None}
    rows = hits.withColumns({"confidence": F.lit(0.9), "hit_no": F.length("value")})
    assert [r.value for r in H.drop_substrings(rows).collect()] == ["9876543210"]
    masked, side = K.hash_mask_text(docs, hits, "p")
    assert {r.doc_id: r.text for r in K.unmask_text(masked, side, "p").collect()} == {1: "a 9876543210 b"}
