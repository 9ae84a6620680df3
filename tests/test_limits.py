"""Long values, deep paths and long runs of words: nothing is cut off and nothing ends the process."""

import posixpath

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import catalogs as cat
from sparkveil.functions.match import java_regex
from sparkveil.operators import crypto as K
from sparkveil.sources import files as S


def test_sealing_gives_the_text_back(spark):
    long = "K" + "abc9" * 1250
    texts = {
        1: f"key {long} end {long}", 2: "abc and xabcx, abc9abc", 3: "mail A.b@X.io and a.B@x.io", 4: "no value here",
        5: "pin 123 in 9876543210 and 987654321", 6: "⟦AAAA⟧ left alone, abc", 7: "", 8: "a|b (c) $1 \\E x",
    }
    docs = spark.createDataFrame([(i, "B1", t) for i, t in texts.items()], "doc_id long, batch_id string, text string")
    hits = spark.createDataFrame(
        [(1, 0, "API_KEY", long, long), (2, 0, "X", "abc", "abc"), (3, 0, "EMAIL", "a.B@x.io", "a.b@x.io"), (5, 0, "X", "123", "123"),
         (5, 1, "PHONE", "9876543210", "9876543210"), (5, 2, "X", "9876", "9876"), (6, 0, "X", "abc", "abc"), (8, 0, "X", "$1 \\E x", None), (8, 1, "X", "(c)", "(c)")],
        "doc_id long, hit_no int, type string, value string, normalized string")
    masked, side = K.hash_mask_text(docs, hits, "pw")
    rows = {r.doc_id: r.text for r in masked.collect()}
    assert rows[4] == texts[4] and rows[7] == ""
    for i, value in ((1, long), (2, "abc"), (3, "@"), (5, "123"), (8, "(c)")):
        outside = "".join(p.split(K.RIGHT)[-1] for p in rows[i].split(K.LEFT))
        assert value not in outside
    opened = {r.doc_id: r for r in K.unmask_text(masked, side, "pw", keep_all=True).collect()}
    assert {i: r.text for i, r in opened.items()} == texts
    assert (opened[1].decrypted, opened[3].decrypted, opened[6].decrypted, opened[6].failed) == (1, 2, 1, 1)
    wrong = {r.doc_id: r for r in K.unmask_text(masked, side, "other", keep_all=True).collect()}
    assert all(wrong[i].text == rows[i] and not wrong[i].decrypted for i in texts)


def test_paths_of_any_depth(spark):
    paths = ["/".join(["a"] * n + [".."] * m + ["b"]) for n, m in ((8, 8), (9, 9), (50, 50), (50, 51), (3, 1), (0, 1))]
    paths += ["a//../b", "a/./b", "./a", "a/..", "x/../../y", "a/b/../../..", "//a", "a//b"]
    got = {r.p: r.ok for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.safe_path(F.col("p")).alias("ok")).collect()}
    assert got == {p: not p.startswith("/") and ".." not in posixpath.normpath(p).split("/") for p in paths}


def test_long_runs_of_words(spark):
    name = next(p for p in cat.generic_catalog() if p.type == "Name")
    assert java_regex(name).endswith(")*+)")
    text = "name: " + "Abc def " * 50_000
    row = spark.createDataFrame([(text,)], "t string").select(F.length("t").alias("n"), F.regexp_count("t", F.lit(java_regex(name))).alias("k")).first()
    assert (row.n, row.k) == (len(text), 1)


@pytest.mark.parametrize("text", ["name: Ada Lovelace, person X Y1", "full name Bob", "name 9", "Person: Al Bo Cy. name:"])
def test_possessive_groups_match_the_same(spark, text):
    name = next(p for p in cat.generic_catalog() if p.type == "Name")
    plain = "(?imsuU)" + name.regex
    row = spark.createDataFrame([(text,)], "t string").select(
        F.regexp_extract_all("t", F.lit(java_regex(name)), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b")).first()
    assert row.a == row.b
