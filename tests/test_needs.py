"""Pre-tests of the catalogs and the plain form of their patterns change no result."""

import random
import re

import pytest

from pyspark.sql import functions as F

from sparkveil.functions import catalogs as cat
from sparkveil.functions.match import HEAD
from sparkveil.operators import detect as D
from sparkveil.plans import corpora as C
from sparkveil.plans.mask_queries import card_hits

CATALOGS = {"shape": (cat.shape_catalog(), None), "label": (cat.label_catalog(), None), "generic": (cat.generic_catalog(), 0)}
MADE = [
    "2341 2341 0001", "2341-2341-0001", "234123410001", "ABCDE0001F", "A1234567", "ABC1234567", "MH 12 34567", "ab1234567890123", "HDFC0123456",
    "22ABCDE1234F1Z5", "L12345MH2004PTC123456", "AB1234567", "AB1234567890", "4111 1111 1111 1111", "4111111111111111", "05/27", "1234567890",
    "pay7@okaxis", "user.x@example.com", "+91-9876543210", "560001", "01/02/1990", "35-209900-176148", "10.0.3.7", "1:2:3:4:5:6:7:8", "AA:BB:CC:DD:EE:FF",
    "abcdEFGH-_12345678", "EMP0042", "SR202112345", "TXN12345678", "CUST000001", "ORD12345678", "MR123456", "IP12345678", "MH12AB0001", "MH 12 AB 0001",
    "TAX1234567", "MID12345", "PRJ1234", "A1B2C3", "AAAA-BBBB-CCCC-DDDD", "01234567-89ab-cdef-0123-456789abcdef", "0123456789abcdef0123456789abcdef", "₹1,200",
    "12.5,77.25", "12.345678, 77.345678", "EPIC/ABC123456", "MH-1234-1234567", "22ABCDE1234F1Z", "Ann Lee", "male", "B.Tech", "Debit", "INV-12345", "٣٤٥٦٧٨٩٠١٢٣٤",
    "Phone: 98765 43210", "mobile +91-9876543210", "Date  of birth: 1-2-1990", "Born: 01/02/1990", "Address: 4 Low Rd, Pune - 411001", "emp # AB1234", "Txn #ABC123456"]
WORDS = ["account number", "bank account", "phone", "mobile", "date of birth", "DOB", "full name", "person", "address", "location", "employee id", "emp #",
         "roll number", "student id", "transaction", "reference", "salary", "income", "api_key", "secret", "token", "user", "password", "pwd", "linkedin.com/in/", "in.com",
         "ſalary", "toKen", "İfsc", "é", "Pa\u2003N"]
BETWEEN = [" ", "  ", "\n", "\t", ":", " : ", "=", " =", "-", ", ", "", "// ", "# ", "\x0b", "\x1c"]


def texts():
    rng = random.Random(11)
    labels = [h for p in cat.label_catalog() for h in p.need[1]]
    # a label as it may stand in a text: any case, blanks between the words it is made of
    loose = lambda h: "".join(c.upper() if rng.random() < .3 else c for c in h[:-1]) + rng.choice(["", " ", "\n"]) + rng.choice(":=")
    parts = [*MADE, *MADE, *WORDS]
    for i in range(2500):
        some = [loose(rng.choice(labels)) if rng.random() < .4 else rng.choice(parts) for _ in range(rng.randint(1, 9))]
        out = "".join(x + rng.choice(BETWEEN) for x in some)
        yield out if i % 3 == 0 else "".join(c for c in out if ord(c) < 128)
    yield from (f"{h[:-1]}{rng.choice(BETWEEN[:2])}: {v}" for h in labels for v in rng.sample(MADE, 8))
    for name, _, rows in cat.LABELS:
        for rx in rows:  # heads of several words, with their blanks
            head = re.split(r"\\s\*\[:=\]", rx)[0].replace("(?:", "").replace(")", "").replace("?", "").replace(r"[_\s]", " ")
            yield from (f"{h.replace(chr(92) + 's*', b)}{b}: {v}" for h in head.split("|") for b in ("", " ", "\n ") for v in ("A1234567", "1234567890", "x@y.com", "Ann"))


@pytest.mark.parametrize("kind", sorted(CATALOGS))
def test_nothing_is_missed(spark, kind):
    patterns, group = CATALOGS[kind]
    plain = [p._replace(need=None, ours=False) for p in patterns]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id int, text string").repartition(16, "doc_id")
    both = D._find(df, "text", patterns, "new", group).select("doc_id", "text", "new")
    both = D._find(both, "text", plain, "old", group).select("text", "new", "old").cache()
    assert both.filter("NOT new <=> old").select("text").head(3) == []
    seen = {r.ord for r in both.select(F.explode("old").alias("h")).select("h.ord").distinct().collect()}
    assert len(seen) > 0.75 * len(patterns), sorted(set(range(len(patterns))) - seen)


def test_labels_are_spelled_out():
    assert cat.spellings(r"(?:api[_\s]?key|pin(?:code)?|cust\s*(?:id|no))\s*[:=]\s*(x)") == ("api_key:", "apikey:", "pincode:", "pin:", "custid:", "custno:")
    assert cat.spellings(r"#\s*IFSC\s*[:=]\s*([A-Z0-9]+)") == ("#ifsc:",)
    assert max(len(h) for p in cat.label_catalog() for h in p.need[1]) <= HEAD


def test_labels_run_on_few_patterns(spark, sf):
    """Of the label patterns only those whose label stands in a card run on it."""
    ran = D._guarded(C.cards(spark, sf), "text", cat.label_catalog())
    from sparkveil.functions.match import may_match
    n = sum((may_match(p, lambda c: F.col(f"__{c}")).cast("int") for p in cat.label_catalog()), F.lit(0))
    assert ran.select(F.max(n)).first()[0] < 30


def test_cards_are_spread(spark, sf):
    assert C.cards(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_hits_of_cards_are_spread(spark, sf):
    assert card_hits(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
