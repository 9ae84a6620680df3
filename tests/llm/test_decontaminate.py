"""Benchmark windows in documents against a plain search."""

import hashlib
import re

import pytest

from sparkveil.llm.decontaminate import decontaminate, find_matches
from sparkveil.llm.queries import QUERIES
from tests.llm.helpers import TEXTS, docs, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(items, n=10):
    out = {}
    for item, text in items:
        w = words(text)
        for j in range(max(1, len(w) - n + 1) if w else 0):
            out.setdefault(tuple(w[j: j + n]), set()).add("" if item is None else str(item))
    return out


def plain(text, wins):
    w, hit, items = words(text), set(), set()
    for n in {len(k) for k in wins}:
        for i in range(len(w) - n + 1):
            if (got := wins.get(tuple(w[i: i + n]))):
                hit |= set(range(i, i + n))
                items |= got
    return len(w), len(hit), sorted(items)


def test_whole_table(spark, sf):
    wins = windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_suffix_array_decontamination"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, items = plain(texts[r.doc_id], wins)
        want = hashlib.sha256(",".join(items).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), want, hit > 0)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Short, ITEM here"), (3, None), (None, "null id item é"), (10, "one"), (4, ""), (2, "Short item here"),
         (5, "a a a a a a a a a a a a"), (6, " ".join(f"w{i}" for i in range(30, 50)))]
DOCS = ["x " + LONG + " y", LONG[30:200], "short item-here; short item", "null ID item É", "One two", "A " * 25, LONG + " " + LONG,
        "w1 w2 w3 w4 w5 w6 w7 w8 w9", " ".join(f"w{i}" for i in range(25, 45)), "pre null id\nitem é"]


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_odd_rows(spark, size):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    frame, wins = docs(spark, DOCS + TEXTS), windows(ITEMS)
    rows = find_matches(frame, bench, block_bytes=size).collect()
    assert len(rows) == frame.count()
    for r in rows:
        f = r._llm_found
        assert (f.n_words, f.n_hit, f["items"]) == plain(r.text, wins), r.text
        w = words(r.text)
        for m in f.matches:
            sources = [words(t) for i, t in ITEMS if ("" if i is None else str(i)) == m.item_id]
            part = w[m.doc_word: m.doc_word + m.n_words]
            assert len(part) == m.n_words and any(s[m.item_word: m.item_word + m.n_words] == part for s in sources)
    assert {r._llm_found.longest for r in rows if r.text == DOCS[0]} == {40}


def test_removal(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    frame, wins = docs(spark, DOCS + TEXTS), windows(ITEMS)
    got = decontaminate(frame, bench)
    assert got.columns == frame.columns
    assert sorted(r.text or "" for r in got.collect()) == sorted(r.text or "" for r in frame.collect() if not plain(r.text, wins)[1])
    assert decontaminate(frame, bench.limit(0)).count() == frame.count()
    assert decontaminate(empty(spark), bench).count() == 0
