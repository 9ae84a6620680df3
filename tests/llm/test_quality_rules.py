"""Repetition coverage against counts with plain dictionaries."""

import re
from collections import Counter

import pytest

from sparkveil.llm.queries import QUERIES
from sparkveil.llm.repetition import MIN_WORDS, MOST_IN_LINES, MOST_IN_NGRAMS, MOST_LINES, keep_good, quality
from tests.llm.helpers import docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)

    def inside(n):
        grams = [tuple(words[i: i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        first = {g: i for i, g in reversed(list(enumerate(grams)))}
        return tuple({i + k for i, g in enumerate(grams) if count[g] > 1 and i > low(first[g]) for k in range(n)}
                     for low in (lambda at: -1, lambda at: at))

    lines = [x for x in text.split("\n") if WORD.search(x)]
    later = [x for i, x in enumerate(lines) if x in set(lines[:i])] if len(lines) < 500 else None
    if later is None:
        seen, later = set(), []
        for x in lines:
            (later.append(x) if x in seen else seen.add(x))
    chars = sum(map(len, words))
    base = len(words) < MIN_WORDS or 100 * len(inside(5)[0]) > 20 * len(words)
    broken = any(sum(len(words[i]) for i in inside(n)[1]) > share * chars for n, share in MOST_IN_NGRAMS.items())
    broken |= sum(map(len, later)) > MOST_IN_LINES * sum(map(len, lines)) or len(later) > MOST_LINES * len(lines)
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(later), len(inside(5)[0]), base, not base and not broken)


def shown(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_repetition_quality"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert shown(r) == plain(texts[r.doc_id])


@pytest.mark.parametrize("more", [
    ["same line here\n" * 40, "a b c d e f g h i j k l m\n" * 2 + " ".join(map(str, range(60))), "é " * 30, "a\x1cb \x85 c d " * 5],
    ["one two three four five six seven eight nine ten", " ".join(str(i % 7) for i in range(50)), "x | y # z\n\n \nx | y # z"],
])
def test_odd_rows(spark, more):
    frame = docs(spark, more)
    assert sorted((r.doc_id is None, r.doc_id or 0, shown(r)) for r in quality(frame).collect()) == \
        sorted((r.doc_id is None, r.doc_id or 0, plain(r.text)) for r in frame.collect())
    kept = keep_good(frame)
    assert kept.columns == frame.columns
    assert sorted(r.text for r in kept.collect()) == sorted(r.text for r in frame.collect() if plain(r.text)[-1])


def test_nulls_and_nothing(spark):
    assert {shown(r) for r in quality(docs(spark, [None, ""], more=False)).collect()} == {(0, 0, 0, 0, 0, True, False)}
    assert quality(empty(spark)).count() == 0 and keep_good(empty(spark)).count() == 0
    assert quality(docs(spark)).count() == docs(spark).count()
