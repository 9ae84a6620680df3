"""Near-duplicate components against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from sparkveil.llm import setsketch
from sparkveil.llm.components import components
from sparkveil.llm.queries import QUERIES
from sparkveil.llm.setsketch import BAND, BANDS, keep_one_of_each, near_duplicates, registers, shingles, similar_enough
from tests.llm.helpers import docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain(rows, k):
    """(n_shingles, component) by doc id; ids are distinct here."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def shown(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op10_setsketch_near_duplicates"](spark, sf).collect()
    want = plain(rows, 4)
    assert shown(got) == want and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("small,block,stars", [(16, 128, 3), (1, 4, 0), (3, 5, 1)])
def test_chains_and_groups(spark, monkeypatch, small, block, stars):
    """Chains of edits link over several steps, and near copies of one text are not all near each other."""
    for name, value in (("SMALL", small), ("BLOCK", block), ("STARS", stars)):
        monkeypatch.setattr(setsketch, name, value)
    rng, texts = random.Random(5), []
    vocabulary = [f"v{i}" for i in range(300)]
    for _ in range(4):
        base = [rng.choice(vocabulary) for _ in range(120)]
        now = list(base)
        for step in range(8):
            texts.append(" ".join(now))
            now[rng.randrange(120)] = "edit"
            now[rng.randrange(120)] = "edit"
        for _ in range(12):
            near = list(base)
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                near[rng.randrange(120)] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(25)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[j]) for i, j in enumerate(order)]
    frame = docs(spark, [t for _, t in rows], more=False)
    for k in (4, 5) if small == 16 else (4,):
        assert shown(near_duplicates(frame, k).collect()) == plain(rows, k)


def test_odd_rows(spark):
    frame = docs(spark)
    got = near_duplicates(frame, 4).collect()
    assert len(got) == frame.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id is None and r.kept for r in by[None])
    assert [(r.n_shingles, r.component_id, r.kept) for r in by[0] + by[1] + by[2]] == [(0, i, True) for i in range(3)]
    assert len(by[5]) == 2 and {r.component_id for r in by[5]} == {5}
    assert near_duplicates(empty(spark)).count() == 0
    kept = keep_one_of_each(docs(spark, ["a b c d e f", "A b c d E f", "other", None, None]))
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 1 << 63, 900, np.uint64)) for _ in range(2))
    assert (np.maximum(registers(a), registers(b)) == registers(np.union1d(a, b))).all()
    assert len(registers(a)) == BAND * BANDS
    for wanted, shared, expect in ((0.8, 0.9, True), (0.8, 0.8, True), (0.8, 0.3, False)):
        n = int(2 * 1000 * shared / (1 + shared))
        both = rng.integers(0, 1 << 63, n, np.uint64)
        x, y = (np.concatenate([both, rng.integers(0, 1 << 63, 1000 - n, np.uint64)]) for _ in range(2))
        got = similar_enough(registers(x)[None], registers(y)[None], np.array([1000.0]), np.array([1000.0]), wanted)
        assert bool(got[0]) is expect
    assert not similar_enough(registers(a)[None], registers(a[:300])[None], np.array([900.0]), np.array([300.0]), 0.8)[0]
    assert len(shingles("one two", 4)) == 1 and len(shingles("", 4)) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i + 1, i) for i in range(60)] + [(1000 + i, 1000) for i in range(40)] + [(rng.randrange(2000, 2050), rng.randrange(2000, 2050)) for _ in range(30)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {n: n for e in edges for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
