"""Substring removal against every string of the length in a dictionary; run merging against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparkveil.llm import suffixes
from sparkveil.llm.queries import QUERIES
from sparkveil.llm.suffix_merge import common_prefix, decoded, front_coded, merge
from sparkveil.llm.suffixes import drop_repeats, stretches
from tests.llm.helpers import docs, empty


def plain(texts, length):
    """(bytes, removed, runs, what remains) for each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i: i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i: i + length]] > 1:
                gone[i: i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(rows, plain([r.text for r in rows], 400))}
    got = QUERIES["op6_suffix_merge_substrings"](spark, sf).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        n, removed, runs, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, runs, hashlib.sha256(kept).hexdigest())


def texts_with_shared_parts(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    passages = [noise(rng.choice([29, 30, 31, 45, 80])) for _ in range(8)]
    texts = []
    for _ in range(40):
        parts = [noise(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 12)
            parts += [p[cut:] if rng.random() < 0.5 else p[: len(p) - cut], noise(rng.randrange(0, 20))]
        texts.append("".join(parts))
    base = noise(150)
    for _ in range(8):
        at = rng.randrange(150)
        texts.append(base[:at] + "X" + base[at + 1:])
    return texts + texts[:3] + ["ab" * 60, "a" * 90, "a" * 31, passages[0] * 3]


@pytest.mark.parametrize("seed,several,block", [(1, 200_000, 16), (2, 50, 5), (3, 7, 1), (4, 3, 3)])
def test_shared_parts(spark, monkeypatch, seed, several, block):
    monkeypatch.setattr(suffixes, "RUN_SUFFIXES", several)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    texts = texts_with_shared_parts(seed)
    frame = docs(spark, texts, more=False).repartition(5)
    rows = {r.doc_id: r for r in drop_repeats(frame, 30, 12).collect()}
    for i, want in enumerate(plain(texts, 30)):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == want, (i, texts[i])


@pytest.mark.parametrize("group", [40, 1_000_000])
def test_one_passage_in_most_texts(spark, monkeypatch, group):
    """Its two groups of blocks are dealt over the shares, and windows that stand in several pieces are still found."""
    monkeypatch.setattr(suffixes, "GROUP", group, raising=False)
    seen = {}
    keep = suffixes.stored
    monkeypatch.setattr(suffixes, "stored", lambda df, name: seen.setdefault(name, keep(df, name)))
    rng = random.Random(8)

    def near(n):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    passage = near(40)
    texts = [near(rng.randrange(0, 30)) + passage + near(rng.randrange(0, 30)) for _ in range(700)] + [near(60) for _ in range(50)]
    frame = docs(spark, texts, more=False).selectExpr("if(doc_id = 3, null, doc_id) AS doc_id", "text").repartition(5)
    rows = {r.doc_id: r for r in drop_repeats(frame, 30, 12).collect()}
    for i, want in enumerate(plain(texts, 30)):
        r = rows[None if i == 3 else i]
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == want, (i, texts[i])
    shares = [r.n for r in seen["runs"].selectExpr("share", "size(firsts) AS n").groupBy("share").sum("n").toDF("share", "n").collect()]
    if group < sum(shares):
        assert max(shares) < 0.3 * sum(shares)


def test_odd_rows(spark):
    frame = docs(spark, ["y" * 50 + "tail", None, "", "short", "same text that is long enough to be a match"])
    frame = frame.unionByName(frame.filter("doc_id = 4"))
    rows = drop_repeats(frame, 30, 12).collect()
    assert len(rows) == frame.count()
    want = Counter((r, w) for r, w in zip([x.doc_id for x in frame.collect()], plain([x.text for x in frame.collect()], 30)))
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in rows) == want
    assert drop_repeats(empty(spark)).count() == 0


def test_equal_windows_have_equal_anchors(monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 64)
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(500)) + b"c" * 100
    data += data[100:300]
    offset = {}
    rows = stretches(data, 30, 12)
    covered = [p for _, first, last in rows.tolist() for p in range(first, last + 1)]
    assert covered == list(range(len(data) - 29))
    for a, first, last in rows.tolist():
        for p in range(first, last + 1):
            assert 0 <= a - p < 12 and offset.setdefault(data[p: p + 30], a - p) == a - p


def test_merge():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        for _ in range(30):
            runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 3, 70, 130]))) for _ in range(rng.randrange(9))}) for _ in range(k)]
            got, last = list(merge([decoded(*front_coded(x)) for x in runs])), b""
            assert [s for _, s, _ in got] == sorted(s for x in runs for s in x)
            for n, s, i in got:
                assert n == common_prefix(last, s) and s in runs[i]
                last = s
