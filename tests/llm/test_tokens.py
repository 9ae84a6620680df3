"""Token counts and packing against the tokenizer library itself."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkveil.llm.packing import Packer, pack, pieces_of
from sparkveil.llm.queries import QUERIES, tokenizer
from sparkveil.llm.token_counts import count_tokens
from tests.llm.helpers import docs, empty


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op9_two_tier_token_counts"](spark, sf).collect():
        n = len(ids_of(library, texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_counts_of_odd_rows(spark, library):
    for entries in (1, 1000):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs(spark), tokenizer(), entries=entries).collect())
        want = Counter((r.doc_id, len((r.text or "").encode()), len(ids_of(library, r.text))) for r in docs(spark).collect())
        assert got == want
    assert count_tokens(empty(spark), tokenizer()).count() == 0


def whole(rows, ids_by_doc, window=2048):
    """Every id lies in one piece, and sequences have no gaps; returns the padding by sequence."""
    fill, seen = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and 0 < r.length <= window
        seen.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in seen.items():
        joined = [i for _, ids, _ in sorted(parts) for i in ids]
        assert joined == ids_by_doc[doc] and {t for _, _, t in parts} == {len(joined)}
        assert sum(len(p[1]) for p in parts) == len(joined)
    assert set(seen) == set(ids_by_doc)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return [window - sum(n for _, n in parts) for parts in fill.values()]


def test_packing_keeps_every_id(spark, sf, library):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: [*ids_of(library, r.text), 1] for r in frame.collect()}
    padding = whole(pack(frame, tokenizer()).collect(), want)
    assert sum(p > 0 for p in padding) <= frame.rdd.getNumPartitions()
    for r in QUERIES["op3_sum_of_squares_packing"](spark, sf).collect():
        part = want[r.doc_id][r.start: r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_packing_of_odd_rows(spark, library):
    frame = docs(spark, more=False)
    want = {r.doc_id: [*ids_of(library, r.text), 1] for r in frame.collect()}
    whole(pack(frame, tokenizer(), window=16, open_windows=3).collect(), want, 16)
    twice = pack(docs(spark), tokenizer()).collect()
    assert sum(r.length for r in twice if r.doc_id == 5) == 2 * len(want[5])
    assert sum(r.doc_id is None for r in twice) == 1
    assert pack(empty(spark), tokenizer()).count() == 0


def test_level_rule_is_least_sum_of_squares():
    rng, packer = np.random.default_rng(1), Packer(20)
    for i, s in enumerate(rng.integers(1, 20, 400)):
        before, best = packer.count.copy(), packer.best(int(s))

        def squares(h):
            n = before.copy()
            n[h] -= h > 0
            n[h + s] += h + s < 20
            return int((n[1:20] ** 2).sum())

        allowed = [h for h in range(0, 21 - s) if h == 0 or before[h]]
        assert squares(best) == min(map(squares, allowed))
        for _ in packer.place((i, 0, b"\0" * 4 * int(s), int(s))):
            pass


def test_pieces():
    assert [(s, len(b) // 4) for _, s, b, _ in pieces_of(1, b"\0" * 40, 4)] == [(0, 4), (4, 4), (8, 2)]
