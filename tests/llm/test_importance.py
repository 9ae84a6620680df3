import hashlib
import math
import random
import re
import zlib

import numpy as np
import xxhash

from sparkveil.llm import ngram_table as N
from sparkveil.llm.importance import resample
from sparkveil.llm.queries import QUERIES, table
from .helpers import docs, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode("utf-8", "surrogatepass")) % 10000


def brute(rows, target):
    own = {i: features(t) for i, (_, t) in enumerate(rows)}
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, fs in own.values():
        for f in fs:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text)[1]:
            t[bucket(f)] += 1
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((a + 1) * (S + 10000) / ((b + 1) * (T + 10000)))) for a, b in zip(t.tolist(), s.tolist())]
    out = []
    for i, (key, _) in enumerate(rows):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own[i][1])
        out.append([key, len(own[i][1]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(own[i][0])])
    order = sorted((o for o in out if o[4] >= 20), key=lambda o: (-o[3], -1 if o[0] is None else o[0]))
    drawn = order[:5 * len(order) // 100]
    rank = {id(o): k + 1 for k, o in enumerate(drawn)}
    return sorted([str((*o[:4], rank.get(id(o)))) for o in out])


def test_keys_and_checksums_are_the_usual_ones():
    rng = np.random.default_rng(1)
    for size in (0, 1, 3, 4, 7, 8, 12, 31, 32, 33, 64, 77):
        rows = rng.integers(0, 256, (5, size), dtype=np.uint8)
        assert N.xxhash64(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]
    pairs = [(rng.bytes(5), rng.bytes(k)) for k in (0, 1, 9, 65, 66, 200)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    a, b = zip(*pairs)
    assert N.followed(crc(a), crc(b), np.array([len(x) for x in b])).tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_equal_keys_are_told_apart_by_bytes():
    rows = np.array([[1], [2], [1], [3], [2]], np.uint8)
    t = N.Table(np.full(5, 7, np.uint64), rows)
    assert t.slot[0] == t.slot[2] and t.slot[1] == t.slot[4] and len({*t.slot[:4].tolist()}) == 3
    assert sorted(t.count[t.used].tolist()) == [1, 2, 2]


def test_long_texts_are_cut_between_words_and_lose_nothing(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " ".join(rng.choice(["a", "bb", "ccc", "é" * 3, "x" * 70]) for _ in range(400)), "y" * 300, "  one  "]
    monkeypatch.setattr(N, "CHUNK", 37)
    count = {}
    total = [0] * len(texts)
    for places, pieces in N.chunks(texts):
        g = N.Grams(pieces, 10000)
        for t, p in zip(g.tables, g.pieces):
            for b, k in zip(t.bucket[t.used].tolist(), t.count[t.used].tolist()):
                count[b] = count.get(b, 0) + k
            for x in p.tolist():
                total[places[x]] += 1
    want = {}
    for t in texts:
        for f in features(t)[1]:
            want[bucket(f)] = want.get(bucket(f), 0) + 1
    assert count == want and total == [len(features(t)[1]) for t in texts]


def test_like_a_loop(spark, sf):
    got = QUERIES["op13_importance_resampling"](spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, sf, "benchmark").collect()]
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in got) == brute(rows, target)


def test_odd_rows(spark):
    frame = docs(spark)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = resample(frame, docs(spark, ["one two three"], more=False)).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in got) == brute(rows, ["one two three"])
    assert resample(empty(spark), frame).count() == 0
    assert resample(frame, empty(spark)).count() == len(rows)
