import hashlib
import zlib

from pyspark.sql import functions as F

from sparkveil.llm import merkle
from sparkveil.llm.queries import QUERIES, table
from .helpers import docs, empty

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    shown = [None if r[f] is None else str(r[f]) for f in FIELDS]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in shown])


def climb(run):
    """(root, siblings of each, left and right of it)"""
    paths, level, place = [[] for _ in run], list(run), list(range(len(run)))
    while len(level) > 1:
        for i, at in enumerate(place):
            base = at // 8 * 8
            paths[i].append(("".join(level[base:at]), "".join(level[at + 1:base + 8])))
            place[i] = at // 8
        level = [sha(*level[k:k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in langs:
        ordered = sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[k] = (ordered, *climb([leaf(r) for r in ordered]))
    root, tops = climb([trees[k][1] for k in langs]) if langs else (None, [])
    out = []
    for k, top in zip(langs, tops):
        ordered, sub, paths = trees[k]
        for r, path in zip(ordered, paths):
            whole = path + top
            t = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                t["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            d = leaf(t)
            for a, b in whole:
                d = sha(a, d, b)
            out.append((r["doc_id"], leaf(r), sub, root, sha(*[a + b for a, b in whole]), d, d == root))
    return sorted(map(str, out))


def answer(spark, frame):
    import sparkveil.llm.queries as Q

    kept, Q.table = Q.table, lambda *a: frame
    try:
        return sorted(str(tuple(r)) for r in QUERIES["op12_merkle_manifest"](spark, "").collect())
    finally:
        Q.table = kept


def test_like_a_loop(spark, sf):
    frame = table(spark, sf, "documents")
    got = sorted(str(tuple(r)) for r in QUERIES["op12_merkle_manifest"](spark, sf).collect())
    assert got == brute([r.asDict() for r in frame.collect()])


def test_depths_from_one_leaf_to_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)  # a round for each level
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "e": 65, "f": 3, None: 2, "é": 7, "h": 1, "i": 130}

    def frame():
        rows = [(n * 1000 + i, f"Text {i % 5}", k, "s", 1) for n, (k, size) in enumerate(sizes.items()) for i in range(size)]
        rows += [rows[-1]] * 20  # equal rows are leaves of their own, and their nodes share digests
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    assert answer(spark, frame()) == brute([r.asDict() for r in frame().collect()])
    monkeypatch.setattr(merkle, "LEVELS", 3)
    sizes |= {"p": 512, "q": 513}
    assert answer(spark, frame()) == brute([r.asDict() for r in frame().collect()])


def test_odd_rows(spark):
    frame = docs(spark).withColumn("rank", F.lit("r")).withColumn("g", F.lit("g"))
    assert answer(spark, frame) == brute([r.asDict() for r in frame.collect()])
    assert answer(spark, empty(spark)) == []
