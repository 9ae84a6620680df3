"""Line windows and shards against plain loops."""

import re
import zlib
from collections import Counter

from sparkveil.llm.line_windows import LINES, dedup_lines, drop_repeated_lines
from sparkveil.llm.queries import QUERIES
from sparkveil.llm.shards import shard_rows, write_shards
from tests.llm.helpers import docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """Text left by id; ids are distinct."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(full) - LINES + 1):
            window = tuple(lines[j] for j in full[k: k + LINES])
            if window in seen:
                gone |= set(range(full[k], full[k + LINES - 1] + 1))
            seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if text is not None else None
    return out


BLOCK = "first line\nsecond line\nthird line\nfourth line"
ODD = [BLOCK, "own\n" + BLOCK + "\nown end", "first line\n\nsecond line\n \t\nthird line", BLOCK.upper(), "a\na\na\na\na\na", None, "", "\n\n\n\n",
       BLOCK + "\n" + BLOCK, "x\r\ny\r\nz", "x\ny\nz", "first line\nsecond line", BLOCK]


def test_windows(spark):
    frame = docs(spark, ODD, more=False)
    want = plain(list(enumerate(ODD)))
    rows = drop_repeated_lines(frame).collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(ODD)
    for r in rows:
        gone = {k for s in r._llm_lines.spans for k in range(s.first, s.last + 1)}
        lines = (ODD[r.doc_id] or "").split("\n")
        assert "\n".join(x for k, x in enumerate(lines) if k not in gone) == (r.text or "")
        assert r._llm_lines.n_removed == sum(bool(WORD.search(lines[k])) for k in gone)
    left = dedup_lines(frame)
    assert left.columns == frame.columns
    told = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert told == {i: (t, len(t) if t != ODD[i] else None) for i, t in want.items() if t == ODD[i] or WORD.search(t)}


def test_windows_of_odd_rows(spark):
    frame = docs(spark, [BLOCK, "other"])
    again = frame.unionByName(frame).unionByName(frame.filter("doc_id = 0").selectExpr("CAST(NULL AS LONG) AS doc_id", *frame.columns[1:]))
    rows = drop_repeated_lines(again).collect()
    assert len(rows) == again.count()
    assert Counter((r.doc_id, r.text) for r in rows if r.text in (BLOCK, "")) == Counter({(0, BLOCK): 2, (None, ""): 1})
    assert drop_repeated_lines(empty(spark)).count() == 0 and dedup_lines(empty(spark)).count() == 0


def law_holds(rows, shards, n):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_external_shuffle_shards"](spark, sf).collect()
    law_holds(rows, 8, len(texts))
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    up = sum(a < b for a, b in zip(order, order[1:]))
    assert 0.35 * len(order) < up < 0.65 * len(order)


def test_shards_of_odd_rows(spark, tmp_path):
    frame = docs(spark).unionByName(docs(spark)).repartition(3, "doc_id")
    for shards, size in ((8, 1 << 20), (3, 300), (50, 1 << 20)):
        rows = shard_rows(frame, shards, bucket_bytes=size).collect()
        law_holds(rows, shards, frame.count())
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in frame.collect())
    assert shard_rows(empty(spark)).count() == 0
    write_shards(frame, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    law_holds(back.collect(), 4, frame.count())


def test_seed_decides(spark):
    frame = docs(spark, [f"t{i}" for i in range(60)], more=False)

    def order(seed):
        return [r.doc_id for r in shard_rows(frame, 2, seed=seed).orderBy("shard", "slot").collect()]

    assert order(1) == order(1) != order(2)
    assert sorted(order(1)) == list(range(60))
