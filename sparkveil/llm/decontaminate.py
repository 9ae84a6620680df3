"""Benchmark passages in training text, found by binary search of test suffixes in suffix arrays of the text.

Each batch of documents is a shard: its words become numbers of the benchmark's vocabulary (0: not in it), suffixes
that could begin a benchmark window are sorted, and every test suffix is looked up in that array by binary search.
Neighbouring hits on one diagonal join to the longest verbatim matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks

WINDOW = 10
#: Benchmark text in one broadcast index; a larger benchmark is searched in several passes over the documents.
BLOCK_BYTES = 2 << 20
_HEAD = 4
_MAP_BITS = 22

_keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS = bytes(b if b in _keep else 32 for b in _low)


def plain_words(text: str | None) -> Iterator[list[bytes]]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, in bounded lists."""
    for block in blocks((text or "").encode("utf-8", "surrogatepass").translate(LETTERS)):
        yield block.split()


def _mixed(cols: list[np.ndarray]) -> np.ndarray:
    got = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        got = (got + c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return got >> np.uint64(64 - _MAP_BITS)


class TestSuffixes:
    """The distinct windows of a block of benchmark items, by length, with the places they come from."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        places: dict[tuple[int, ...], list[tuple[str, int]]] = {}
        for item, text in items:
            found = [w for part in plain_words(text) for w in part]
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            for j in range(max(1, len(ids) - window + 1) if ids else 0):
                places.setdefault(tuple(ids[j: j + window]), []).append((item, j))
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, list]] = []
        for n in sorted({len(k) for k in places}):
            keys = sorted(k for k in places if len(k) == n)
            table = np.array(keys, np.uint32).reshape(len(keys), n)
            near = np.zeros(1 << _MAP_BITS, bool)
            near[_mixed([table[:, i] for i in range(min(n, _HEAD))])] = True
            self.by_length.append((n, table, near, [places[k] for k in keys]))

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.fromiter(map(get, part, repeat(0)), np.uint32, len(part)) for part in plain_words(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _strings(table: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    flat = np.ascontiguousarray(table.astype(">u4"))
    return flat.view(f"S{4 * table.shape[1]}").ravel()


def occurrences(shard: np.ndarray, tests: TestSuffixes) -> Iterator[tuple[int, list[tuple[str, int]], np.ndarray]]:
    """(words, places in the benchmark, sorted positions in the shard) of every window that occurs. ``shard`` holds the
    numbers of all its documents with zeros between, so that no match crosses documents."""
    padded = np.concatenate([shard, np.zeros(tests.window, np.uint32)])
    for n, table, near, places in tests.by_length:
        head = min(n, _HEAD)
        at = np.flatnonzero(shard)
        if head > 1:
            at = at[padded[at + 1] != 0]
        at = at[near[_mixed([padded[at + i] for i in range(head)])]]
        if not len(at):
            continue
        keys = _strings(padded[at[:, None] + np.arange(n)])
        suffixes = np.argsort(keys, kind="stable")
        ordered, asked = keys[suffixes], _strings(table)
        first, after = np.searchsorted(ordered, asked, "left"), np.searchsorted(ordered, asked, "right")
        for k in np.flatnonzero(after > first):
            yield n, places[k], at[suffixes[first[k]: after[k]]]


def longest(hits: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """(item, word in the item, word in the document, words): hits on one diagonal that touch or overlap become one."""
    out: list[list] = []
    for item, j, at, n in sorted(hits, key=lambda h: (h[0], h[2] - h[1], h[2])):
        if out and out[-1][0] == item and out[-1][2] - out[-1][1] == at - j and at <= out[-1][2] + out[-1][3]:
            out[-1][3] = max(out[-1][3], at - out[-1][2] + n)
        else:
            out.append([item, j, at, n])
    return [tuple(h) for h in out]


def hit_words(matches: list[tuple[str, int, int, int]]) -> int:
    total, end = 0, 0
    for at, n in sorted((m[2], m[3]) for m in matches):
        total += max(0, at + n - max(at, end))
        end = max(end, at + n)
    return total


def match_texts(texts: list[str | None], tests: TestSuffixes) -> tuple[list[int], list[list[tuple[str, int, int, int]]]]:
    """Words and longest matches of each text of one shard."""
    parts, starts, at = [], [], 0
    for text in texts:
        numbers = tests.numbers(text)
        parts += [numbers, np.zeros(1, np.uint32)]
        starts.append(at)
        at += len(numbers) + 1
    sizes = [len(p) for p in parts[::2]]
    found: list[list] = [[] for _ in texts]
    if at:
        begin = np.array(starts)
        for n, places, where in occurrences(np.concatenate(parts), tests):
            for d, w in zip(np.searchsorted(begin, where, "right") - 1, where):
                found[d] += [(item, j, int(w - begin[d]), n) for item, j in places]
    return sizes, [longest(f) for f in found]


def benchmark_blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark, streamed in blocks whose text stays within ``block_bytes`` (an item alone may be longer)."""
    block, size = [], 0
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        n = 4 * len(r.t or "")
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    yield block


_MATCH = "array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"
_FIELDS = f"n_words long, n_hit long, items array<string>, longest long, matches {_MATCH}"


def find_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents' columns with ``_llm_found``: a struct of n_words, n_hit, items, longest and matches (item, word in the
    item, word in the document, words). No shuffle; the benchmark is broadcast in blocks of bounded size, and from the
    second block on the rows are cut into a table of the shared folder.

    A window is ``window`` words of an item, or the whole of a shorter item with words. Null texts have no words, null
    item ids count as the empty string, repeated rows and items are matched one by one, an empty benchmark hits
    nothing, an empty table of documents gives no rows.
    """
    from pyspark.sql.types import StructField, StructType

    from .shared import stored, to_arrow_schema

    spark = docs.sparkSession
    found = StructType.fromDDL(_FIELDS)
    schema = StructType([*docs.schema.fields, StructField("_llm_found", found)])
    kind = to_arrow_schema(StructType([StructField("_llm_found", found)])).field(0).type
    columns, at = docs.columns, docs.columns.index(text_col)
    names = [f.name for f in found]
    for number, block in enumerate(benchmark_blocks(bench, block_bytes=block_bytes)):
        tests = spark.sparkContext.broadcast(TestSuffixes(block, window))

        def run(batches, tests=tests, again=number > 0):
            for batch in batches:
                sizes, new = match_texts(batch.column(at).to_pylist(), tests.value)
                if again:
                    old = [[tuple(m.values()) for m in f["matches"]] for f in batch.column(batch.num_columns - 1).to_pylist()]
                    new = [[*a, *b] for a, b in zip(old, new)]
                rows = [dict(zip(names, (n, hit_words(m), sorted({x[0] for x in m}), max((x[3] for x in m), default=0), [dict(zip(("item_id", "item_word", "doc_word", "n_words"), x)) for x in m]))) for n, m in zip(sizes, new)]
                kept = batch.columns[:-1] if again else batch.columns
                yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, kind)], names=[*columns, "_llm_found"])

        docs_in = docs if number == 0 else stored(out, "matches")
        out = docs_in.mapInArrow(run, schema)
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    return find_matches(docs, bench, text_col=text_col, window=window).filter("_llm_found.n_hit = 0").drop("_llm_found")
