"""Exact substring de-duplication: bytes covered by a string of ``length`` bytes that also starts somewhere else.

Lee et al., "Deduplicating Training Data Makes Language Models Better" (2022), as a distributed merge sort of suffixes.
Before the sort, as in prefix-doubling string sorters, hashes find the suffixes that cannot have an equal elsewhere:
every window of ``length`` bytes has an anchor, the least of the hashed 8-byte grams at its first ``REACH`` places, and
equal windows have equal anchors. Windows with one anchor are neighbours, a stretch; an anchor whose context is found
once in the corpus needs no sorting. Stretches that are equal as a whole count once, with their number, and those that agree in part are cut into blocks
of a few windows, for which the same holds. What is left is one suffix for each block: tasks sort them, front-code the
runs and deal them out by leading bytes, and loser trees merge the runs. Blocks whose common prefix spans all that
their windows share stand together in that order and differ at the edges alone, where their windows are compared.
A large group of such blocks is dealt out in pieces; each piece is merged and compared by itself, and what its windows
come to is added up over the pieces.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .shared import stored, text_hash, to_arrow_schema
from .suffix_merge import decoded, front_coded, merge

LENGTH, REACH, GRAM = 400, 200, 8
_BLOCK = 4 << 20
_BITS = 24
_LOW = np.uint64((1 << _BITS) - 1)


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours, from running minima of blocks of ``w``."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1: n])


def stretches(data: bytes, length: int = LENGTH, reach: int = REACH) -> np.ndarray:
    """Rows (anchor, first window, last window): all windows of ``length`` bytes by the place of their anchor."""
    out, total = [], len(data) - length + 1
    for at in range(0, max(total, 0), _BLOCK):
        n = min(_BLOCK, total - at)
        part = data[at: at + n + reach - 1 + GRAM]
        grams = np.ndarray((n + reach - 1,), "<u8", part, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(keys, reach) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], n) - 1
        out.append(np.stack([anchor[first], first, last], axis=1) + at)
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _contexts(data: bytes, rows: np.ndarray, length: int, reach: int) -> list[int]:
    """Hash of what every window of a stretch has from its anchor on."""
    size, digest = length - reach + 1, xxhash.xxh3_64_intdigest
    return [_signed(digest(data[a: a + size])) for a in rows[:, 0].tolist()]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))


def repeated_contexts(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """(c): anchor contexts found twice or more in all texts."""
    def run(batches):
        for batch in batches:
            found, often = [], []
            for text in batch.column(0).to_pylist():
                data = _bytes(text)
                c, n = np.unique(np.array(_contexts(data, stretches(data, length, reach), length, reach), np.int64), return_counts=True)
                found.append(c)
                often.append(np.minimum(n, 2))
            c, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, often))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["c", "n"])

    rows = docs.select("text").mapInArrow(run, "c long, n long")
    return rows.groupBy("c").agg(F.sum("n").alias("n")).filter("n > 1").select("c")


def occurrences(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """(c, f, id, t, first, last) of every stretch; c and f together tell equal stretches."""
    kind = docs.schema["id"]

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            cs, fs, which, spots = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = _bytes(text)
                rows = stretches(data, length, reach)
                cs += _contexts(data, rows, length, reach)
                fs += [_signed(digest(data[p: q + length], seed=a - p)) for a, p, q in rows.tolist()]
                which += [i] * len(rows)
                spots.append(rows[:, 1:])
            spot = np.concatenate(spots) if spots else np.zeros((0, 2), np.int64)
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(fs, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(spot[:, 0]), pa.array(spot[:, 1])], ["c", "f", "id", "t", "first", "last"])

    schema = StructType([*StructType.fromDDL("c long, f long").fields, kind, *StructType.fromDDL("t long, first long, last long").fields])
    return docs.mapInArrow(run, schema)


def _blocks(parts: DataFrame, length: int, reach: int, block: int) -> DataFrame:
    """(c, f, id, t, first, last, lead, n): the wanted stretches cut into blocks of at most ``block`` windows, at fixed
    distances from the anchor. All windows of a block hold the bytes from ``lead`` on that ``c`` is the hash of."""
    kind = parts.schema["id"]
    fields = StructType.fromDDL("t long, first long, last long, lead long, n long")
    schema = StructType([*StructType.fromDDL("c long, f long").fields, kind, *fields])

    def run(batches):
        digest, size = xxhash.xxh3_64_intdigest, length - block + 1
        for batch in batches:
            rows = []
            for i, t, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = _bytes(text)
                anchors = {p: a for a, p, _ in stretches(data, length, reach).tolist()}
                for w in wanted:
                    a, p = anchors[w["first"]], w["first"]
                    while p <= w["last"]:
                        k = (a - p) // block
                        lead, last = a - k * block, min(w["last"], a - k * block)
                        rows.append((_signed(digest(data[lead: lead + size], seed=k)), _signed(digest(data[p: last + length], seed=a - p)), i, t, p, last, lead, w["n"]))
                        p = last + 1
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, to_arrow_schema(schema))], names=schema.names)

    return parts.select("id", "t", "text", "wanted").mapInArrow(run, schema)


def _runs(parts: DataFrame, length: int, deals: int, block: int, most: int) -> DataFrame:
    """Sorted, front-coded runs of one suffix for each wanted block, from its ``lead`` on, for each of ``deals`` shares;
    with the bytes to the left of it that the block's other windows have, and whose windows they are. A group of more
    than ``GROUP`` blocks goes to several shares, by what stands at its blocks' edges."""
    kind = parts.schema["id"]
    size = length - block + 1
    schema = StructType([*StructType.fromDDL(
        "share int, lengths array<int>, rests array<binary>, lefts array<binary>, firsts array<long>, lasts array<long>, leads array<long>, ns array<long>, pieces array<int>, ts array<long>").fields,
        StructField("ids", ArrayType(kind.dataType))])

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        kinds = to_arrow_schema(schema)
        held: list[list[tuple]] = [[] for _ in range(deals)]
        total = 0

        def flush():
            for share, rows in enumerate(held):
                if rows:
                    rows.sort(key=lambda r: r[0])
                    suffixes, lefts, firsts, lasts, leads, ns, pieces, ts, ids = zip(*rows)
                    lengths, rests = front_coded(suffixes)
                    one = [[share], [lengths], [rests], *([list(c)] for c in (lefts, firsts, lasts, leads, ns, pieces, ts, ids))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, kinds)], names=schema.names)
                    rows.clear()

        for batch in batches:
            for i, t, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = _bytes(text)
                for w in wanted:
                    suffix, left = data[w["lead"]: w["last"] + length], data[w["first"]: w["lead"]]
                    piece = digest(left, seed=digest(suffix[size:])) % w["pieces"]
                    share = digest(suffix[:size], seed=piece) % deals
                    held[share].append((suffix, left, w["first"], w["last"], w["lead"], w["n"], w["pieces"], t, i))
                    total += 1
                if total >= most:
                    yield from flush()
                    total = 0
        yield from flush()

    return parts.select("id", "t", "text", "wanted").mapInArrow(run, schema)


#: Windows in a block at most, and suffixes that a task sorts at once; a suffix takes some 500 bytes.
BLOCK, RUN_SUFFIXES = 16, 100_000
#: Blocks of a group that are compared at once; larger groups are dealt out in pieces of about this size.
GROUP = 2_000


def _window_counts(group: list[tuple[bytes, bytes, int, int, int, int]], size: int, block: int) -> dict[tuple[int, bytes, bytes], list[int]]:
    """The members that have each window; members agree on ``size`` bytes from their lead on, so their windows differ
    at the edges alone. Members are (suffix, left, first, last, lead, n)."""
    by: dict[tuple[int, bytes, bytes], list[int]] = {}
    for k, (suffix, left, first, last, lead, _) in enumerate(group):
        right = suffix[size:]
        for p in range(first, last + 1):
            j = lead - p
            by.setdefault((j, left[len(left) - j:], right[: block - 1 - j]), []).append(k)
    return by


def _equal_windows(group: list[tuple[bytes, bytes, int, int, int, int]], size: int, block: int) -> dict[int, list[int]]:
    """Starts of windows that stand elsewhere too, by member."""
    found: dict[int, list[int]] = {}
    for (j, _, _), members in _window_counts(group, size, block).items():
        if len(members) > 1 or group[members[0]][5] > 1:
            for k in members:
                if group[k][5] == 1:
                    found.setdefault(k, []).append(group[k][4] - j)
    return found


def _open_windows(group: list[tuple[bytes, bytes, int, int, int, int]], size: int, block: int) -> list[tuple[int, int, int, int | None, int]]:
    """(a, b, n, member, j) for each different window of a piece: a hash of 128 bits, its count up to two, the member whose
    window hangs on the other pieces, none where this piece alone settles it, and how far before the lead it starts."""
    out = []
    for (j, before, after), members in _window_counts(group, size, block).items():
        suffix, n = group[members[0]][0], group[members[0]][5]
        h = xxhash.xxh3_128_intdigest(before + suffix[:size] + after)
        many = len(members) > 1 or n > 1
        out.append((_signed(h >> 64), _signed(h & (1 << 64) - 1), 2 if many else 1, None if many else members[0], j))
    return out


def sorted_repeats(parts: DataFrame, length: int, block: int) -> DataFrame:
    """(id, t, places): starts of windows that stand elsewhere too, among the blocks that stand for one place.

    ``parts`` has id, t, text and wanted: (first, last, lead, n, pieces) of the blocks to sort, how many places each stands
    for and in how many pieces its group is dealt out."""
    deals = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = stored(_runs(parts, length, deals, block, RUN_SUFFIXES), "runs")
    kind = runs.schema["ids"].dataType.elementType.simpleString()
    size, most = length - block + 1, GROUP

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = list(batch.itertuples())
        at, out = [-1] * len(rows), []
        whole: tuple[list, list] = [], []
        piece: tuple[list, list] = [], []

        def close(group, owners, dealt):
            if dealt or len(group) > 1:
                out.extend((*owners[k], sorted(places), None, None, 0) for k, places in _equal_windows(group, size, block).items())
            if dealt:
                for a, b, n, k, j in _open_windows(group, size, block):
                    out.append((None, None, [], a, b, n) if k is None else (*owners[k], [group[k][4] - j], a, b, n))
            group.clear()
            owners.clear()

        for known, suffix, r in merge([decoded(x.lengths, x.rests) for x in rows]):
            at[r] += 1
            i, x = at[r], rows[r]
            if known < size:
                close(*whole, False)
            if known < size or len(piece[0]) >= most:
                close(*piece, True)
            group, owners = piece if x.pieces[i] > 1 else whole
            group.append((suffix, x.lefts[i], x.firsts[i], x.lasts[i], x.leads[i], x.ns[i]))
            owners.append((x.ids[i], x.ts[i]))
        close(*whole, False)
        close(*piece, True)
        return pd.DataFrame(out, columns=["id", "t", "places", "a", "b", "n"], dtype=object)

    met = stored(runs.groupBy("share").applyInPandas(run, f"id {kind}, t long, places array<long>, a long, b long, n long"), "places")
    dealt = met.filter("a IS NOT NULL")
    several = dealt.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1").select("a", "b")
    hung = dealt.filter("size(places) > 0").join(several, ["a", "b"], "left_semi")
    return met.filter("a IS NULL").select("id", "t", "places").unionByName(hung.select("id", "t", "places"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, starts): for each text, runs (first, last) of places at which a repeated string of ``length`` bytes starts."""
    given = _keyed(docs, id_col, text_col)
    repeated = repeated_contexts(given, length, reach)
    met = stored(occurrences(given, length, reach).join(repeated, "c", "left_semi"), "stretches")
    classes = met.groupBy("c", "f").agg(F.count("*").alias("n"))
    kinds = classes.groupBy("c").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("c")

    several = met.join(classes.filter("n > 1").select("c", "f"), ["c", "f"], "left_semi").select("id", "t", "first", "last")

    apart = met.join(kinds, "c", "left_semi")
    chosen = apart.groupBy("c", "f").agg(F.min(F.struct("id", "t", "first", "last")).alias("r"), F.count("*").alias("n"))
    sides = given.select(F.col("id").alias("i"), F.col("t").alias("h"), "text")

    def with_text(chosen: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
        what = F.struct("r.first", "r.last", *more, "n")
        wanted = chosen.groupBy("r.id", "r.t").agg(F.collect_list(what).alias("wanted"))
        return wanted.join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("h"))).select("id", "t", "text", "wanted")

    parts = stored(with_text(chosen, sides), "parts")
    blocks = stored(_blocks(parts, length, reach, BLOCK), "blocks")
    alike = blocks.groupBy("c", "f").agg(F.sum("n").alias("n"))
    settled = blocks.filter("n = 1").join(alike.filter("n > 1").select("c", "f"), ["c", "f"], "left_semi").select("id", "t", "first", "last")
    kinds = alike.groupBy("c").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("c", F.ceil(F.col("kinds") / GROUP).cast("int").alias("pieces"))
    chosen = blocks.join(kinds, "c").groupBy("c", "f").agg(F.min(F.struct("id", "t", "first", "last", "lead")).alias("r"), F.sum("n").alias("n"), F.first("pieces").alias("pieces"))
    texts = parts.select(F.col("id").alias("i"), F.col("t").alias("h"), "text")
    places = sorted_repeats(with_text(chosen, texts, "r.lead", "pieces"), length, BLOCK).select("id", "t", F.explode("places").alias("first")).withColumn("last", F.col("first"))
    several = several.unionByName(settled)
    return several.unionByName(places.select("id", "t", "first", "last")).groupBy("id", "t").agg(F.collect_list(F.struct("first", "last")).alias("starts"))


def covered(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) of bytes covered by strings that start in ``starts``."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def drop_repeats(docs: DataFrame, length: int = LENGTH, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, spans (begin, end) and kept, the bytes that remain.

    Texts are UTF-8 bytes; null texts are empty. Every byte inside a string of ``length`` bytes that starts at another
    place of any text, or of the same text, goes; strings are judged on the input. Rows that repeat an id and a text
    are places of their own, and ids may be null. A cut may fall inside a character, so ``kept`` is binary. An empty
    table gives no rows; other columns are not read.
    """
    spans = repeated_spans(docs, length, reach, id_col, text_col).select(F.col("id").alias("i"), F.col("t").alias("h"), "starts")
    given = _keyed(docs, id_col, text_col)
    both = given.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("h")), "left").select(F.col("id").alias("doc_id"), "text", "starts")
    fields = StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary")
    kinds = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = _bytes(text)
                cut = covered([(s["first"], s["last"]) for s in starts or ()], length)
                kept, at = [], 0
                for a, b in cut:
                    kept.append(data[at:a])
                    at = b
                rows.append((len(data), sum(b - a for a, b in cut), [{"begin": a, "end": b} for a, b in cut], b"".join([*kept, data[at:]])))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, kinds))], names=["doc_id", *kinds.names])

    return both.mapInArrow(run, StructType([StructField("doc_id", both.schema["doc_id"].dataType), *fields]))
