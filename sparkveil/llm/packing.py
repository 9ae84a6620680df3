"""Sum-of-squares online packing of token sequences into windows of one size.

Csirik, Johnson, Kenyon, Orlin, Shor and Weber, "On the sum-of-squares algorithm for bin packing" (2006): each item goes
to the fill level for which the sum of squared counts of partially filled bins becomes least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder

#: Windows that a task may have open at once; beyond it they are closed by cutting. Bounds memory at 4 bytes an id.
OPEN_WINDOWS = 8_192
_ROWS = 2_000
_BYTES = 16 << 20

#: (doc_id, start, ids, doc_tokens)
Piece = tuple[object, int, bytes, int]


class Packer:
    """Windows under construction, by fill level. ``count[h]``: open windows that hold h ids."""

    def __init__(self, size: int, most: int = OPEN_WINDOWS):
        self.size, self.most, self.open = size, most, 0
        self.count = np.zeros(size + 1, np.int64)
        self.level: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def best(self, s: int) -> int:
        """The fill level to put ``s`` ids at; ties go to the fullest window."""
        n, top = self.count, self.size - s
        cost = 2 * (n[s:] - n[: top + 1] + 1)
        cost[top] = 1 - 2 * n[top]  # a full window counts no longer
        cost[n[: top + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * n[s] + 1
        return int(top - np.argmin(cost[::-1]))

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Put a piece in; full windows come out."""
        s = len(piece[2]) // 4
        if s == self.size:
            yield [piece]
            return
        h = self.best(s)
        if h:
            window = self.level[h].pop()
            self.count[h] -= 1
        else:
            window = []
            self.open += 1
        window.append(piece)
        if h + s == self.size:
            self.open -= 1
            yield window
        else:
            self.level[h + s].append(window)
            self.count[h + s] += 1
        if self.open > self.most:
            yield from self.drain()

    def drain(self, last: bool = False) -> Iterator[list[Piece]]:
        """Fill the fullest open windows from the emptiest, cutting pieces at window ends. One window at most stays open;
        with ``last`` it comes out too."""
        windows = [(h, w) for h in range(self.size, 0, -1) for w in self.level[h]]
        self.count[:] = 0
        self.level = [[] for _ in range(self.size + 1)]
        self.open = 0
        i, j = 0, len(windows) - 1
        fill = windows[0][0] if windows else 0
        while i < j:
            window, give = windows[i][1], windows[j][1]
            doc, start, ids, total = give.pop()
            room = self.size - fill
            window.append((doc, start, ids[: 4 * room], total))
            if len(ids) > 4 * room:
                give.append((doc, start + room, ids[4 * room:], total))
            fill += min(room, len(ids) // 4)
            if not give:
                j -= 1
            if fill == self.size:
                yield window
                i += 1
                fill = sum(len(p[2]) // 4 for p in windows[i][1]) if i <= j else 0
        if i == j and windows[i][1]:
            window = windows[i][1]
            fill = sum(len(p[2]) // 4 for p in window)
            if last or fill == self.size:
                yield window
            else:
                self.level[fill].append(window)
                self.count[fill], self.open = 1, 1


def pieces_of(doc: object, ids: bytes, size: int) -> Iterator[Piece]:
    """A document cut at multiples of the window size."""
    total = len(ids) // 4
    for start in range(0, total, size):
        yield doc, start, ids[4 * start: 4 * (start + size)], total


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each task packs the documents of its partition as they come and keeps the ids of open windows only, so nothing is
    shuffled and no group of rows can be too large. Whole windows are cut from long documents, what is left is placed by
    the sum-of-squares rule. At the end, or beyond ``open_windows``, open windows are filled from each other by cutting,
    so at most one window of a partition has padding. ``sequence_id`` holds the partition's number above bit 33.
    A task that runs again on the same partition gives the same rows.

    Null and empty texts are the end id alone (with ``end_id=None`` they give no row). Repeated rows are packed one by
    one; an empty table gives no rows; other columns are not read.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = given.schema["doc_id"].dataType
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, packer, rows, held = encoder(path), Packer(window, open_windows), [], 0
        number, id_type = TaskContext.get().partitionId() << 33, pa.int64()

        def batch_of(rows):
            cols = list(zip(*rows))
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def numbered(windows):
            nonlocal number, held
            for done in windows:
                offset = 0
                for doc, start, ids, total in done:
                    rows.append((doc, start, len(ids) // 4, ids, total, number, offset))
                    offset += len(ids) // 4
                    held += len(ids)
                number += 1

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in pieces_of(doc, enc.ids(text) + end, window):
                    numbered(packer.place(piece))
                    if len(rows) >= _ROWS or held >= _BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
        numbered(packer.drain(last=True))
        for at in range(0, len(rows), _ROWS):
            yield batch_of(rows[at: at + _ROWS])

    return given.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
