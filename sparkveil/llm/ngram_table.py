"""Words and n-grams of many texts at once, interned in open-addressed numpy tables under xxhash64 keys."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Words longer than this are hashed and compared one by one.
LONG_WORD = 64
#: Bytes of text that are tabled together; a longer text is cut between words, with the words before the cut carried on.
CHUNK = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_GAP = np.flatnonzero(~_WORD)


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(x):
    return _rotl(x * P2, 31) * P1


def xxhash64(rows: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of each row of a matrix of bytes."""
    n, size = rows.shape
    at = 0
    with np.errstate(over="ignore"):
        def word(kind, width):
            return np.ascontiguousarray(rows[:, at:at + width]).view(kind)[:, 0].astype(np.uint64)

        if size >= 32:
            v = [np.full(n, s, np.uint64) for s in (P1 + P2, P2, np.uint64(0), np.uint64(0) - P1)]
            while at + 32 <= size:
                for i in range(4):
                    v[i] = _rotl(v[i] + word("<u8", 8) * P2, 31) * P1
                    at += 8
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _lane(x)) * P1 + P4
        else:
            acc = np.full(n, P5, np.uint64)
        acc = acc + np.uint64(size)
        while at + 8 <= size:
            acc = _rotl(acc ^ _lane(word("<u8", 8)), 27) * P1 + P4
            at += 8
        if at + 4 <= size:
            acc = _rotl(acc ^ (word("<u4", 4) * P1), 23) * P2 + P3
            at += 4
        while at < size:
            acc = _rotl(acc ^ (rows[:, at].astype(np.uint64) * P5), 11) * P1
            at += 1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        return acc ^ (acc >> np.uint64(32))


class Table:
    """An open-addressed table of occurrences: a slot holds the occurrence that claimed it, its bucket and its count.

    An occurrence belongs to the slot whose key and bytes are its own; on another's slot it goes on to the next.
    """

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        n = len(keys)
        size = 1 << max(1, int(2 * n - 1).bit_length()) if n else 2
        mask = np.uint64(size - 1)
        self.owner = np.full(size, -1, np.int64)
        self.slot = np.zeros(n, np.int64)
        at, waiting = (keys & mask).astype(np.int64), np.arange(n)
        while waiting.size:
            place = at[waiting]
            free = self.owner[place] < 0
            self.owner[place[free]] = waiting[free]
            held = self.owner[place]
            same = keys[held] == keys[waiting]
            same[same] = (rows[held[same]] == rows[waiting[same]]).all(axis=1)
            self.slot[waiting[same]] = place[same]
            waiting = waiting[~same]
            at[waiting] = (at[waiting] + 1) & (size - 1)
        self.used = np.flatnonzero(self.owner >= 0)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)


def _shift_tables() -> np.ndarray:
    """[length][byte of the checksum][value]: what a CRC-32 becomes when so many zero bytes follow; linear, so by bytes."""
    one = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
    out = np.zeros((LONG_WORD + 2, 4, 256), np.uint32)
    for b in range(4):
        out[0, b] = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
    for k in range(1, LONG_WORD + 2):
        out[k] = one[out[k - 1] & 255] ^ (out[k - 1] >> np.uint32(8))
    return out


_SHIFT = _shift_tables()


def followed(crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after the other, from those of each and the length of the second."""
    out, left = crc, length
    while True:
        step = np.minimum(left, LONG_WORD + 1)
        out = _SHIFT[step, 0, out & 255] ^ _SHIFT[step, 1, (out >> 8) & 255] ^ _SHIFT[step, 2, (out >> 16) & 255] ^ _SHIFT[step, 3, out >> 24]
        left = left - step
        if not left.any():
            return out ^ more


class Grams:
    """All runs of 1 to 3 words of a chunk: ``tables`` by length, ``piece`` of each occurrence, words of each piece."""

    def __init__(self, pieces: list[tuple[bytes, int]], buckets: int):
        """``pieces`` are lower-cased texts, and the words at their start that an earlier piece has counted."""
        data = np.frombuffer(b"\n".join(p for p, _ in pieces), np.uint8)
        starts = np.cumsum([0, *[len(p) + 1 for p, _ in pieces]])[:-1]
        inside = np.concatenate(([False], _WORD[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, length = edges[::2], edges[1::2] - edges[::2]
        piece = np.searchsorted(starts, begin, "right") - 1
        first = np.searchsorted(piece, np.arange(len(pieces)))
        fresh = np.arange(len(begin)) - first[piece] >= np.array([c for _, c in pieces], np.int64)[piece]
        word, crc, spaced, width = self._words(data, begin, length)

        self.tables, self.pieces = [], []
        self.words = np.bincount(piece[fresh], minlength=len(pieces))
        for n in (1, 2, 3):
            last = np.arange(n - 1, len(begin))
            last = last[(piece[last] == piece[last - n + 1]) & fresh[last]]
            ids = np.stack([word[last - k] for k in range(n - 1, -1, -1)], axis=1) if len(last) else np.zeros((0, n), "<u4")
            table = Table(xxhash64(np.ascontiguousarray(ids).view(np.uint8).reshape(len(last), 4 * n)), ids)
            held = ids[table.owner[table.used]]
            total = crc[held[:, 0]]
            for k in range(1, n):
                total = followed(total, spaced[held[:, k]], width[held[:, k]] + 1)
            table.bucket[table.used] = total % np.uint32(buckets)
            self.tables.append(table)
            self.pieces.append(piece[last])

    def _words(self, data, begin, length):
        """Number of each word, and for each number: CRC-32 of the word, of the word after a space, its length."""
        word = np.zeros(len(begin), "<u4")
        crc, spaced, width, n = [], [], [], 0
        order = np.argsort(length, kind="stable")
        ends = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, ends) if len(order) else []:
            size = int(length[group[0]])
            if size <= LONG_WORD:
                rows = data[begin[group][:, None] + np.arange(size)]
                table = Table(xxhash64(rows), rows)
                number = np.zeros(len(table.owner), np.int64)
                number[table.used] = np.arange(n, n + len(table.used))
                word[group] = number[table.slot]
                kept = [rows[i].tobytes() for i in table.owner[table.used]]
            else:
                known: dict[tuple[int, bytes], int] = {}
                for i in group:
                    text = data[begin[i]:begin[i] + size].tobytes()
                    word[i] = known.setdefault((xxhash.xxh64_intdigest(text), text), n + len(known))
                kept = [text for _, text in known]
            crc += map(zlib.crc32, kept)
            spaced += [zlib.crc32(w, _SPACE) for w in kept]
            width += [size] * len(kept)
            n += len(kept)
        return word, np.array(crc, np.uint32), np.array(spaced, np.uint32), np.array(width, np.int64)


_SPACE = zlib.crc32(b" ")


def _cut(data: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of about CHUNK bytes, none inside a word; a piece begins with the two words before it."""
    at, carried = 0, b""
    while True:
        end = len(data)
        if end - at > CHUNK:
            end = at + CHUNK
            while end < len(data) and _WORD[data[end]]:
                near = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - end), end)
                gaps = np.flatnonzero(~_WORD[near])
                end += int(gaps[0]) if len(gaps) else len(near)
        piece = carried + data[at:end]
        yield piece, len(carried.split())
        if end >= len(data):
            return
        carried, at = _last_words(piece), end


def _last_words(piece: bytes) -> bytes:
    """The last two words and a space after each."""
    inside = np.concatenate(([False], _WORD[np.frombuffer(piece, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return b"".join(piece[edges[k]:edges[k + 1]] + b" " for k in range(max(0, len(edges) - 4), len(edges), 2))


def chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[tuple[bytes, int]]]]:
    """(places of the texts, pieces) of about CHUNK bytes; null is empty. A long text appears in several chunks."""
    places, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _cut((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
            places.append(i)
            pieces.append(piece)
            size += len(piece[0]) + 1
            if size >= CHUNK:
                yield places, pieces
                places, pieces, size = [], [], 0
    if pieces:
        yield places, pieces
