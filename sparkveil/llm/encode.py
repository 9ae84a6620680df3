"""Token ids of a public tokenizer file, cached by white-space run inside each Python worker.

The tokenizer drops white space and never joins what it separates, so the ids of a text are the ids of its runs one
after another. Runs of plain Latin letters, digits and punctuation are cut by the file's own split pattern and their
pieces are encoded by the file's own model, once each; every other run goes through the whole library.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from .shared import blocks

#: Entries in each of the two generations of a worker's caches. A full younger one becomes the older, whose entries are
#: taken over when they are met again; some 200 bytes an entry, four generations in all.
CACHE_ENTRIES = 250_000
#: Runs longer than this are encoded but never cached.
CACHE_RUN_BYTES = 64

_PLAIN = regex.compile(r"[\x21-\x7eÀ-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest follows at 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Cache:
    """Two generations of entries, of bounded number."""

    def __init__(self, most: int = CACHE_ENTRIES):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Ids of runs as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        first = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        lower = any(n.get("type") == "Lowercase" for n in (parts.get("normalizer") or {}).get("normalizers", []))
        self.special = tuple(t["content"].lower() for t in parts.get("added_tokens", []))
        if not lower or first.get("type") != "Split" or first.get("behavior") != "Removed":
            raise ValueError("expected a lower-casing tokenizer that drops white space")
        self.split = regex.compile(first["pattern"]["Regex"])
        self.letters = byte_letters()
        self.runs, self.pieces = Cache(), Cache()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            got = np.array([t.id for t in self.library.model.tokenize(shown)], "<u4").tobytes()
            self.pieces.put(piece, got)
        return got

    def run(self, run: bytes) -> bytes:
        """Ids of one white-space run."""
        known = self.runs.get(run)
        if known is not None:
            return known
        text = run.decode("utf-8", "surrogatepass")
        low = text.lower()
        if _PLAIN.fullmatch(text) and not any(s in low for s in self.special):
            got = b"".join(map(self._piece, self.split.findall(low)))
        else:
            ids = self.library.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
            got = np.array(ids, "<u4").tobytes()
        if len(run) <= CACHE_RUN_BYTES:
            self.runs.put(run, got)
        return got

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; null and empty texts have none."""
        out = bytearray()
        for block in blocks((text or "").encode("utf-8", "surrogatepass")):
            runs = block.split()
            got = list(map(self.runs.young.get, runs))
            if None in got:
                got = [self.run(r) if g is None else g for r, g in zip(runs, got)]
            out += b"".join(got)
        return bytes(out)


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, and so one cache, for each worker process and file."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
