"""One pass over a text for many strings, for texts that hold more of them than a native fold should walk through.

Each maker returns an Arrow-batched function. The functions are self-contained, so that workers need not have this
package, and get a null for every text that the native form serves, with ``lists_of`` empty lists beside it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many strings of one text are handled by native expressions, which look at the text once for each.
FEW = 24


def lists_of(kind: str, items: Column, many: Column) -> Column:
    """``items`` of the rows that an Arrow-batched function serves, and an empty list, not a null, in all others.

    For each row that joins an Arrow batch Spark asks for the size of the batch, and a list column answers by walking back
    over all nulls since its last list: a run of nulls would cost the square of its length, up to a whole batch.
    """
    return F.coalesce(F.when(many, items), F.array().cast(f"array<{kind}>"))


def _finder():
    """A function that, inside a worker, makes find(text, exact, loose).

    It yields (start, length, string, in any case, meaning) of every place of every string; ``exact`` and ``loose``, which
    is looked for in any case, are pairs of a string and what it stands for, the first of equal strings counts.
    """
    def make():
        import ahocorasick

        def fold(s):
            low = s.upper().lower()
            if len(low) == len(s):
                return low
            return "".join(x if len(x := c.upper().lower()) == 1 else c for c in s)

        def find(text, exact, loose):
            for strings, any_case in ((exact, False), (loose, True)):
                machine = ahocorasick.Automaton()
                for v, meant in strings:
                    key = fold(v) if any_case else v
                    if key and not machine.exists(key):
                        machine.add_word(key, (len(key), v, meant))
                if len(machine):
                    machine.make_automaton()
                    for end, (n, v, meant) in machine.iter(fold(text) if any_case else text):
                        yield end + 1 - n, n, v, any_case, meant

        return find

    return make


def mask_many(block: str):
    """Column function (text, exact strings, caseless strings): all their places blanked, the longest string first."""
    make = _finder()

    @F.pandas_udf("string")
    def run(texts: pd.Series, exact: pd.Series, loose: pd.Series) -> pd.Series:
        import re

        find = make()

        def one(text, a, b):
            if text is None:
                return None
            taken = bytearray(len(text))
            places = find(text, [(v, None) for v in a], [(v, None) for v in b])
            for start, n, _, _, _ in sorted(places, key=lambda m: (-m[1], m[2], m[3], m[0])):
                if taken.find(1, start, start + n) < 0:
                    taken[start:start + n] = b"\1" * n
            out, at = [], 0
            for run in re.finditer(rb"\x01+", taken):
                out += text[at:run.start()], block * (run.end() - run.start())
                at = run.end()
            return "".join(out) + text[at:]

        return pd.Series([one(*row) for row in zip(texts, exact, loose)], dtype=object)

    return run


def cut_many(mark: str, end: str):
    """Column function (text, exact strings, their types, caseless strings, their types): each place as mark, string, end,
    type, end.

    From left to right, the longest string that begins at a place, as an ordered alternation of all would find them.
    """
    make = _finder()

    @F.pandas_udf("string")
    def run(texts: pd.Series, exact: pd.Series, types: pd.Series, loose: pd.Series, kinds: pd.Series) -> pd.Series:
        find = make()

        def one(text, a, a_types, b, b_types):
            if text is None:
                return None
            longest = {}
            for start, n, v, _, kind in find(text, zip(a, a_types), zip(b, b_types)):
                longest[start] = min((-n, v, kind), longest.get(start, (0, "", "")))
            out, at = [], 0
            for start in sorted(longest):
                if start >= at:
                    n, _, kind = longest[start]
                    out += text[at:start], mark, text[start:start - n], end, kind, end
                    at = start - n
            return "".join(out) + text[at:]

        return pd.Series([one(*row) for row in zip(texts, exact, types, loose, kinds)], dtype=object)

    return run


def blank_many(block: str):
    """Column function (text, starts, ends): the spans blanked, overlaps merged."""
    @F.pandas_udf("string")
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        def one(text, a, b):
            if text is None:
                return None
            out, at = [], 0
            for start, end in sorted(zip(a, b)):
                start, end = max(start, at), min(max(end, at), len(text))
                out += text[at:start], block * (end - start)
                at = max(end, start)
            return "".join(out) + text[at:]

        return pd.Series([one(*row) for row in zip(texts, starts, ends)], dtype=object)

    return run


def put_many(left: str, right: str):
    """Column function (text, tokens, plain texts): each marked token that is known gives way to its plain text."""
    @F.pandas_udf("string")
    def run(texts: pd.Series, tokens: pd.Series, plains: pd.Series) -> pd.Series:
        def one(text, a, b):
            if text is None:
                return None
            known, (head, *pieces) = dict(zip(a, b)), text.split(left)
            out = [head]
            for piece in pieces:
                token, mark, rest = piece.partition(right)
                plain = known.get(token) if mark else None
                out += (left, piece) if plain is None else (plain, rest)
            return "".join(out)

        return pd.Series([one(*row) for row in zip(texts, tokens, plains)], dtype=object)

    return run
