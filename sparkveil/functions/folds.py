"""Small building blocks on array columns, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def constants(values, type_: str = "string") -> Column:
    """A constant array column; an empty string stands for null."""
    joined = F.split(F.lit("\x1f".join("" if v is None else str(v) for v in values)), "\x1f")
    return joined if type_ == "string" else joined.cast(f"array<{type_}>")


BLOCK = 16


def ordered_fold(items: Column, state: Column, step, out_type: str) -> Column:
    """Walk ``items`` in order with a running state, emitting one value per item.

    ``step(state, item)`` returns ``(next_state, emitted)``, or one struct column
    with the fields ``s`` and ``e`` where both rest on the same work.

    An aggregate copies its accumulator at every step, so a list growing inside
    it would cost the square of its length.  Long arrays are therefore folded in
    blocks of 16, those in blocks of 16 blocks, and so on: every emitted value is
    copied a few times per level, which is close to linear.
    """
    empty = F.array().cast(f"array<{out_type}>")

    def pack(s, out):
        return F.struct(s.alias("s"), out.alias("out"))

    def push(acc, item):
        got = step(acc["s"], item)
        if isinstance(got, tuple):
            return pack(got[0], F.concat(acc["out"], F.array(got[1])))
        return F.aggregate(F.array(got), acc, lambda a, o: pack(o["s"], F.concat(a["out"], F.array(o["e"]))))

    def fold(arr, s, level):
        if level == 0:
            return F.aggregate(arr, pack(s, empty), push)
        size = BLOCK ** level

        def block(acc, off):
            inner = fold(F.slice(arr, off + 1, size), acc["s"], level - 1)
            return F.aggregate(F.array(inner), acc, lambda a, o: pack(o["s"], F.concat(a["out"], o["out"])))

        return F.aggregate(F.sequence(F.lit(0), F.size(arr) - 1, F.lit(size)), pack(s, empty), block)

    return let(items, lambda arr: F.when(F.size(arr) <= BLOCK, fold(arr, state, 0)["out"])
               .otherwise(fold(arr, state, 3)["out"]))


def first_of_runs(sorted_items: Column, same) -> Column:
    """Keep the first item of each run of equal neighbours in a sorted array."""
    return let(
        sorted_items,
        lambda a: F.filter(
            a, lambda x, i: (i == 0) | ~same(F.get(a, F.greatest(i - 1, F.lit(0))), x)
        ),
    )
