"""Sorted runs of byte strings, front-coded, and their merge by a loser tree that knows common prefixes.

Bingmann, Sanders and Schimek, "Communication-Efficient String Sorting" (2020). A run is sorted; each string is stored as
the length of its common prefix with the one before and the bytes after it. In the tree every contender carries its
common prefix with the string that was put out last: the longer one is the smaller string, and only on a tie are bytes
compared, from the end of the known prefix on.
"""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree on the first ``known`` bytes."""
    most = min(len(a), len(b))
    while known < most:
        step = min(64, most - known)
        x, y = a[known: known + step], b[known: known + step]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return known + step - (differ.bit_length() + 7) // 8
        known += step
    return most


def front_coded(ordered: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefixes with the string before, and what follows them."""
    lengths, rests, last = [], [], b""
    for s in ordered:
        n = common_prefix(last, s)
        lengths.append(n)
        rests.append(s[n:])
        last = s
    return lengths, rests


def decoded(lengths, rests) -> Iterator[tuple[int, bytes]]:
    last = b""
    for n, rest in zip(lengths, rests):
        last = last[:n] + rest
        yield n, last


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """(common prefix with the string put out before, string, run) of all runs in order."""
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    heads: list[bytes | None] = [None] * k
    known = [0] * k
    for i, run in enumerate(runs):
        first = next(run, None)
        if first is not None:
            known[i], heads[i] = 0, first[1]

    def loser(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    tree = [0] * k
    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            win, lose = loser(level[i], level[i + 1])
            tree[node + i // 2] = lose
            up.append(win)
        level = up
    win = level[0]
    while heads[win] is not None:
        yield known[win], heads[win], win
        following = next(runs[win], None) if win < len(runs) else None
        if following is None:
            heads[win] = None
        else:
            known[win], heads[win] = following
        at = (win + k) // 2
        while at:
            win, tree[at] = loser(win, tree[at])
            at //= 2
