"""Debits against a balance, for accounts of any number of events.

The rule is a fold: a debit passes if the balance covers it, a credit always does. Rows are dealt by ranges of (account,
time), so a busy account becomes many slices. What a stretch of events does to a balance is a function with few pieces:
on each piece the balance falls by the same amount. These summaries are made for all stretches at once; a walk over them
gives each slice its opening balance, and then all slices are folded at once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ordered import RANGE, TIE, into_ranges
from .replay import fold_groups

#: Events in a stretch. Its summary is its pieces, or its amounts where those are fewer, so never more numbers than this.
STRETCH = 1024


def _summaries(rows: DataFrame, keys: list[str], order: list[str], stretch: int) -> DataFrame:
    """(keys, range, stretch, lows, falls, amounts) of slices, given with the bounds ``__lo`` and ``__hi`` of their opening balance."""
    sorted_by = [*order, TIE]

    # self-contained: workers need not have this package
    def pieces(amounts, lo, hi):
        import numpy as np

        low, fall = np.array([lo]), np.array([0])
        for a in amounts:
            if a <= 0:
                fall = fall + a
                continue
            high = np.append(low[1:], hi + 1)
            cut = (low - fall < a) & (high - fall > a)
            if cut.any():
                low, fall = np.append(low, a + fall[cut]), np.append(fall, fall[cut])
                at = np.argsort(low, kind="stable")
                low, fall = low[at], fall[at]
            fall = np.where(low - fall >= a, fall + a, fall)
            fresh = np.append(True, fall[1:] != fall[:-1])
            low, fall = low[fresh], fall[fresh]
            if 2 * len(low) > len(amounts):
                return [], [], amounts.tolist()
        return low.tolist(), fall.tolist(), []

    def work(frame):
        frame = frame.sort_values(sorted_by, na_position="first")
        amounts = frame["amount"].fillna(0).to_numpy("int64")
        lo, hi, out = int(frame["__lo"].iloc[0]), int(frame["__hi"].iloc[0]), []
        for n, at in enumerate(range(0, len(amounts), stretch)):
            part = amounts[at:at + stretch]
            out.append([*[frame[k].iloc[0] for k in keys], frame[range_col].iloc[0], n, *pieces(part, lo, hi)])
            hi += int(-part[part < 0].sum())
        return pd.DataFrame(out, columns=names)

    range_col = RANGE
    names = [*keys, RANGE, "stretch", "lows", "falls", "amounts"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = ", ".join([*[f"`{k}` {kinds[k]}" for k in [*keys, RANGE]], "stretch int, lows array<bigint>, falls array<bigint>, amounts array<bigint>"])
    return rows.select(*keys, RANGE, *sorted_by, "amount", "__lo", "__hi").groupBy(*keys, RANGE).applyInPandas(work, shape)


def _walk(summaries: DataFrame, keys: list[str], opening: str) -> DataFrame:
    """The balance with which each slice opens. A task reads its accounts' summaries one batch after the other."""
    import pyarrow as pa

    ordered = summaries.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, RANGE, "stretch")
    ordered = ordered.select(*keys, RANGE, "lows", "falls", "amounts", opening)
    n = len(keys)

    def run(batches):
        import bisect

        account, place, balance = None, None, 0
        for batch in batches:
            who = list(zip(*[batch.column(i).to_pylist() for i in range(n)]))
            where, lows, falls, amounts, start = (batch.column(n + i).to_pylist() for i in range(5))
            rows, states = [], []
            for i, key in enumerate(who):
                if key != account:
                    account, place, balance = key, None, start[i]
                if where[i] != place:
                    place = where[i]
                    rows.append(i)
                    states.append(balance)
                if lows[i]:
                    balance -= falls[i][bisect.bisect_right(lows[i], balance) - 1]
                for a in amounts[i]:
                    if a <= balance or a <= 0:
                        balance -= a
            kept = batch.select(list(range(n + 1))).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(states, pa.int64())], names=[*kept.schema.names, "__state"])

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    return ordered.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in [*keys, RANGE]] + ["__state bigint"]))


def admit(events: DataFrame, keys: list[str], order: list[str], opening: str, always: Column, ranges: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """Events with ``admitted`` and ``balance_after``, for each account in the order of ``order``.

    ``amount`` > 0 is a debit, < 0 a credit; null changes nothing and its outcome is null. ``opening`` is the column of
    the opening balance, one of ``keys`` (null counts as 0); accounts for which ``always`` holds pass every debit and
    have no balance. Null keys are an account of their own, null times come first.
    """
    keys = list(keys)
    start = F.coalesce(F.col(opening).cast("bigint"), F.lit(0))
    rows = into_ranges(events.withColumn("__always", always), [*keys, *order], ranges)
    credit = F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0))
    slices = rows.filter("NOT __always").groupBy(RANGE, *keys).agg(credit.alias("__credit"))
    line = Window.partitionBy(*keys)
    before = line.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumns({"__of": F.count("*").over(line), "__hi": F.greatest(start, F.lit(0)) + F.coalesce(F.sum("__credit").over(before), F.lit(0)),
                                 "__lo": F.least(start, F.lit(0))})
    # of the accounts in a range only the first and the last can reach into others: two rows for each range at most
    wide = written(slices.filter("__of > 1").select(RANGE, *keys, "__lo", "__hi"), "slices")

    def matched(left, right, how):
        named = right.select(F.col(RANGE).alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in (RANGE, *keys)])
        same = reduce(and_, [left[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], left[RANGE] == F.col("__r"))
        return left.join(F.broadcast(named), same, how).drop("__r", *[f"__k{i}" for i in range(len(keys))])

    summaries = _summaries(matched(rows, wide, "inner"), keys, order, stretch)
    opened = written(_walk(summaries.withColumn("__start", start), keys, "__start"), "opened")
    placed = matched(rows, opened, "left")

    def step(balance, r):
        amount = r["amount"].cast("bigint")
        ok = r["__always"] | (amount <= 0) | (balance >= amount)
        after = F.when(ok & ~r["__always"], balance - amount).otherwise(balance)
        return F.struct(after.alias("s"), F.struct(
            ok.alias("admitted"), F.when(~r["__always"] & amount.isNotNull(), after).alias("balance_after")).alias("e"))

    out = fold_groups(placed, [*keys, RANGE], [*order, TIE], start, step, "bigint", "struct<admitted:boolean,balance_after:bigint>")
    return out.select(*events.columns, "report.*")
