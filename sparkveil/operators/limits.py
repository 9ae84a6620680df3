"""Request-rate rules over event tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import let
from .ordered import RANGE, TIE, into_ranges
from .replay import SLICE_ROWS, replay


def cut_at_gaps(events: DataFrame, keys, ts: str, order: str, window: float, out="__segment", ranges: int | None = None) -> DataFrame:
    """Name the stretches of a key's requests between pauses of a whole window or more, by the time at which they begin.

    After such a pause nothing admitted before still counts and a counter's window has passed, so stretches are
    independent of one another and a busy key becomes many groups.  The rows are dealt by ranges of (key, time), so no
    task sees all of a key: what a range inherits is the last stretch begun before it, one row for each range at most.
    """
    keys, limit = list(keys), F.lit(int(window * 1_000_000))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = into_ranges(events.withColumn("__at", at), [*keys, ts, order], ranges)
    inside = Window.partitionBy(RANGE, *keys).orderBy(ts, order, TIE)
    began = F.when(F.col("__at") - F.lag("__at").over(inside) >= limit, F.col("__at"))
    rows = rows.withColumn("__began", began)
    facts = rows.groupBy(RANGE, *keys).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.max("__began").alias("__start"))
    line = Window.partitionBy(*keys).orderBy(RANGE)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    jump = F.col("__first") - F.max("__last").over(before) >= limit
    facts = facts.withColumn("__jump", F.when(jump, F.col("__first")))
    facts = facts.withColumn("__entry", F.coalesce("__jump", F.max(F.coalesce("__start", "__jump")).over(before)))
    inherited = facts.filter("__entry IS NOT NULL").select(
        F.col(RANGE).alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__entry")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col(RANGE) == F.col("__r"))
    placed = rows.join(F.broadcast(inherited), same, "left")
    whole = Window.partitionBy(RANGE, *keys).orderBy(ts, order, TIE).rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.max("__began").over(whole), F.col("__entry"), F.lit(-(2 ** 62)))
    return placed.withColumn(out, start).select(*events.columns, out)


def rate_limit(events: DataFrame, most: int, window: float, keys=("endpoint", "client"), ts="ts",
               order="event_id", slice_rows=SLICE_ROWS) -> DataFrame:
    """Exact limiter: a request passes while fewer than ``most`` admitted ones
    lie within the last ``window`` seconds; refused ones do not count."""
    limit = F.lit(int(window * 1_000_000))

    def step(times, r):
        now = F.unix_micros(r[ts].cast("timestamp"))
        live = F.filter(times, lambda t: now - t < limit)
        return let(live, lambda x: F.struct(
            F.when(F.size(x) < most, F.concat(x, F.array(now))).otherwise(x).alias("s"),
            (F.size(x) < most).alias("e")))

    cut = cut_at_gaps(events, keys, ts, order, window)
    out = replay(cut, [*keys, "__segment"], ts, [ts, order], F.array().cast("array<bigint>"), step,
                 "array<bigint>", "boolean", slice_rows)
    return out.withColumnRenamed("report", "admitted").drop("__segment")


def rate_limit_counter(events: DataFrame, most: int, window: float, keys=("endpoint", "client"), ts="ts",
                       order="event_id", slice_rows=SLICE_ROWS) -> DataFrame:
    """Counter limiter: the window opens at a key's first request, every request
    counts, and those beyond ``most`` are refused until the window has passed."""
    limit = F.lit(int(window * 1_000_000))
    state = "struct<opened:bigint,n:int>"

    def step(s, r):
        now = F.unix_micros(r[ts].cast("timestamp"))
        fresh = (s["n"] == 0) | (now - s["opened"] >= limit)
        n = F.when(fresh, 1).otherwise(s["n"] + 1)
        nxt = F.struct(F.when(fresh, now).otherwise(s["opened"]).alias("opened"), n.alias("n"))
        return F.struct(nxt.alias("s"), (n <= most).alias("e"))

    cut = cut_at_gaps(events, keys, ts, order, window)
    out = replay(cut, [*keys, "__segment"], ts, [ts, order], F.struct(F.lit(0).cast("bigint").alias("opened"), F.lit(0).alias("n")),
                 step, state, "boolean", slice_rows)
    return out.withColumnRenamed("report", "admitted").drop("__segment")


def rate_screen(events: DataFrame, most: int, window: int, keys=("endpoint", "client"), ts="ts") -> DataFrame:
    """Screening: requests in the last ``window`` seconds, all counted, per request.

    Time is cut into windows of that length.  A request's window and the one
    before hold everything it can see, so rows are copied once into the next
    window and counted inside (key, window): a hot key spreads over its windows.
    """
    span = window * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.withColumns({"__at": at, "__cell": F.floor(at / span)})
    both = rows.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False))))
    both = both.withColumn("__cell", F.when(F.col("__own"), F.col("__cell")).otherwise(F.col("__cell") + 1))
    near = Window.partitionBy(*keys, "__cell").orderBy("__at").rangeBetween(-(span - 1), 0)
    seen = both.withColumn("recent", F.count("*").over(near)).filter("__own")
    return seen.drop("__at", "__cell", "__own").withColumn("suspect", F.col("recent") > most)
