"""Numbers and running sums over sorted rows, spread over all tasks whatever the keys hold.

Rows are dealt by ranges of (keys, order), so that a key, and even one instant of a key, may span many ranges. Sums per
range and key are small; their running sums give each range what came before it, and a window inside (range, key) adds
the rest.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

RANGE, TIE = "__range", "__tie"


def into_ranges(df: DataFrame, by: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``by`` (nulls first), with the number of the range and a tie-break for equal rows.

    Range bounds come from a sample, which another branch of a plan would draw anew. The rows are therefore written to
    the shared folder, a file for each range, and read back: every use sees the same ranges, also after a lost executor.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(TIE, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(ranges, *[F.col(c) for c in by], F.col(TIE)).withColumn(RANGE, F.spark_partition_id())
    return written(rows, "ranges")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict, ranges: int | None = None) -> DataFrame:
    """Add running sums of ``sums`` (name to column; sums skip nulls) for each key in the order of ``order``.

    Rows of equal order come one after the other, in any order. Null keys are a key of their own, null places in the
    order come first. At most one key of a range began before it, so what is carried in has a row for each range at most.
    """
    keys, names = list(keys), list(sums)
    given = df.withColumns({f"__v_{n}": c for n, c in sums.items()})
    rows = into_ranges(given, [*keys, *order], ranges)
    totals = rows.groupBy(RANGE, *keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col(RANGE).alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in names], F.count("*").over(before).alias("__seen"))
    carried = carried.filter("__seen > 0").drop("__seen")
    # one row for each range at most
    out = rows.join(F.broadcast(carried), F.col(RANGE) == F.col("__r"), "left")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__r").isNotNull())
    inside = Window.partitionBy(RANGE, *keys).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, 0)

    def total(n):
        own, earlier = F.sum(f"__v_{n}").over(inside), F.when(same, F.col(f"__o_{n}"))
        return F.when(own.isNull() & earlier.isNull(), None).otherwise(
            F.coalesce(own, F.lit(0)) + F.coalesce(earlier, F.lit(0)))

    return out.withColumns({n: total(n) for n in names}).select(*[c for c in df.columns if c not in sums], *names)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, first: int = 0, ranges: int | None = None) -> DataFrame:
    """Number the rows of each key in the order of ``order``, without gaps, from ``first``."""
    rows = running_sums(df.drop(out), keys, order, {out: F.lit(1).cast("bigint")}, ranges)
    return rows.withColumn(out, F.col(out) + (first - 1))


def stretch(df: DataFrame, order: list[str], start: int, rows: int, ranges: int | None = None) -> DataFrame:
    """Rows ``start`` to ``start + rows`` - 1 of the sorted table, counted from 0.

    ``df`` may come out of ``into_ranges`` (by the same order) already; then nothing moves but the ranges that hold the
    stretch. Their numbers come from one count for each range.
    """
    placed = df if RANGE in df.columns else into_ranges(df, order, ranges)
    seen, wanted, offsets = 0, [], []
    for r in placed.groupBy(RANGE).count().orderBy(RANGE).collect():  # one row for each range
        if seen < start + rows and seen + r["count"] > start:
            wanted.append(r[RANGE])
            offsets.append(seen)
        seen += r["count"]
    if not wanted:
        return placed.limit(0).drop(RANGE, TIE)
    inside = Window.partitionBy(RANGE).orderBy(*order, TIE)
    part = placed.filter(F.col(RANGE).isin(wanted))
    base = reduce(lambda c, w: c.when(F.col(RANGE) == w[0], w[1]), zip(wanted, offsets), F)
    at = F.row_number().over(inside) - 1 + base
    return part.withColumn("__at", at).filter(F.col("__at").between(start, start + rows - 1)).drop("__at", RANGE, TIE)
