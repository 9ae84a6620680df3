"""Order-dependent rules per key: each row's outcome depends on all before it.

The rule runs as a native fold over a key's rows in time order.  A key with few
rows is folded in one group.  For keys with many, time is cut into slices of a
bounded number of rows and the slices are replayed one after the other with the
state carried in a table, so no task ever holds more than a slice of a key.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import let, ordered_fold
from ..sources.scratch import scratch_path

SLICE_ROWS = 50_000


def _fold(rows: DataFrame, keys, order, state0: Column, step, state_type, report_type) -> DataFrame:
    """(keys, e) with e = the row, what is reported with it, and the state after it."""
    cols = [c for c in rows.columns if c not in keys and c != "__state"]
    packed = F.struct(*order, *[c for c in cols if c not in order])
    row_type = rows.select(packed.alias("r")).schema["r"].dataType.simpleString()
    groups = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(packed)).alias("__rows"), F.first("__state", True).alias("__state"))

    def wrapped(s, r):
        return let(step(s, r), lambda o: F.struct(
            o["s"].cast(state_type).alias("s"),
            F.struct(o["s"].cast(state_type).alias("next"), o["e"].cast(report_type).alias("report"),
                     r.alias("row")).alias("e")))

    start = F.coalesce(F.col("__state"), state0.cast(state_type))
    emit = f"struct<next:{state_type},report:{report_type},row:{row_type}>"
    return groups.select(*keys, F.explode_outer(ordered_fold(F.col("__rows"), start, wrapped, emit)).alias("e"))


def fold_groups(rows: DataFrame, keys, order, state0: Column, step, state_type, report_type) -> DataFrame:
    """``rows`` with ``report``, each group of ``keys`` folded on its own from ``__state``, or ``state0`` where that is null."""
    folded = _fold(rows, list(keys), order, state0, step, state_type, report_type)
    return folded.select(*keys, "e.row.*", F.col("e.report").alias("report"))


def _join_same(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """Join on ``keys`` where nulls are equal, keeping the left side's keys."""
    named = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [left[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"__k{i}" for i in range(len(keys))])


def replay(events: DataFrame, keys: list[str], ts: str, order: list[str], state0: Column, step,
           state_type: str, report_type: str, slice_rows: int = SLICE_ROWS, bucket_seconds: int = 1) -> DataFrame:
    """Rows of ``events`` with the outcome of the rule in ``report``.

    ``step(state, row)`` returns a struct of ``s``, the next state, and ``e``, the
    report; ``state0`` may use ``keys``.  ``order`` starts with the time column ``ts`` and must be unique
    within a key.  Rows without a time come first; rows without a key are a key of their own.
    """
    keys = list(keys)
    none = F.lit(None).cast(state_type)

    def shown(folded):
        return folded.select(*keys, "e.row.*", F.col("e.report").alias("report"))

    largest = events.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= slice_rows:
        return shown(_fold(events.withColumn("__state", none), keys, order, state0, step, state_type, report_type))

    spark = events.sparkSession
    root = scratch_path(spark, f"replay-{uuid.uuid4().hex}")
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / bucket_seconds)
    counted = events.groupBy(*keys, bucket.alias("__b")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b"))
    blocks = counted.withColumn("__block", F.floor((upto - 1) / slice_rows))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("__block")) - 1
    slices = blocks.select(*keys, "__b", number.alias("__slice"))
    placed = _join_same(events.withColumn("__b", bucket), slices, [*keys, "__b"], "inner").drop("__b")
    placed.write.partitionBy("__slice").parquet(f"{root}/in")
    rows = spark.read.schema(placed.schema).parquet(f"{root}/in")
    last = slices.agg(F.max("__slice")).first()[0]
    for i in range(last + 1):
        part = rows.filter(F.col("__slice") == i).drop("__slice")
        if i == 0:
            part = part.withColumn("__state", none)
        else:
            part = _join_same(part, spark.read.parquet(f"{root}/state/n={i - 1}"), keys, "left")
        out = _fold(part, keys, order, state0, step, state_type, report_type)
        out.write.parquet(f"{root}/out/n={i}")
        written = spark.read.parquet(f"{root}/out/n={i}")
        position = F.struct(*[F.col(f"e.row.{c}") for c in order])
        written.groupBy(*keys).agg(F.max_by("e.next", position).alias("__state")).write.parquet(f"{root}/state/n={i}")
    return shown(spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out").drop("n"))
