"""Uniform shards by a two-pass external shuffle, in DataFrame functions alone.

Pass one scatters rows into buckets that fit in memory, by a seeded hash. Pass two gives each bucket a Fisher-Yates
permutation and lays the buckets end to end; the shards are equal stretches of that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored, text_hash

BUCKET_BYTES = 32 << 20
#: Bytes that a row is taken to need beside its text.
ROW_BYTES = 256


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20240229, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``shard`` (0 to ``shards`` - 1; counts are at most one apart) and ``slot`` (gapless from 0 in each).

    The hash covers the seed and the row's number in the scan, so neither a repeated row nor a hot key fills a bucket.
    The scattered rows and the permutations are tables in the shared folder: a task that runs again finds the same
    rows in the same buckets. Null ids and texts are rows like others, an empty table gives no rows, and columns that
    are already called ``shard`` or ``slot`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    need = docs.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(ROW_BYTES)).alias("b")).first()
    total = need.n
    buckets = max(-(-(need.b or 0) // bucket_bytes), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    number = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    scattered = stored(docs.withColumn("_llm_bucket", F.pmod(number, F.lit(buckets))), "scatter")

    counts = scattered.groupBy("_llm_bucket").agg(F.count("*").alias("_llm_n"))
    before = Window.orderBy("_llm_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row for each bucket
    order = stored(counts.select(
        F.col("_llm_bucket").alias("_llm_b"), F.coalesce(F.sum("_llm_n").over(before), F.lit(0)).alias("_llm_start"),
        F.shuffle(F.sequence(F.lit(0), (F.col("_llm_n") - 1).cast("int")), seed).alias("_llm_order")), "order")

    inside = Window.partitionBy("_llm_bucket").orderBy(F.col(id_col), text_hash(F.col(text_col)))
    placed = scattered.withColumn("_llm_rank", F.row_number().over(inside)).join(order, F.col("_llm_bucket") == F.col("_llm_b"))
    at = F.col("_llm_start") + F.element_at("_llm_order", F.col("_llm_rank"))
    placed = placed.withColumn("_llm_at", at)
    placed = placed.withColumn("shard", F.expr(f"CAST((_llm_at * {shards}L) DIV {max(total, 1)}L AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {total}L + {shards - 1}L) DIV {shards}L")
    return placed.withColumn("slot", F.col("_llm_at") - first).select(*docs.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """One folder for each shard, its files sorted by slot."""
    rows = shard_rows(docs, shards, **options)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
