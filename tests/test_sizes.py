"""Sizes beyond a bigint, and joins that do not fill the driver."""

from pyspark.sql import functions as F

from sparkveil.functions import geometry as G
from sparkveil.operators import crypto as K
from sparkveil.plans.source_queries import human_size as human_size_query
from sparkveil.sources.files import human_size


def test_a_size_beyond_a_bigint(spark):
    rows = [("99999999999999999999", "90949470.18 TB"), ("-5", "-5.00 B"), ("0", "0.00 B"), ("1023", "1023.00 B"), ("1029", "1.00 KB"),
            ("1048575", "1024.00 KB"), ("1536", "1.50 KB"), (str(1024 ** 4 * 3 // 2), "1.50 TB"), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    assert [r[0] for r in df.select(human_size(F.col("a").cast("decimal(38,0)"))).collect()] == [b for _, b in rows]
    assert [r[0] for r in df.filter("length(a) < 19 OR a IS NULL").select(human_size(F.col("a").cast("bigint"))).collect()] == [b for _, b in rows[1:]]
    assert spark.createDataFrame([(1535.9,)], "a double").select(human_size(F.col("a"))).first()[0] == "1.50 KB"


def test_keys_whose_product_passes_a_bigint(spark, tmp_path):
    spark.createDataFrame([(7_200_000, 50), (10, 2)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: r["size"] for r in human_size_query(spark, str(tmp_path)).collect()}
    assert got[10] == "1.95 KB" and got[7_200_000] == f"{7_200_000 ** 3 * 50 / 1024 ** 4:.2f} TB"


def test_boxes_are_attached_without_a_broadcast(spark):
    blocks = spark.createDataFrame([(1, 0, "say hello"), (1, 1, "hello"), (2, 0, "x")], "doc_id bigint, line_number int, text string").withColumn(
        "bbox", G.box(*[F.col("line_number")] * 4))
    hits = spark.createDataFrame([(1, 0, "hello"), (1, 1, "none"), (2, 0, ""), (3, 0, "x"), (1, 2, "o")], "doc_id bigint, hit_no int, value string")
    df = G.attach_bbox(hits, blocks)
    got = sorted((r.doc_id, r.value, r.bbox and r.bbox.x) for r in df.collect())
    assert got == [(1, "hello", 0), (1, "none", None), (1, "o", 0), (2, "", 0), (3, "x", None)]
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_derived_in_many_short_tasks(spark):
    """One task for each core leaves late executors idle, and the others wait for the fullest."""
    salts = spark.createDataFrame([(bytes([i]) * 16,) for i in range(2)], "salt binary")
    keyed = K.with_key(salts, "pw")
    assert keyed.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert {bytes(r.salt): bytes(r.key) for r in keyed.collect()} == {bytes([i]) * 16: K.derive_key("pw", bytes([i]) * 16) for i in range(2)}
