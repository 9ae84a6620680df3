"""Sinks that write runs: what a run replaces, what it leaves, and how its folders are listed."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sparkveil.sources import sinks as W

NAMES = ["B 1,x", "a:b/c", None, "\u00e9%", "", "x=y", "[z]*?{q}\n"]


def _rows(spark, ids):
    return spark.createDataFrame([(NAMES[i], i) for i in ids], "batch_id string, v int")


def _stored(spark, path):
    return sorted((r.run or "", r.v) for r in spark.read.parquet(path).collect())


def test_a_run_replaces_its_batches_and_nothing_else(spark, tmp_path):
    path, every = str(tmp_path / "a b" / "store"), range(len(NAMES))
    for run in ("r/1: a", "r/1: a", "two"):
        W.write_detections(_rows(spark, every), path, run=run)
    assert _stored(spark, path) == sorted((run, i) for run in ("r/1: a", "two") for i in every)
    W.write_detections(_rows(spark, [0]).withColumn("v", F.lit(10)), path, run="two")
    W.write_detections(_rows(spark, []), path, run="none")
    assert _stored(spark, path) == sorted([("r/1: a", i) for i in every] + [("two", i) for i in every if i] + [("two", 10)])
    back = {r.v: r.batch_id for r in W.read_batches(spark, path, _rows(spark, []).schema).collect()}
    assert back[1] == "a:b/c" and back[6] == NAMES[6] and back[2] is None
    assert all(n.startswith("batch_id=") for n in os.listdir(path)) and os.listdir(tmp_path / "a b") == ["store"]


def test_a_new_store_without_rows_and_one_of_two_writers(spark, tmp_path):
    W.write_detections(_rows(spark, []), str(tmp_path / "none"), run="one")
    assert W.read_batches(spark, str(tmp_path / "none"), _rows(spark, []).schema).count() == 0
    runs, path = [f"run {i}" for i in range(4)], str(tmp_path / "both")
    with ThreadPoolExecutor(4) as threads:
        list(threads.map(lambda run: W.write_detections(_rows(spark, range(len(NAMES))), path, run=run), runs))
    assert _stored(spark, path) == sorted((run, i) for run in runs for i in range(len(NAMES)))


def test_a_run_that_fails_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "store")
    W.write_detections(_rows(spark, [0, 1]), path, run="one")
    with pytest.raises(Exception, match="no such value"):
        W.write_detections(_rows(spark, [0]).withColumn("v", F.expr("raise_error('no such value')").cast("int")), path, run="one")
    assert _stored(spark, path) == [("one", 0), ("one", 1)] and len(os.listdir(path)) == 2


def test_folders_of_many_batches_are_listed_by_few_tasks(spark, tmp_path):
    n = F.col("id")
    spark.range(900).select(
        (n % 300).alias("l_suppkey"), n.alias("l_orderkey"), (n % 77).alias("l_partkey"), F.lit(1).alias("l_linenumber"),
        F.lit(0.1).alias("l_discount"), F.lit(1.0).alias("l_quantity"), F.to_timestamp_ntz(F.lit("2024-01-01")).alias("l_shipdate"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    sc = spark.sparkContext
    sc.setJobGroup("sinks", "sinks")
    try:
        out = queries()["write_detections"](spark, str(tmp_path))
        tracker = sc.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("sinks") for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) < 300
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert out.agg(F.sum("hits")).first()[0] == 900 and out.select("batch_id").distinct().count() == 300
