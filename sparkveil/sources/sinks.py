"""Writing results, laid out by batch.

Rows are dealt out by batch through a rebalancing exchange: Spark measures what it wrote for each part, cuts a part that
is too large and joins small ones, so that a batch gets files of about the size that the session advises
(``spark.sql.adaptive.advisoryPartitionSizeInBytes``), be it a thousandth of the rows or nearly all of them.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Parts into which rows are dealt before they are joined or cut: many, so that few batches share one.
PARTS = 512

#: Threads of the driver that put folders of batches in place; they wait for the file system.
MOVERS = 8

#: Tasks for each core that list folders of batches.
LIST_TASKS = 4


def by_batch(rows: DataFrame) -> DataFrame:
    """Rows dealt out by batch, large batches over several tasks by their measured size."""
    return rows.hint("rebalance", PARTS, "batch_id")


def _write(rows: DataFrame, path: str, kind: str, mode: str, run: str | None) -> None:
    """Write below ``path``, in a folder for each batch.

    With the name of a ``run`` the rows go to a folder of that run inside each batch, and a run that is repeated takes
    the place of its first try instead of being appended to it.
    """
    if run is None:
        rows.write.mode(mode).partitionBy("batch_id").format(kind).save(path)
    else:
        _put_run(rows, path, kind, run)


def _put_run(rows: DataFrame, path: str, kind: str, run: str) -> None:
    """Rows of a run, written aside and then moved into the folders of their batches, each in place of an earlier try.

    What a dynamic overwrite does, but that makes, empties and moves the folders one after the other in the driver, which
    for many new batches takes as long as writing them. Here a store that is not there yet is put in place as a whole.
    """
    spark = rows.sparkSession
    hadoop, path = spark.sparkContext._jvm.org.apache.hadoop.fs, path.rstrip("/")
    Path, paths_of = hadoop.Path, hadoop.FileUtil.stat2Paths  # looked up once: each look is a call into the JVM
    store, name = Path(path), f".run-{uuid.uuid4().hex}"  # hidden from readers, on the same file system
    fs = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = store.getParent() is not None and not fs.exists(store)
    aside = Path(store.getParent() if fresh else store, name)

    def folders(of):
        return (p for p in paths_of(fs.listStatus(of)) if "=" in p.getName())

    def put(move) -> None:
        source, batch, own = move
        place = Path(f"{path}/{batch}/{own}")
        if not fs.delete(place, True):
            fs.mkdirs(place.getParent())
        if not fs.rename(source, place):
            raise OSError(f"{source.toString()} could not be moved to {place.toString()}")

    # with the run on top its folder is made once, but then it has to be put below each batch
    order = ("batch_id", "run") if fresh else ("run", "batch_id")
    writer = rows.withColumn("run", F.lit(run)).write.partitionBy(*order).format(kind)
    try:
        writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").save(aside.toString())
        if fresh and not fs.exists(store) and fs.rename(aside, store):
            aside = Path(store, name)  # where it is if another writer made the store just now
        if fs.exists(aside):
            with ThreadPoolExecutor(MOVERS) as movers:
                for outer in folders(aside):
                    top = outer.getName()
                    list(movers.map(put, ((p, top, p.getName()) if fresh else (p, p.getName(), top) for p in folders(outer))))
    finally:
        fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def read_batches(spark: SparkSession, path: str, schema: StructType, kind="parquet") -> DataFrame:
    """What a sink wrote below ``path``; its folders are listed by a few tasks for each core, not by one task each."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(LIST_TASKS * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.format(kind).schema(schema).load(path)
    finally:
        spark.conf.set(setting, before)


def write_detections(hits: DataFrame, path: str, mode="append", run: str | None = None) -> None:
    """Stored hits, partitioned by batch for pruned reads."""
    _write(by_batch(hits), path, "parquet", mode, run)


def write_masked(docs: DataFrame, path: str, mode="append", run: str | None = None) -> None:
    """Masked documents as rows, partitioned by batch."""
    _write(by_batch(docs), path, "parquet", mode, run)


def write_masked_lines(docs: DataFrame, path: str, mode="append", run: str | None = None) -> None:
    """Lines of the masked documents as plain text, document after document, in a folder per batch."""
    rows = by_batch(docs.select("batch_id", "doc_id", F.col("text").alias("value"))).sortWithinPartitions("batch_id", "doc_id")
    _write(rows.drop("doc_id"), path, "text", mode, run)


def write_masked_json(docs: DataFrame, path: str, mode="append", run: str | None = None) -> None:
    """Masked documents as JSON lines of doc_id and text, in a folder per batch."""
    _write(by_batch(docs.select("batch_id", "doc_id", "text")), path, "json", mode, run)


def write_sidecar(sidecar: DataFrame, path: str, mode="append", run: str | None = None) -> None:
    _write(by_batch(sidecar), path, "parquet", mode, run)


def write_export(payloads: DataFrame, path: str, mode="append", run: str | None = None) -> None:
    """One JSON line per payload, partitioned by batch."""
    _write(by_batch(payloads), path, "json", mode, run)
