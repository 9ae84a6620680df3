"""Importance resampling towards a target: n-gram buckets of both sides, gains, and Gumbel-perturbed top weights."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .ngram_table import Grams, chunks
from .shared import stored

BUCKETS = 10_000


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket. A task hands on one row for each bucket at most."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, pieces in chunks(batch.column(0).to_pylist()):
                for t in Grams(pieces, buckets).tables:
                    np.add.at(total, t.bucket[t.used], t.count[t.used])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    found = texts.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # one row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket, in thousandths, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + n) / ((float(s) + 1) * (float(t_all) + n))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``n_words``, ``n_features`` and ``weight``, the sum of the gains of a text's n-grams."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches):
        value = held.value
        for batch in batches:
            n = batch.num_rows
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for places, pieces in chunks(batch.column(1).to_pylist()):
                place, grams = np.array(places), Grams(pieces, len(value))
                np.add.at(words, place, grams.words)
                for table, piece in zip(grams.tables, grams.pieces):
                    np.add.at(features, place, np.bincount(piece, minlength=len(pieces)))
                    upto = np.concatenate(([0], np.cumsum(value[table.bucket[table.slot]])))
                    edge = np.searchsorted(piece, np.arange(len(pieces) + 1))
                    np.add.at(weight, place, upto[edge[1:]] - upto[edge[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Every document with ``n_words``, ``n_features``, ``weight``, ``score`` and, where drawn, ``rank``.

    Drawn are the ``percent`` of the documents with ``least_words`` words or more that score highest, ties to the
    smaller id: without replacement, in proportion to the exponential of the weight. The noise follows from seed and id
    alone. Texts never move: one pass counts buckets, one sums gains; only the numbers of each document are sorted, by
    ranges. Null and empty texts have no features and weight 0; a null id hashes as an empty one and comes first among
    equals; rows that repeat an id are documents of their own. An empty table gives no rows, an empty target makes gains
    of the source's shares alone. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = weigh(docs, gain, id_col, text_col)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("_llm_in", F.col("n_words") >= least_words)
    rows = stored(rows.withColumn("_llm_low", -F.col("score")), "weights")
    drawn = percent * rows.filter("_llm_in").count() // 100
    ranked = numbered(rows, ["_llm_in"], ["_llm_low", "doc_id"], "rank", first=1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_llm_in") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
