"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder
from .shared import blocks

#: Pre-tokens in the broadcast table, and the longest that it takes: at most 64 Ki entries of 32 bytes.
TABLE_ENTRIES = 1 << 16
TABLE_BYTES = 32
#: Counters that a task holds, and those that it hands on.
TASK_COUNTERS = 400_000
TASK_HANDS_ON = 4_096


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for block in blocks((text or "").encode("utf-8", "surrogatepass")):
                counts.update(block.split())
            if len(counts) > TASK_COUNTERS:
                counts = Counter(dict(counts.most_common(TASK_COUNTERS // 4)))
    top = [(k, v) for k, v in counts.most_common(TASK_HANDS_ON) if len(k) <= TABLE_BYTES and v > 1]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([v for _, v in top], pa.int64())], ["run", "n"])


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", entries: int = TABLE_ENTRIES) -> dict[bytes, int]:
    """Token counts of the most frequent pre-tokens of the whole corpus.

    Every task counts all its pre-tokens and hands on a summary of bounded size; only summaries move. The table steers
    speed alone: a pre-token that it lacks is encoded where it stands.
    """
    seen = docs.select(text_col).mapInArrow(_summary, "run binary, n long")
    top = seen.groupBy("run").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "run").limit(entries).collect()
    enc = encoder(path)
    return {bytes(r.run): len(enc.run(bytes(r.run))) // 4 for r in top}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """One row for each document: its id, UTF-8 bytes and number of tokens, without special tokens.

    Tier one is a broadcast table of frequent pre-token lengths (bounded by ``entries`` and ``TABLE_BYTES``), tier two the
    worker's cache, then the tokenizer. Null texts are empty: 0 bytes, 0 tokens. Repeated rows are counted one by one, an
    empty table gives an empty result, other columns are not read. ``path`` is the tokenizer file, present on each node.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col, entries))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        enc, first = encoder(path), table.value

        def length(run: bytes) -> int:
            return len(enc.run(run)) // 4

        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1).to_pylist():
                data, n = (text or "").encode("utf-8", "surrogatepass"), 0
                for block in blocks(data):
                    runs = block.split()
                    got = list(map(first.get, runs))
                    if None in got:
                        got = [length(r) if g is None else g for r, g in zip(runs, got)]
                    n += sum(got)
                sizes.append(len(data))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
