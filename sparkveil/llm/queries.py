"""The named queries of this package; each applies one operator to its whole table."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. Python workers look for this package where the driver found it, if nothing else leads them there."""
    root = str(Path(__file__).resolve().parents[2])
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_sum_of_squares_packing")
def op3(spark, folder):
    from .packing import pack

    rows = pack(table(spark, folder, "documents"), tokenizer())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_two_tier_token_counts")
def op9(spark, folder):
    from .token_counts import count_tokens

    rows = count_tokens(table(spark, folder, "documents"), tokenizer())
    return rows.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op1_repetition_quality")
def op1(spark, folder):
    from .repetition import quality

    return quality(table(spark, folder, "documents"))


@query("op7_suffix_array_decontamination")
def op7(spark, folder):
    from .decontaminate import find_matches

    rows = find_matches(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    items = F.col("_llm_found.items")
    return rows.select(
        "doc_id", "_llm_found.n_words", "_llm_found.n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("_llm_found.n_hit") > 0).alias("contaminated"),
        F.col("_llm_found.longest").alias("longest_match"))


@query("op10_setsketch_near_duplicates")
def op10(spark, folder):
    from .setsketch import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), k=4)


@query("op2_external_shuffle_shards")
def op2(spark, folder):
    from .shards import shard_rows

    rows = shard_rows(table(spark, folder, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents),
full_lines AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
triples AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c, lead(pos, 2) OVER w AS last
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS stands FROM triples WHERE last IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, last)) AS pos FROM ranked WHERE stands > 1),
marked AS (
  SELECT l.doc_id, l.line, l.pos, g.pos IS NOT NULL AS removed, regexp_matches(l.line, '[^ \\t\\n\\x0B\\f\\r]') AS has_word
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos)
SELECT doc_id, count(*) FILTER (WHERE has_word) AS n_lines, count(*) FILTER (WHERE has_word AND removed) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op5_three_line_windows", LINE_SQL)
def op5(spark, folder):
    from .line_windows import drop_repeated_lines

    rows = drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "_llm_lines.n_lines", "_llm_lines.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op4_positive_unlabelled_toxicity")
def op4(spark, folder):
    from .toxicity import fit, score

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(5))
    rows = score(docs, *fit(docs, labels, learn=fold != 0))
    return rows.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_weak_label_quality")
def op8(spark, folder):
    from .weak_quality import judge

    return judge(table(spark, folder, "documents"))


@query("op6_suffix_merge_substrings")
def op6(spark, folder):
    from .suffixes import drop_repeats

    rows = drop_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_merkle_manifest")
def op12(spark, folder):
    from . import merkle

    docs = table(spark, folder, "documents")
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(struck, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    changed = merkle.leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    rows = merkle.prove(merkle.build(docs, more={"changed": changed}))
    rows = rows.withColumn("folded_root", merkle.fold(F.col("changed"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_importance_resampling")
def op13(spark, folder):
    from .importance import resample

    rows = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


@query("op11_consensus_host_paths")
def op11(spark, folder):
    from .host_paths import extract

    rows = extract(table(spark, folder, "pages"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path", "by_host")
