"""What kind of document is this, and which of its hits matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogs import DOCUMENT_CLASSES
from ..functions.folds import constants, let
from .dedupe import dedupe_exact, normalize_type

GENERIC = "GENERIC"


def classify_document(text: Column) -> Column:
    """Best-scoring document class; a keyword counts once, as a substring."""
    classes = F.array(*[
        F.struct(F.lit(-i).alias("rank"), F.lit(name).alias("name"), constants(words).alias("words"))
        for i, (name, words, _, _) in enumerate(DOCUMENT_CLASSES)])

    def score(low):
        return F.array_max(F.transform(classes, lambda c: F.struct(
            F.size(F.filter(c["words"], lambda w: F.contains(low, w))).alias("score"), c["rank"], c["name"])))

    best = let(F.lower(text), score)
    return let(best, lambda b: F.coalesce(F.when(b["score"] > 0, b["name"]), F.lit(GENERIC)))


def expected_types(spark) -> DataFrame:
    """(document_type, type, place, most): fixed, a few dozen rows."""
    rows = [(name, t, i, most) for name, _, types, most in DOCUMENT_CLASSES for i, t in enumerate(types)]
    return spark.createDataFrame(rows, "document_type string, type string, place int, most int")


def filter_by_context(hits: DataFrame, docs: DataFrame, key="doc_id", text="text", order="hit_no") -> DataFrame:
    """Hits that fit their document's class, one per value, best first.

    GENERIC documents keep all hits.  Others keep the expected types under
    their canonical names, at most as many as the class allows, ordered by the
    class's list of types (``place``).
    """
    classes = docs.select(key, classify_document(F.col(text)).alias("document_type"))
    typed = hits.join(classes, key)
    free = F.col("document_type") == GENERIC
    typed = typed.withColumn("type", F.when(free, F.col("type")).otherwise(normalize_type(F.col("type"))))
    # the table of expected types is a constant of this package
    table = F.broadcast(expected_types(hits.sparkSession))
    fitting = typed.join(table, ["document_type", "type"], "left").filter(free | F.col("most").isNotNull())
    firsts = dedupe_exact(fitting, (key,), (order,))
    best = Window.partitionBy(key).orderBy(F.desc("confidence"), F.asc(order))
    top = firsts.withColumn("__n", F.row_number().over(best)).filter(free | (F.col("__n") <= F.col("most")))
    return top.drop("__n", "most").withColumn("place", F.coalesce("place", F.lit(0)))
