"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own: dict[str, str] = {}
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see.

    Where the session names none, a local session (one process) gets a temporary folder; any other raises, since its
    executors would write to disks that nobody else can read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="sparkveil-llm-")
    return _own[context.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the plan is cut and survives lost executors.

    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def text_hash(text: Column) -> Column:
    """Tells apart rows that repeat a document id with another text."""
    return F.xxhash64(text)


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in blocks of about ``size`` bytes that end before ASCII white space; nothing is left out."""
    at = 0
    while at < len(data):
        if len(data) - at <= size:
            yield data[at:]
            return
        found = _SPACE.search(data, at + size)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` as UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def map_texts(docs: DataFrame, work, fields: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``work(texts)`` gives one list for each field, in the order of the texts; rows keep their id as ``doc_id``."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted = StructType.fromDDL(fields)
    wanted.fields.insert(0, given.schema["doc_id"])
    kinds = to_arrow_schema(StructType(wanted.fields[1:]))

    def run(batches):
        for batch in batches:
            cols = work(batch.column(1).to_pylist())
            arrays = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *kinds.names])

    return given.mapInArrow(run, StructType(wanted.fields))


def filter_texts(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """Rows for which ``keep(texts)`` is true, all columns as they are; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
