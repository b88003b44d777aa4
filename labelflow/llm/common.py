"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.session import ensure_checkpoint_dir, ship_package
from labelflow.sources.testdata import table  # noqa: F401  (re-exported for the queries)

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows per Arrow batch: long texts must not add up to more than a worker's memory.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, the package on the workers, and Arrow batches small enough for
    tables of long texts."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet (input tables may carry any names)."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}{k}"
    return name


def persisted(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared ``spark.checkpoint.dir``: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, stem: str) -> DataFrame:
    """``df`` written as a Parquet table under the shared ``spark.checkpoint.dir`` and read back:
    like :func:`persisted`, but compressed and read column by column."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one in so many rows is hot: there are at most so many hot keys.
HOT_SHARE = 1000


def join_counted(df: DataFrame, side: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """Inner join on equal ``key`` (no nulls) with a table that holds, for every key, how many of
    the ``rows`` rows of ``df`` have it (``n``). Keys of more than a thousandth of the rows are at
    most a thousand and joined by broadcast, so a key with a third of all rows stays where it is;
    any other key's rows meet theirs by an exchange. ``side`` may hold a few rows a key."""
    hot = side.where(F.col(n) * HOT_SHARE > rows)
    rest = side.where(F.col(n) * HOT_SHARE <= rows)
    far = df.join(F.broadcast(hot.select(key)), key, "left_anti")
    return df.join(F.broadcast(hot), key).unionByName(far.join(rest, key))


def released(result):
    """``result``, after the memory that its making left behind went back to the system: a worker
    that waits for its next task then holds no more than it needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    return result
