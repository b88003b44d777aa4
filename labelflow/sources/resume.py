"""K1 for long jobs: scoring that goes on where a stopped job ended.

Rows are dealt into parts by a hash of their id. Each part is scored and written as a folder of its
own; Spark marks a folder when all of it is there, and those marks are the manifest. A job
that starts again leaves finished parts alone, writes an unfinished one anew (its half-written
files lie in a folder of that attempt and are never read), and scores only ids that no
finished part has, so nothing is scored twice and new rows may join later.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.operators.predict import path_exists

#: Folder of one finished or unfinished part of one run.
_PART = re.compile(r"(run-[0-9a-f]{32}-part-\d+)/?$")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Part folders under ``path``, from its file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [str(s.getPath().toString()) for s in fs.listStatus(root)]
    return sorted(n for n in names if _PART.search(n))


def finished_parts(spark: SparkSession, path: str) -> list[str]:
    """The manifest: folders that a run has completed."""
    return [f for f in _folders(spark, path) if path_exists(spark, f"{f}/_SUCCESS")]


def read_scored(spark: SparkSession, path: str, schema) -> DataFrame:
    """All finished rows under ``path``; none where nothing is finished."""
    done = finished_parts(spark, path)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def _key(df: DataFrame, id_col: str):
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def score_resumable(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str,
                    id_col: str = "id", parts: int = 16, at_most: int | None = None) -> DataFrame:
    """Everything scored under ``path``: what earlier runs finished, and the rest scored now.

    ``score`` maps rows to scored rows and keeps ``id_col``. Rows that share an id (NULL is an id
    too) are scored together, in one part; a later run with more rows under a finished id
    leaves those out. ``rows`` is read once to deal the unscored rows into ``parts``; each part
    then reads its own. ``at_most`` ends after that many parts, as a stopped job would."""
    spark = rows.sparkSession
    schema = score(rows.limit(0)).schema
    done = read_scored(spark, path, schema)
    seen = done.select(_key(done, id_col).alias("_key")).distinct()
    todo = rows.withColumn("_key", _key(rows, id_col)).join(seen, "_key", "left_anti")
    run = uuid.uuid4().hex
    dealt = f"{path}/todo-{run}"
    todo.withColumn("_part", F.pmod(F.xxhash64("_key.none", "_key.id"), F.lit(parts)).cast("int")) \
        .drop("_key").write.partitionBy("_part").parquet(dealt)
    own = spark.read.schema(f"{_ddl(rows)}, _part int").parquet(dealt)
    for k in range(parts if at_most is None else min(parts, at_most)):
        part = own.where(F.col("_part") == k).drop("_part")
        score(part).write.parquet(f"{path}/run-{run}-part-{k:05d}")
    return read_scored(spark, path, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
