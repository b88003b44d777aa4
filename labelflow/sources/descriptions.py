"""Exemplar description files ``id,label,description,text``.

Spark's CSV reader gets rows with unescaped quotes inside quoted fields wrong without an error,
so files are read in parallel byte ranges by the rules of Python's ``csv`` module
(:mod:`labelflow.sources.csv_ranges`), the reader the reference uses; a file of any size is never
held whole. ``pos`` is the row's position in its file; a duplicate id keeps the last row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelflow.functions.labels import resolve_profile
from labelflow.sources.csv_ranges import LAST, read_csv

COLUMNS = ["id", "label", "description", "text"]


def _rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, COLUMNS, absent_null=False)[0]


def read_description_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All rows of the description file(s), with ``file`` and ``pos``; duplicates kept."""
    rows = _rows(spark, path).select("*", F.col("file_pos.start").alias("start"),
                                     F.col("file_pos.n").alias("n"))
    # rows before a range, from the ranges' counts; the one a range leaves open is its last
    counts = rows.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("n") < LAST, 1)).alias("own"))
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file", "start", "own",
                           F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("before"))
    place = F.when(F.col("n") < LAST, F.col("n")).otherwise(F.col("own") + F.col("n") - LAST)
    return rows.join(F.broadcast(before), ["file", "start"]).select(
        "file", (F.col("before") + place).cast("int").alias("pos"), *COLUMNS)


def read_descriptions(spark: SparkSession, path: str | list[str],
                      dataset: str | None = None) -> DataFrame:
    """``dataset, id, label, description, text`` with the last row per ``(dataset, id)``."""
    ds = F.lit(dataset) if dataset else resolve_profile(F.col("file"))
    rows = _rows(spark, path).withColumn("dataset", ds)
    w = Window.partitionBy("dataset", "id").orderBy(F.col("file_pos").desc())
    last = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1)
    return last.select("dataset", *COLUMNS)
