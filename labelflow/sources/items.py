"""Scan labelled item CSVs into the declared item schema.

The reference reads the CSV with an inferred schema and tests at run time whether a column
exists. Here every column is read as a string and missing optional columns are added as typed
NULLs by name, so every later operator sees one schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions.labels import label_int, malformed_label, resolve_profile
from labelflow.sources.csv_ranges import read_csv

# Raw columns of an item file, in order; all optional except id.
ITEM_COLUMNS = ["id", "text", "label", "type", "image", "frames", "video"]

ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("frames", T.StringType()),
    T.StructField("video", T.StringType()),
    T.StructField("dataset", T.StringType()),
])

# Options measured to agree with Python's csv module on doubled quotes and embedded newlines.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "encoding": "UTF-8", "inferSchema": "false", "mode": "PERMISSIVE"}


def conform_items(df: DataFrame, dataset: str | None = None, keep: list[str] | None = None,
                  strict: bool = True) -> DataFrame:
    """Add absent optional columns as typed NULL, cast ``label`` like ``int(label)`` and
    resolve the dataset profile (a given name, else from the file path). A label that is no
    number raises, as ``int()`` does; with ``strict=False`` it becomes NULL: take such rows out
    first (:func:`split_malformed`)."""
    cols = set(df.columns)
    for c in ITEM_COLUMNS:
        if c not in cols:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if dataset is not None:
        ds = F.lit(dataset)
    elif "dataset" in cols:
        ds = F.col("dataset")
    else:
        ds = resolve_profile(F.input_file_name())
    return df.select(
        F.col("id").cast("string").alias("id"),
        F.col("text").cast("string").alias("text"),
        (F.when(malformed_label("label"), F.raise_error(
            F.concat(F.lit("label is no number: "), F.col("label").cast("string"))).cast("int"))
         .otherwise(label_int("label")) if strict else label_int("label")).alias("label"),
        F.col("type").cast("string").alias("type"),
        F.col("image").cast("string").alias("image"),
        F.col("frames").cast("string").alias("frames"),
        F.col("video").cast("string").alias("video"),
        ds.alias("dataset"),
        *(keep or []),
    )


def split_malformed(raw: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: rows whose label is a number or absent, and those whose label is neither
    (with a ``reason``), for the quarantine."""
    bad = malformed_label(label)
    return raw.filter(~F.coalesce(bad, F.lit(False))), raw.filter(bad).withColumn(
        "reason", F.concat(F.lit("label is no number: "), F.col(label).cast("string")))


def read_items(spark: SparkSession, path: str | list[str], dataset: str | None = None,
               multi_line: bool = True, positions: bool = False) -> DataFrame:
    """Header CSV(s) → item schema. ``dataset`` defaults to the file's own column, then to the
    profile named in each file's path (S6).

    Files may differ in their columns and in their order: each is read by its own header;
    absent optional columns are NULL. Files of any size are read in parallel byte ranges, also
    with newlines inside quotes (:mod:`labelflow.sources.csv_ranges`; rows are those of Python's
    ``csv`` module). ``multi_line=False`` takes every newline as the end of a row.

    ``positions`` adds ``file_pos``: the row's place ``(file, start, n)`` in the order of files (by
    path) and rows, for "first k in file order" (O2)."""
    raw, found = read_csv(spark, path, [*ITEM_COLUMNS, "dataset"], multi_line)
    named = resolve_profile(F.col("file"))
    raw = raw.withColumn("dataset", F.coalesce("dataset", named) if "dataset" in found else named) \
        if dataset is None else raw
    return conform_items(raw, dataset, keep=["file_pos"] if positions else None)


def items_stream(spark: SparkSession, path: str, dataset: str | None = None,
                 columns: list[str] | None = None) -> DataFrame:
    """Streaming counterpart of :func:`read_items` (file source; the schema must be declared). A
    file whose header names other columns, or the same in another order, fails the stream
    instead of being read by position."""
    cols = columns or ITEM_COLUMNS
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
    df = spark.readStream.schema(schema).options(**CSV_OPTIONS, enforceSchema="false").csv(path)
    return conform_items(df, dataset)
