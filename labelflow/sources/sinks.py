"""Sinks: prediction files (K1, P8) and the training-set size report (K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_COLUMNS = ["id", "response", "label"]


def prediction_rows(df: DataFrame, label_col: str = "label_name") -> DataFrame:
    """``(id, response, label)`` with the label as its class name."""
    return df.select(F.col("id").cast("string").alias("id"),
                     F.col("response").cast("string").alias("response"),
                     F.col(label_col).cast("string").alias("label"))


# written so that any text reads back as it was: quotes doubled, outer spaces kept
_CSV_WRITE = {"header": "true", "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false",
              "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV files that :func:`labelflow.sources.items.read_items` and
    :func:`read_predictions` read back exactly."""
    df.write.mode(mode).options(**_CSV_WRITE).csv(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """K1: header CSV (any text round-trips) or parquet."""
    rows = df.select(*PREDICTION_COLUMNS)
    if fmt == "csv":
        write_csv(rows, path, mode)
    elif fmt == "parquet":
        rows.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction file written by :func:`write_predictions` as CSV: an empty response (quoted)
    stays an empty text, an absent one (nothing between the commas) is NULL."""
    schema = ", ".join(f"{c} string" for c in PREDICTION_COLUMNS)
    empty = "\u0001"  # stands for a quoted empty field while reading
    raw = spark.read.schema(schema).option("header", "true").option("multiLine", "true") \
        .option("escape", '"').option("quote", '"').option("enforceSchema", "false") \
        .option("emptyValue", empty).csv(path)
    return raw.select(*[F.when(F.col(c) == empty, F.lit("")).otherwise(F.col(c)).alias(c)
                        for c in PREDICTION_COLUMNS])


def observe_size(df: DataFrame, name: str = "train"):
    """K2: attach a row-count metric computed while the data flows (no extra job).
    Returns ``(df, observation)``; read ``observation.get['rows']`` after an action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
