"""Structured Streaming use of the stateless operators.

Filters (P1–P3), routing (P5, P11), class names (J3), prompts (F1–F3), messages (F4, F5),
tokens (F6–F9) and parsing (M6) hold no state and run no action, so they accept a streaming
DataFrame unchanged; side tables (the exemplar block) are static and broadcast-joined. Nothing
here needs a watermark: the reference has no event time.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions.labels import class_name
from labelflow.functions.prompts import prompt_col
from labelflow.operators.rows import labelled, test_split, train_split
from labelflow.session import ensure_checkpoint_dir
from labelflow.sources.items import items_stream


def scoring_prompts(items: DataFrame, mode: str = "image", demo: DataFrame | None = None) -> DataFrame:
    """Test rows with a label → ``id, dataset, prompt, label_name`` (batch or stream)."""
    rows = class_name(labelled(test_split(items)))
    if demo is not None:
        rows = rows.join(F.broadcast(demo), "dataset", "left")
        p = F.concat(F.coalesce(F.col("demo"), F.lit("")), prompt_col("text", "dataset", mode))
    else:
        p = prompt_col("text", "dataset", mode)
    return rows.select("id", "dataset", p.alias("prompt"), "label_name")


def training_prompts(items: DataFrame) -> DataFrame:
    rows = class_name(labelled(train_split(items)), out="answer")
    return rows.select("id", "dataset", prompt_col("text", "dataset", "image").alias("prompt"),
                       "answer")


def stream_items(spark: SparkSession, path: str, dataset: str | None = None,
                 columns: list[str] | None = None) -> DataFrame:
    return items_stream(spark, path, dataset, columns)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A fresh folder for a query's stream state under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "streams", f"{name}-{uuid.uuid4().hex}")


def run_available(df: DataFrame, name: str, sink_path: str | None = None, fmt: str = "parquet"):
    """Process everything available now (``trigger(availableNow=True)``) and stop.

    Writes to ``sink_path`` (parquet by default: a file sink is exactly-once with its
    checkpoint), or to an in-memory table ``name`` when no path is given (tests)."""
    spark = df.sparkSession
    w = df.writeStream.option("checkpointLocation", checkpoint_location(spark, name)) \
        .trigger(availableNow=True)
    if sink_path is None:
        q = w.format("memory").queryName(name).outputMode("append").start()
    else:
        q = w.format(fmt).option("path", sink_path).outputMode("append").start()
    q.awaitTermination()
    return q
