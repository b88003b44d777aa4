"""A5 / M7: training batches and optimizer steps from a seeded order.

Rows get a dense position (O1 + O4, no single-task window), then
``batch_id = pos div batch_size`` and ``step_id = pos div (batch_size * accumulation)``.
``collate`` stacks each batch into one row; a batch holds at most ``batch_size`` rows, so the
collect is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.constants import BATCH_SIZE, GRAD_ACCUMULATION, SHUFFLE_SEED
from labelflow.operators.ordering import seeded_shuffle


def assign_batches(df: DataFrame, id_col: str = "id", batch_size: int = BATCH_SIZE,
                   accumulation: int = GRAD_ACCUMULATION, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Add ``pos``, ``batch_id``, ``slot`` (position inside the batch) and ``step_id``."""
    pos = seeded_shuffle(df, id_col, seed, out="pos")
    return pos.withColumn("batch_id", F.floor(F.col("pos") / batch_size).cast("bigint")) \
              .withColumn("slot", (F.col("pos") % batch_size).cast("int")) \
              .withColumn("step_id",
                          F.floor(F.col("pos") / (batch_size * accumulation)).cast("bigint"))


def collate(batched: DataFrame, cols: list[str]) -> DataFrame:
    """Stack every column of ``cols`` per batch, in slot order: one row per batch with
    ``array`` columns (the Spark form of the reference's stacked tensors)."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("slot"), *[F.col(c) for c in cols])))
    g = batched.groupBy("batch_id", "step_id").agg(packed.alias("_rows"))
    return g.select("batch_id", "step_id", F.size("_rows").alias("n_rows"),
                    *[F.transform("_rows", _field(c)).alias(c) for c in cols])


def _field(name: str):
    return lambda r: r[name]


def collate_with(batched: DataFrame, collator, schema) -> DataFrame:
    """M7: a caller's collator per batch: ``collator(pandas frame of one batch in slot order) →
    pandas frame`` of ``schema``. A batch holds at most ``batch_size`` rows."""
    def run(pdf):
        return collator(pdf.sort_values("slot", ignore_index=True))
    return batched.groupBy("batch_id").applyInPandas(run, schema)
