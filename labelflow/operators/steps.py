"""M3 in optimizer steps: a linear text classifier trained over A5's batches.

The reference trains for five epochs in a seeded order, four rows a batch, eight batches added
up before each update, at a constant rate, with the gradient's norm cut. A step needs the weights
of the step before, so steps are serial; all that does not depend on the weights is done once, in
parallel, before them: reading, hashing and ordering the rows, and packing each step's rows (which
features it has, and which of them each row has how often) into one row of a table in the
shared folder. An epoch is then a chain of short jobs: each takes the weights, makes the updates
of at most ``SEGMENT`` steps in order and gives the weights back. An update is a few array operations. A
row's contribution is in whole numbers (2**-40 units), so a step's sum, and with it every weight, is
the same for any number of tasks and equals a plain loop over the rows.

A task holds the weights and the packed rows of a few steps, whatever the table's size; no task and
no message carries more than one segment. Weights go from job to job through the driver
(``features`` numbers).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.constants import BATCH_SIZE, GRAD_ACCUMULATION, SHUFFLE_SEED
from labelflow.operators.batches import assign_batches
from labelflow.operators.ordering import checkpointed
from labelflow.session import bounded_batches, ensure_checkpoint_dir

UNIT = float(1 << 40)
#: At most so many features: weights travel with every job.
MAX_FEATURES = 1 << 20
#: Steps of one job.
SEGMENT = 1024
PACKED = ("segment bigint, step_id bigint, labels binary, sizes binary, found binary, "
          "features binary, at binary, times binary")


@dataclass(frozen=True)
class StepParams:
    """Fixed values of the reference's training run, but for the rate: its own, 2e-4, is for
    adapters of a large model; ``features`` are hashed words."""
    epochs: int = 5
    rate: float = 0.5
    max_norm: float = 0.3
    features: int = 1 << 16
    batch_size: int = BATCH_SIZE
    accumulation: int = GRAD_ACCUMULATION
    seed: int = SHUFFLE_SEED


def _pack(segment: int, step: int, rows: list[tuple[int, np.ndarray]]) -> tuple:
    """One step's rows ``(label, features)``, in order, as a row of :data:`PACKED`: the step's
    ``features`` ascending, and for every row how many features it has (``sizes``), how many of them
    differ (``found``), where these stand in ``features`` (``at``) and how often each comes
    (``times``)."""
    own = [np.unique(x, return_counts=True) for _, x in rows]
    features, at = np.unique(np.concatenate([u for u, _ in own]), return_inverse=True)
    arrays = (np.array([label for label, _ in rows], np.int8),
              np.array([len(x) for _, x in rows], np.int64),
              np.array([len(u) for u, _ in own], np.int64), features.astype(np.int32),
              at.astype(np.int32), np.concatenate([c for _, c in own]).astype(np.int32))
    return segment, step, *(a.tobytes() for a in arrays)


def _packed(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(step_id, label, features)`` in order, packed step by step."""
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
    names = [c.split()[0] for c in PACKED.split(", ")]

    def batch(done):
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t)
                                           for k, t in enumerate(kinds)], names=names)

    now, rows = None, []
    for b in batches:
        done = []
        ends, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
        for k, (step, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if step != now:
                if rows:
                    done.append(_pack(now // segment, now, rows))
                now, rows = step, []
            rows.append((label, flat[ends[k]:ends[k + 1]].copy()))
        yield batch(done)
    yield batch([_pack(now // segment, now, rows)] if rows else [])


def update(weights: np.ndarray, bias: float, labels: np.ndarray, sizes: np.ndarray,
           found: np.ndarray, features: np.ndarray, at: np.ndarray, times: np.ndarray,
           params: StepParams) -> float:
    """One optimizer step on a packed step (see :func:`_pack`); changes ``weights``, gives the bias.
    A feature's value is its share of the row's words. Gradients are in whole units of 2**-40; a
    step's sums of them stay below 2**53, so adding them up as doubles is exact."""
    share = times / np.repeat(np.maximum(sizes, 1), found)
    own = weights[features][at]
    ends = [0, *np.cumsum(found).tolist()]
    margin = np.array([own[i:j] @ share[i:j] for i, j in zip(ends, ends[1:])]) + bias
    miss = 1.0 / (1.0 + np.exp(-margin)) - labels
    total = np.bincount(at, np.rint(np.repeat(miss, found) * share * UNIT), len(features))
    n = len(labels)
    g, b = total / (UNIT * n), float(np.rint(miss * UNIT).sum()) / (UNIT * n)
    norm = float(np.sqrt((g * g).sum() + b * b))
    scale = params.rate * min(1.0, params.max_norm / norm) if norm else 0.0
    weights[features] -= scale * g
    return bias - scale * b


def _segment(steps: DataFrame, weights: np.ndarray, bias: float, params: StepParams
             ) -> tuple[np.ndarray, float]:
    """The weights after one segment's steps, which are a bounded number."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = weights.copy(), bias
        kinds = (np.int8, np.int64, np.int64, np.int32, np.int32, np.int32)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                b = update(w, b, *(np.frombuffer(a, t) for a, t in zip(row[1:], kinds)), params)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()),
                                          pa.array([float(b)], pa.float64())],
                                         names=["weights", "bias"])

    names = [c.split()[0] for c in PACKED.split(", ")][1:]
    got = steps.select(*names).coalesce(1).sortWithinPartitions("step_id") \
        .mapInArrow(train, "weights binary, bias double").collect()[0]
    return np.frombuffer(got["weights"], np.float64).copy(), got["bias"]


def train_in_steps(rows: DataFrame, id_col: str = "id", params: StepParams = StepParams(),
                   tasks: int | None = None, segment: int = SEGMENT) -> tuple[np.ndarray, float]:
    """Weights and bias after ``params.epochs`` passes over ``rows (<id>, label 0/1, features
    array<bigint>)``, in the seeded order of :func:`labelflow.operators.batches.assign_batches`.
    Rows without a label take no part; without any row the weights are zero. ``tasks``: ranges of
    steps in which the rows are packed, by default one a shuffle partition; ``segment``: the steps of one job."""
    if params.features > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} features")
    spark = rows.sparkSession
    bounded_batches(spark)
    known = rows.where(F.col("label").isNotNull())
    ordered = checkpointed(assign_batches(known.select(id_col, "label", "features"), id_col,
                                          params.batch_size, params.accumulation, params.seed)
                           .select("pos", "step_id", F.col("label").cast("int"), "features"))
    weights, bias = np.zeros(params.features), 0.0
    last = ordered.agg(F.max("step_id")).first()[0]
    if last is None:
        return weights, bias
    by = ["step_id"] if tasks is None else [tasks, "step_id"]
    path = f"{ensure_checkpoint_dir(spark)}/steps-{uuid.uuid4().hex}"
    ordered.repartitionByRange(*by).sortWithinPartitions("step_id", "pos") \
        .select("step_id", "label", "features") \
        .mapInArrow(lambda batches: _packed(batches, segment), PACKED) \
        .write.partitionBy("segment").parquet(path)
    schema = PACKED.split(", ", 1)[1]
    for _ in range(params.epochs):
        for k in range(int(last) // segment + 1):
            steps = spark.read.schema(schema).parquet(f"{path}/segment={k}")
            weights, bias = _segment(steps, weights, bias, params)
    return weights, bias


def margins(df: DataFrame, weights: np.ndarray, bias: float, features: str = "features",
            out: str = "margin") -> DataFrame:
    """``df`` plus ``out``: the classifier's margin (above 0: label 1). The weights travel with
    the tasks; they are bounded by :data:`MAX_FEATURES`."""
    @F.pandas_udf("double")
    def score(column):
        import pandas as pd
        rows = []
        for f in column:
            f = np.asarray(f if f is not None else [], np.int64)
            where, count = np.unique(f, return_counts=True)
            rows.append(float(weights[where] @ (count / max(1, len(f)))) + bias)
        return pd.Series(rows, dtype="float64")

    return df.withColumn(out, score(F.col(features)))
