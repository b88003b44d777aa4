"""M1 / M2: fitted models in a shared folder, shipped to the workers, loaded once by each.

A model is a few named arrays. :func:`save_model` writes them, in chunks, as a Parquet folder on
any file system that Spark reaches. :func:`load_model_fn` reads that folder with Spark, checks it
against the digest in it, broadcasts its bytes (each executor fetches them once, from whatever file
system and on any master) and gives a loader that a Python worker runs once: it checks the bytes
again and makes the arrays, so a worker never scores with a half-written or exchanged model. A path
without a model means the base model.
"""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

from labelflow.operators.predict import path_exists

CHUNK = 1 << 20
#: Bytes of a model: it passes through the driver and lies in every worker.
MAX_BYTES = 1 << 30
DIGEST = "sha256"


def _digest(arrays: dict[str, bytes]) -> str:
    h = hashlib.sha256()
    for name in sorted(arrays):
        h.update(f"{name}:{len(arrays[name])}:".encode())
        h.update(arrays[name])
    return h.hexdigest()


def save_model(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> str:
    """Write a model's arrays as a new folder ``path``; gives their digest. A folder without
    Spark's success mark, as a stopped job leaves it, is no model."""
    packed = {}
    for name, a in arrays.items():
        if name == DIGEST:
            raise ValueError(f"{DIGEST!r} is no name for an array")
        out = io.BytesIO()
        np.save(out, np.asarray(a), allow_pickle=False)
        packed[name] = out.getvalue()
    if sum(map(len, packed.values())) > MAX_BYTES:
        raise ValueError(f"a model has at most {MAX_BYTES} bytes")
    digest = _digest(packed)
    rows = [(name, k, bytearray(data[k * CHUNK:(k + 1) * CHUNK])) for name, data in packed.items()
            for k in range(-(-len(data) // CHUNK))]
    rows.append((DIGEST, 0, bytearray(digest.encode())))
    spark.createDataFrame(rows, "name string, part int, data binary").coalesce(1) \
        .write.mode("errorifexists").parquet(path)
    return digest


def has_model(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


#: A worker's own models, made once: the last few.
_MADE: dict[tuple[str, str], dict[str, np.ndarray]] = {}


def _arrays(folder: str, digest: str, shipped=None) -> dict[str, np.ndarray]:
    """A model's arrays from its broadcast bytes, made once in a worker."""
    if (folder, digest) not in _MADE:
        packed = shipped.value if shipped is not None else {}
        if _digest(packed) != digest:
            raise RuntimeError(f"the model in {folder} is not the one that was shipped")
        while len(_MADE) >= 4:
            del _MADE[next(iter(_MADE))]
        _MADE[folder, digest] = {n: np.load(io.BytesIO(d), allow_pickle=False)
                                 for n, d in packed.items()}
    return _MADE[folder, digest]


def load_model_fn(spark: SparkSession, path: str, build: Callable[[dict], Callable]
                  ) -> Callable[[], Callable]:
    """A ``make_fn`` (see :mod:`labelflow.operators.predict`) for the model in ``path``: the folder
    is read and shipped now; ``build(arrays)`` makes the predictor on each worker."""
    parts: dict[str, list] = {}
    for r in spark.read.parquet(path).toLocalIterator():
        parts.setdefault(r["name"], []).append((r["part"], bytes(r["data"])))
    packed = {n: b"".join(d for _, d in sorted(p)) for n, p in parts.items()}
    digest = packed.pop(DIGEST, b"").decode()
    if not digest:
        raise ValueError(f"no model in {path}")
    folder = os.path.basename(path.rstrip("/"))
    if _digest(packed) != digest:
        raise RuntimeError(f"the model in {folder} is not the one that was saved")
    shipped = spark.sparkContext.broadcast(packed)
    return lambda: build(_arrays(folder, digest, shipped))


def tuned_or_base(spark: SparkSession, path: str | None, build: Callable[[dict], Callable],
                  base_fn: Callable[[], Callable]) -> Callable[[], Callable]:
    """M2: the tuned model's ``make_fn`` where ``path`` holds one, else the base model's (and says
    so when a path was given)."""
    if path is None:
        return base_fn
    if has_model(spark, path):
        return load_model_fn(spark, path, build)
    print(f"{path} not exist.")
    return base_fn
