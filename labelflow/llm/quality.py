"""Quality classifier: hashed word n-gram logistic regression trained with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

A text's words are its runs of non-space bytes. Features are the hashes of single words, word
pairs, word shapes (the punctuation at a word's edge and its letter case), five-word echoes (which
of the four words before equal this one) and the text's length class, modulo ``2**bits``; a
feature's value is the root of its share of the text's features of that kind, so a long text
weighs as much as a short one. No other column is ever an input.

Training reads a bounded, documented sample: the ``max_rows`` labelled rows with the smallest
seeded hash of their key. Whole texts are learnt from, as they are scored: their features are made
in many tasks and written, as sparse vectors, to the shared folder. An epoch is a job of one task
that reads them in the epoch's own seeded order and holds one vector and the sums of its
``2**bits`` weights at a time; the sums go from epoch to epoch through the driver. The model is
``2**bits`` doubles, a size that does not grow with the data, and is sent to the tasks as a broadcast
variable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.common import free_name, released, text_or_empty, written

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Entries of a vector that travel in one row, so that no Arrow batch grows with a text.
PIECE = 4096


@dataclass(frozen=True)
class FtrlParams:
    """Fit settings. ``max_rows`` bounds the training sample."""
    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.01
    epochs: int = 4
    max_rows: int = 8000
    seed: int = 11


class _WordCodes(dict):
    """Word → (word hash, shape hash) packed in one integer; words repeat, so hashes are kept
    (up to a bound, then the table starts afresh)."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.rstrip(".,;:!?\"')($%&*#@-_=+<>[]{}|/\\~^`")
        tail = text[len(core):][:3]
        case = ("u" if len(core) > 1 and core.isupper() else
                "t" if core[:1].isupper() else
                "d" if core.isdigit() else
                "a" if core.isalpha() else "x")
        shape = zlib.crc32(f"{case}|{tail}".encode())
        code = (zlib.crc32(word) << 32) | shape
        self[word] = code
        return code


_CODES = _WordCodes()


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a text: (sorted feature indices, values). An empty text has none."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    code = np.fromiter(map(_CODES.__getitem__, words), np.uint64, n)
    word, shape = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
    pair = (word[:-1] * _MIX + word[1:]) * _MIX
    # which of the four words before equal this one: the shape of its n-gram
    echo = np.zeros(n, np.uint64)
    for lag in range(1, min(5, n)):
        echo[lag:] |= (word[lag:] == word[:-lag]).astype(np.uint64) << np.uint64(lag)
    length = np.array([n.bit_length()], np.uint64)
    kinds = [word * _MIX, (shape * _MIX) ^ np.uint64(0x5851F42D4C957F2D), pair,
             (echo + np.uint64(1 << 40)) * _MIX, (length + np.uint64(1 << 41)) * _MIX]
    shift = np.uint64(64 - bits)
    index = np.concatenate([k >> shift for k in kinds]).astype(np.int64)
    value = np.concatenate([np.full(len(k), w / max(1, len(k)))
                            for k, w in zip(kinds, (1.0, 1.0, 0.5, 1.0, 0.1))])
    order = np.argsort(index, kind="stable")
    index, value = index[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[first], np.sqrt(np.add.reduceat(value, first))


def vector_rows(h: int, k: str, y: int, i: np.ndarray, x: np.ndarray
                ) -> Iterator[pa.RecordBatch]:
    """A vector in pieces of at most ``PIECE`` entries, one row each (an empty one is one row)."""
    for part, lo in enumerate(range(0, max(1, len(i)), PIECE)):
        yield pa.RecordBatch.from_pydict({
            "h": pa.array([h], pa.int64()), "k": pa.array([k], pa.string()),
            "part": pa.array([part], pa.int32()), "y": pa.array([y], pa.int32()),
            "i": pa.array([i[lo:lo + PIECE].astype("<i4").tobytes()], pa.binary()),
            "x": pa.array([x[lo:lo + PIECE].astype("<f8").tobytes()], pa.binary())})


class Ftrl:
    """FTRL-proximal sums of a logistic regression; the last weight is the bias."""

    def __init__(self, p: FtrlParams, z: np.ndarray | None = None, n: np.ndarray | None = None):
        dim = (1 << p.bits) + 1
        self.p = p
        self.z = np.zeros(dim) if z is None else z.copy()
        self.n = np.zeros(dim) if n is None else n.copy()

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        p, zi, ni = self.p, self.z[i], self.n[i]
        w = -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= p.l1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        """One update with a sparse vector and its label."""
        i, x = np.append(i, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(i)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        grown = self.n[i] + g * g
        self.z[i] += g - (np.sqrt(grown) - np.sqrt(self.n[i])) / self.p.alpha * w
        self.n[i] = grown


def joined_vectors(rows: Iterable[tuple[int, str, int, bytes, bytes]]
                   ) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Vectors from rows ``(h, k, y, i, x)`` in which a vector's pieces follow one another."""
    own, key, label = [], None, 0

    def vector():
        return (np.concatenate([np.frombuffer(i, "<i4") for i, _ in own]),
                np.concatenate([np.frombuffer(x, "<f8") for _, x in own]), label)

    for h, k, y, i, x in rows:
        if key is not None and (h, k) != key:
            yield vector()
            own = []
        key, label = (h, k), y
        own.append((i, x))
    if key is not None:
        yield vector()


def sample_keys(labels: DataFrame, params: FtrlParams, key_col: str = "doc_id",
                label_col: str = "label") -> DataFrame:
    """At most ``max_rows`` labelled keys ``(k, h, y)``: those with the smallest seeded hash. Only
    the key and label columns are read. A key labelled more than once counts once, with its
    smallest label; null keys and labels take no part."""
    rows = labels.select(F.col(key_col).alias("k"), F.col(label_col).cast("int").alias("y")) \
        .where("k IS NOT NULL AND y IS NOT NULL").groupBy("k").agg(F.min("y").alias("y")) \
        .withColumn("h", F.xxhash64(F.lit(params.seed), F.col("k")))
    total = rows.count()
    # a hash threshold first (with room to spare), so that few rows reach the final top-k
    if total > 2 * params.max_rows:
        share = 1.5 * params.max_rows / total
        rows = rows.where(F.col("h") < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.orderBy("h", "k").limit(params.max_rows)


def fit(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(),
        text_col: str = "text", label_col: str = "label", key_col: str = "doc_id") -> np.ndarray:
    """Train on a bounded sample of the labelled documents (see the module docstring). A null
    text is an empty one; of several texts under one key the smallest is learnt from. Without
    labelled rows all weights are zero and every score is 0.5."""
    keys = F.broadcast(sample_keys(labels, params, key_col, label_col))  # at most max_rows rows
    texts = docs.select(F.col(key_col).alias("k"), text_or_empty(text_col).alias("t"))
    sample = texts.join(keys, "k").groupBy("k", "h", "y").agg(F.min("t").alias("t"))

    bits = params.bits

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, k, t, y in zip(*(b[c] for c in ("h", "k", "t", "y"))):
                yield from vector_rows(h.as_py(), k.as_py(), y.as_py(),
                                       *features(t.as_py(), bits))

    sparse = written(
        sample.select("h", F.col("k").cast("string").alias("k"), "t", "y")
        .mapInArrow(vectors, "h bigint, k string, part int, y int, i binary, x binary"), "vectors")
    model = Ftrl(params)
    for epoch in range(params.epochs):
        def train(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for r in zip(*(b[c].to_pylist()
                                                      for c in ("h", "k", "y", "i", "x"))))
            for i, x, y in joined_vectors(rows):
                model.learn(i, x, y)
            yield pa.RecordBatch.from_pydict({"z": pa.array([model.z.tobytes()], pa.binary()),
                                              "n": pa.array([model.n.tobytes()], pa.binary())})

        # one task, at most max_rows vectors: read and sorted where they are read
        order = F.xxhash64(F.lit(params.seed + epoch), "h", "k")
        got = sparse.coalesce(1).sortWithinPartitions(order, "h", "k", "part") \
            .mapInArrow(train, "z binary, n binary").collect()
        if got:
            model = Ftrl(params, *(np.frombuffer(got[0][c], np.float64) for c in ("z", "n")))
    return model.weights()


def score(df: DataFrame, weights: np.ndarray, params: FtrlParams = FtrlParams(),
          text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` plus ``out``: the probability of label 1 for every whole text (null: empty; an
    empty text gets the score of the bias). Every other column passes through untouched."""
    text = free_name(df, "_t")
    names = [c for c in df.columns if c != out]
    sent = df.select(*[F.col(f"`{c}`") for c in names], text_or_empty(text_col).alias(text))
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(weights)
    bits = params.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            got = np.empty(b.num_rows)
            for r, t in enumerate(b.column(len(names)).to_pylist()):
                i, x = features(t, bits)
                got[r] = w[i] @ x + w[-1]
            got = 1.0 / (1.0 + np.exp(-np.clip(got, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(got)],
                                             names=[*names, out])
        released(None)

    return sent.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """True where the row is kept from learning (false for a null key)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
