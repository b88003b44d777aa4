"""Vector code compression: product codes whose entries are found by Orchard's search.

A vector is cut into equal parts; every part is replaced by the index of the nearest entry of its
own codebook. Codebooks are fitted by rounds of assignment and averaging in whole numbers, so the
result depends on no order of summing.

Nearest entries are searched by Orchard's method. Every entry has a list of all entries sorted by
their distance from it. A search holds a current entry and reads its list from the near end;
an entry already visited is skipped, a better one becomes current and the search jumps to that
one's list. By the triangle inequality nothing at more than twice the current distance from the
current entry can be nearer, so there the search stops. All parts of an Arrow batch are searched
side by side, one list place a step.

A round moves nothing but sums: each task adds up its parts by (part, entry, position), Spark
adds up the tasks, and the driver holds one codebook (parts x entries x width numbers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.common import free_name, written
from labelflow.llm.topk import _matrix

#: A label with more than one in so many rows is joined by broadcast: at most so many such labels.
HOT_SHARE = 1000
_LARGEST = (1 << 63) - 1
_WHOLE = T.DecimalType(38, 0)


class Book:
    """One part's codebook with the sorted neighbour list of every entry."""

    def __init__(self, entries: list[list[int]]):
        width = len(entries[0]) if entries else 0
        self.top = max((abs(c) for e in entries for c in e), default=0)
        self.width = width
        self._exact = np.array(entries, object).reshape(len(entries), width)
        self._kinds: dict = {}

    def _lists(self, kind):
        if kind not in self._kinds:
            e = self._exact.astype(kind)
            gap = _squares(e[:, None, :] - e[None, :, :])
            near = np.array([sorted(range(len(e)), key=lambda j: (gap[i, j], j))
                             for i in range(len(e))])
            self._kinds[kind] = e, near, np.take_along_axis(gap, near, axis=1)
        return self._kinds[kind]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every row and its squared distance; ties to the lower
        index. ``x`` holds int64; sums that could leave 62 bits are taken in exact integers."""
        n, top = len(x), max(self.top, int(np.abs(x.astype(object)).max(initial=0))
                             if x.dtype == object else int(np.abs(x).max(initial=0)))
        kind = np.int64 if 16 * self.width * top * top < 1 << 62 else object
        entries, near, far = self._lists(kind)
        x = x.astype(kind)
        at, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = _squares(x - entries[0])
        seen = np.zeros((n, len(entries)), bool)
        seen[:, 0] = True
        live = np.arange(n)
        while len(live):
            live = live[place[live] < len(entries)]
            # at exactly twice the distance an equally near entry of a lower index may stand
            reach = far[at[live], place[live]] <= 4 * best[live]
            live = live[reach.astype(bool)]
            other = near[at[live], place[live]]
            place[live] += 1
            fresh = ~seen[live, other]
            rows, other = live[fresh], other[fresh]
            seen[rows, other] = True
            d = _squares(x[rows] - entries[other])
            nearer = (d < best[rows]) | ((d == best[rows]) & (other < at[rows]))
            nearer = nearer.astype(bool)
            rows = rows[nearer]
            at[rows], best[rows], place[rows] = other[nearer], d[nearer], 0
        return at, best


def _squares(diff: np.ndarray) -> np.ndarray:
    return (diff * diff).sum(axis=-1)


def _parts(column, width: int, parts: int) -> np.ndarray:
    """Vectors of a batch as (row, part, position); shorter vectors end in zeros."""
    m = _matrix(pa.chunked_array([column]))
    m = np.pad(m, ((0, 0), (0, parts * width - m.shape[1])))
    return m.reshape(len(m), parts, width)


def _first_entries(vectors: DataFrame, id_col: str, vector_col: str, parts: int, width: int,
                   entries: int) -> list[list[list[int]]]:
    first = vectors.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{vector_col}`").alias("v")) \
        .orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    rows = [[*r["v"], *[0] * (parts * width - len(r["v"]))] for r in first]
    return [[row[p * width:(p + 1) * width] for row in rows] for p in range(parts)]


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "vector", parts: int = 8,
        entries: int = 16, rounds: int = 6) -> list[list[list[int]]]:
    """Codebooks ``[part][entry][position]`` of integer vectors. A part's codebook starts as that
    part of the vectors under the smallest ids (equal ids: the smaller vector first, null ids
    last); each round assigns every part to its nearest entry and replaces an entry by the floor
    of its parts' mean; an entry without any stays. With fewer vectors than entries there are
    as many entries as vectors; without any there are none. ``vectors`` is read once a round."""
    size = vectors.agg(F.max(F.size(f"`{vector_col}`"))).first()[0]
    if size is None:
        return [[] for _ in range(parts)]
    width = -(-size // parts)
    books = _first_entries(vectors, id_col, vector_col, parts, width, entries)
    sent = vectors.select(F.col(f"`{vector_col}`").alias("v"))
    schema = "part int, entry int, place int, n bigint, total decimal(38,0)"
    for _ in range(rounds):
        def add_up(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            search = [Book(b) for b in books]
            count = np.zeros((parts, len(books[0])), object)
            total = np.zeros((parts, len(books[0]), width), object)
            for b in batches:
                x = _parts(b.column(0), width, parts)
                wide = int(np.abs(x).max(initial=0)) > 1 << 40  # a batch's sum may leave 64 bits
                for p in range(parts):
                    at, _ = search[p].nearest(x[:, p])
                    for e in np.unique(at):
                        own = x[at == e, p]
                        count[p, e] += len(own)
                        total[p, e] += (own.astype(object) if wide else own).sum(0) \
                            .astype(object)
            got = [(p, e, j, int(count[p, e]), Decimal(int(total[p, e, j])))
                   for p in range(parts) for e in range(len(books[0])) if count[p, e]
                   for j in range(width)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)],
                names=["part", "entry", "place", "n", "total"])

        sums = sent.mapInArrow(add_up, schema).groupBy("part", "entry", "place") \
            .agg(F.sum("n").alias("n"), F.sum("total").cast(_WHOLE).alias("total")).collect()
        books = [[list(e) for e in b] for b in books]
        for r in sums:
            books[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return books


def encode(vectors: DataFrame, books: list[list[list[int]]], vector_col: str = "vector",
           code: str = "code", error: str = "error") -> DataFrame:
    """``vectors`` without ``vector_col``, plus ``code`` (array of entry indexes, a part each)
    and ``error`` (squared distances summed over the parts; what leaves 64 bits counts as the
    largest long). Columns named like results are replaced; nothing is shuffled."""
    names = [c for c in vectors.columns if c not in (vector_col, code, error)]
    schema = T.StructType([*[vectors.schema[c] for c in names],
                           T.StructField(code, T.ArrayType(T.IntegerType())),
                           T.StructField(error, T.LongType())])
    parts = len(books)
    width = len(books[0][0]) if books and books[0] else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        for b in batches:
            x = _parts(b.column(len(names)), width, parts)
            got = [search[p].nearest(x[:, p]) for p in range(parts)]
            at = np.stack([g[0] for g in got], axis=1).astype(np.int32)
            far = sum(g[1].astype(object) for g in got)
            codes = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], codes,
                 pa.array([min(int(f), _LARGEST) for f in far], pa.int64())],
                names=[*names, code, error])

    return vectors.select(*[F.col(f"`{c}`") for c in [*names, vector_col]]) \
        .mapInArrow(run, schema)


def with_key_total(df: DataFrame, key_col: str, value_col: str, out: str) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value_col`` over all rows of an equal key (nulls are
    equal). The totals are partial sums before their exchange. Keys with more than a thousandth of
    the rows are at most a thousand and joined by broadcast, so a key with a third of all rows
    stays where it is; any other key's rows meet their total by an exchange."""
    key, total, n = (free_name(df, s) for s in ("_key", "_total", "_n"))
    least = F.least(F.sum(F.col(f"`{value_col}`").cast(_WHOLE)), F.lit(_LARGEST).cast(_WHOLE))
    sums = written(df.groupBy(F.col(f"`{key_col}`").alias(key))
                   .agg(least.cast("bigint").alias(total), F.count(F.lit(1)).alias(n)), "totals")
    rows = sums.agg(F.sum(n)).first()[0] or 0
    hot = sums.where(F.col(n) * HOT_SHARE > rows)
    rest = sums.where(F.col(n) * HOT_SHARE <= rows)
    names = [F.col(f"`{c}`") for c in df.columns if c != out]
    same = F.col(f"`{key_col}`").eqNullSafe(F.col(key))
    joined = df.join(F.broadcast(hot), same, "left")
    far = df.join(F.broadcast(hot), same, "left_anti").join(rest, same)
    return joined.where(F.col(n).isNotNull()).select(*names, F.col(total).alias(out)) \
        .unionByName(far.select(*names, F.col(total).alias(out)))


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
    text = ",".join(str(c) for b in books for e in b for c in e)
    return hashlib.sha256(text.encode()).hexdigest()


def hex_code(code: str = "code") -> Column:
    """A code array as text: two hex digits a part."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "vector",
             label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6
             ) -> tuple[DataFrame, list[list[list[int]]]]:
    """``df`` (integer vectors) coded by codebooks fitted on it, and the codebooks: every column
    but ``vector_col``, plus ``code``, ``error`` and ``label_error`` (errors summed over rows of an
    equal label, nulls together). Null vectors take no part and are not returned; components
    missing from a shorter vector count as zero, also where the length is no multiple of
    ``parts``; repeated rows and ids are rows of their own; an empty table gives no rows; other
    columns pass through, those named like the results are replaced."""
    used = df.where(F.col(f"`{vector_col}`").isNotNull())
    books = fit(used, id_col, vector_col, parts, entries, rounds)
    if not books[0]:
        none = used.drop("code", "error", "label_error", vector_col).limit(0)
        return none.withColumns({"code": F.lit(None).cast("array<int>"),
                                 "error": F.lit(None).cast("bigint"),
                                 "label_error": F.lit(None).cast("bigint")}), books
    coded = written(encode(used, books, vector_col), "codes")
    return with_key_total(coded, label_col, "error", "label_error"), books
