"""Quality rules: base rules, then robust multivariate outliers.

Every document gets four statistics of its whole text, transformed so that ordinary documents lie
about one centre: the log of the mean word length, the log of one plus the percentage of symbols,
and the square roots of the shares of repeated lines and of words in repeated three-word windows,
in whole thousandths.

For every group (language and source) the centre and covariance of the ordinary half are
estimated by the minimum covariance determinant: from two starts around the medians, concentration
steps replace the estimate by mean and covariance of the half of the group's documents nearest to
it (Mahalanobis distance), which never enlarges the determinant; the start that ends with the
smaller one is taken, and one more estimate over all documents within the 97.5 % distance makes it
efficient. A document further away than the 99.99 % distance is rejected.

A step is one aggregation over narrow rows: counts, sums and products by group and distance bin,
with partial sums before the shuffle, in whole numbers, so no order of summing matters; the bins
up to the one that completes the half are then added up. No group is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.common import join_counted, text_or_empty, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
WINDOW = 3
#: Transformed statistics, in thousandths, and the least spread each is taken to have.
DIMS = 4
FLOORS = (50, 200, 200, 200)
#: Groups with fewer documents that pass the base rules are pooled.
MIN_ROWS = 100
#: Distance bins: so many to a doubling of 1 + squared distance, and at most so many.
BINS, MOST_BINS = 64, 4096
#: Shares of ordinary documents within the distances of the last estimate and of the verdict.
REWEIGHT, WITHIN = 0.975, 0.9999
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_PAIRS = list(combinations_with_replacement(range(DIMS), 2))


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:1 - WINDOW]
    for k in range(1, WINDOW):  # numbers of windows one word longer, always below the text's size
        pair = key * len(number) + ids[k:len(ids) - WINDOW + 1 + k]
        _, key = np.unique(pair, return_inverse=True)
    again = np.bincount(key)[key] > 1
    mark = np.zeros(len(words), bool)
    for k in range(WINDOW):
        mark[k:len(words) - WINDOW + 1 + k] |= again
    return int(mark.sum())


def text_stats(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the lines with a word."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), chars, symbols, len(lines) - len(set(lines)), _repeat_words(words),
            len(lines))


def transformed(stats: tuple[int, ...]) -> tuple[int, ...]:
    """The statistics' vector in thousandths; of a text without words all zero."""
    n, chars, symbols, dup, rep, lines = stats
    if not n:
        return (0,) * DIMS
    return tuple(round(1000 * x) for x in (math.log(chars / n), math.log1p(100 * symbols / chars),
                                           math.sqrt(dup / lines), math.sqrt(rep / n)))


def _within(x: float, dims: int) -> float:
    """Chi-square distribution function, for an even number of dimensions."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half ** k / math.factorial(k) for k in range(dims // 2))


def quantile(share: float, dims: int = DIMS) -> float:
    """Chi-square quantile, for an even number of dimensions."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _within(mid, dims) < share else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """What makes the covariance of the nearest ``share`` of normal rows that of them all."""
    return 1.0 if share >= 1 else share / _within(quantile(share), DIMS + 2)


def estimate(n: int, total: int, sums: list[int], products: list[int]
             ) -> tuple[list[float], list[float], float]:
    """Centre, inverse covariance (by pairs) and log determinant from whole-number sums over
    ``n`` of ``total`` rows; every statistic's spread is at least its floor."""
    factor = consistency(n / total)
    cov = np.zeros((DIMS, DIMS))
    for (i, j), q in zip(_PAIRS, products):
        cov[i, j] = cov[j, i] = factor * ((n * q - sums[i] * sums[j]) / (n * n))
    return _inverse([s / n for s in sums], cov)


def _inverse(centre: list[float], cov: np.ndarray):
    cov = cov + np.diag([float(f * f) for f in FLOORS])
    inverse = np.linalg.inv(cov)
    return centre, [float(inverse[i, j]) for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1])


def _stats(df: DataFrame, groups: list[str], text_col: str, drop: list[str]) -> DataFrame:
    """``(row, g, <stats>, base_failed, z)``: other columns as one struct, the group as text."""
    others = [c for c in df.columns if c != text_col and c not in drop]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
    g = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"g{k}")
                             for k, c in enumerate(groups)]))
    sent = df.select(row.alias("row"), g.alias("g"), text_or_empty(f"`{text_col}`").alias("t"))
    schema = T.StructType([sent.schema["row"], T.StructField("g", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in STATS],
                           *[T.StructField(f"z{k}", T.LongType()) for k in range(DIMS)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_stats(t.as_py()) for t in b.column(2)]
            z = [transformed(s) for s in got]
            cols = [pa.array([s[k] for s in got], pa.int64()) for k in range(len(STATS))]
            cols += [pa.array([v[k] for v in z], pa.int64()) for k in range(DIMS)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols],
                                             names=[f.name for f in schema])

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return sent.mapInArrow(run, schema).withColumn("base_failed", failed)


def _keys(sound: DataFrame, levels: int, min_rows: int) -> DataFrame:
    """``(g, n, key)``: the group whose estimate holds for ``g``: its own; with fewer than
    ``min_rows`` sound documents that of all such groups of its first columns, and so on up to
    that of all groups; null where even these are too few. ``n``: documents of ``g``."""
    left = sound.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    done = None
    for level in range(levels, -1, -1):
        shape = F.array(*[F.get_json_object("g", f"$.g{k}") for k in range(level)]) \
            if level else F.array().cast("array<string>")
        named = left.withColumn("key", F.concat(F.lit(f"{level}:"), F.to_json(F.struct(
            shape.alias("k")), {"ignoreNullFields": "false"})))
        sizes = named.groupBy("key").agg(F.sum("n").alias("together"))
        named = written(named.join(sizes, "key"), "keys")
        large = named.where(F.col("together") >= min_rows).select("g", "n", "key")
        done = large if done is None else done.unionByName(large)
        left = named.where(F.col("together") < min_rows).select("g", "n")
    return done.unionByName(left.withColumn("key", F.lit(None).cast("string")))


def _distance() -> Column:
    """Squared Mahalanobis distance of the z columns from the joined estimate."""
    off = [F.col(f"z{k}") - F.col(f"m{k}") for k in range(DIMS)]
    return sum(((1 if i == j else 2) * F.col(f"i{i}{j}") * off[i] * off[j]
                for i, j in _PAIRS[1:]), F.col("i00") * off[0] * off[0])


_ESTIMATE = [*[f"m{k}" for k in range(DIMS)], *[f"i{i}{j}" for i, j in _PAIRS], "det"]
_SCHEMA = "key string, n bigint, start int, " + ", ".join(f"{c} double" for c in _ESTIMATE)


def _to_estimates(sums: DataFrame, make) -> DataFrame:
    """A row for each row that ``make(row)`` gives; tables of a few numbers a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [out for r in b.to_pylist() for out in make(r)]
            kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.float64()] * len(_ESTIMATE)]
            names = ["key", "n", "start", *_ESTIMATE]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t)
                                              for k, t in enumerate(kinds)], names=names)

    return written(sums.mapInArrow(run, _SCHEMA), "estimates")


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates a key: around the medians, with the spreads' robust estimates (median
    absolute deviations) and with the floors alone. Medians come from counts by value."""
    value = F.posexplode(F.array(*[f"z{k}" for k in range(DIMS)])).alias("d", "v")
    hist = written(rows.select("key", value).groupBy("key", "d", "v")
                   .agg(F.count(F.lit(1)).alias("n")), "values")

    def median(counts: DataFrame, out: str) -> DataFrame:
        w = Window.partitionBy("key", "d")
        run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        return counts.select("key", "d", "v", F.sum("n").over(run).alias("upto"),
                             F.sum("n").over(w).alias("total")) \
            .where(2 * F.col("upto") >= F.col("total")) \
            .groupBy("key", "d").agg(F.min("v").alias(out), F.max("total").alias("n"))

    mid = median(hist, "mid")
    away = hist.join(mid.select("key", "d", "mid"), ["key", "d"]) \
        .groupBy("key", "d", F.abs(F.col("v") - F.col("mid")).alias("v")).agg(F.sum("n").alias("n"))
    both = mid.join(median(away, "mad").drop("n"), ["key", "d"])
    one = both.groupBy("key").agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("d") == k, F.col(c))).alias(f"{c}{k}")
        for k in range(DIMS) for c in ("mid", "mad")])

    def make(r):
        centre = [float(r[f"mid{k}"]) for k in range(DIMS)]
        spreads = ([(1.4826 * r[f"mad{k}"]) ** 2 for k in range(DIMS)], [0.0] * DIMS)
        for start, spread in enumerate(spreads):
            m, inv, det = _inverse(centre, np.diag(spread))
            yield (r["key"], r["n"], start, *m, *inv, det)

    return _to_estimates(one, make)


def _step(rows: DataFrame, estimates: DataFrame, total: int, within: float | None = None
          ) -> DataFrame:
    """The next estimates: over the half of a key's rows nearest to the present one, or over all
    rows within a squared distance."""
    met = join_counted(rows, estimates, "key", "n", total).withColumn("d2", _distance())
    if within is not None:
        met = met.where(F.col("d2") <= within)
    bin_ = F.least(F.floor(BINS * F.log2(1 + F.greatest("d2", F.lit(0.0)))), F.lit(MOST_BINS))
    sums = [F.count(F.lit(1)).alias("c"), F.max("n").alias("n"),
            *[F.sum(f"z{k}").alias(f"s{k}") for k in range(DIMS)],
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in _PAIRS]]
    binned = met.groupBy("key", "start", bin_.cast("int").alias("bin")).agg(*sums)
    if within is None:
        before = Window.partitionBy("key", "start").orderBy("bin") \
            .rowsBetween(Window.unboundedPreceding, -1)
        half = F.floor((F.col("n") + DIMS + 1) / 2)
        binned = binned.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0))) \
            .where(F.col("below") < half)
    added = binned.groupBy("key", "start").agg(
        F.max("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in
                                 ["c", *[f"s{k}" for k in range(DIMS)],
                                  *[f"q{i}{j}" for i, j in _PAIRS]]])

    def make(r):
        m, inv, det = estimate(int(r["c"]), r["n"] if within is None else int(r["c"]),
                               [int(r[f"s{k}"]) for k in range(DIMS)],
                               [int(r[f"q{i}{j}"]) for i, j in _PAIRS])
        yield (r["key"], r["n"], r["start"], *m, *inv, det)

    return _to_estimates(added, make)


def fit(rows: DataFrame, total: int, steps: int = 6) -> DataFrame:
    """Estimates by key for ``rows (key, z0..z3)``, ``total`` in number."""
    found = _starts(rows)
    for _ in range(steps):
        found = _step(rows, found, total)
    w = Window.partitionBy("key").orderBy("det", "start")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).drop("r")
    return _step(rows, best, total, within=quantile(REWEIGHT))


def judge(df: DataFrame, groups: tuple[str, ...] = ("lang", "source"), text_col: str = "text",
          steps: int = 6, min_rows: int = MIN_ROWS) -> DataFrame:
    """``df`` without ``text_col``, plus the statistics (``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``), ``base_failed``, ``distance`` (squared;
    null where ``base_failed`` or no estimate) and ``kept``.

    The estimates rest on the documents that pass the base rules; a group with fewer than
    ``min_rows`` of them shares one estimate with the other small groups of its language, then with
    those of all languages; where even these are too few, the base rules alone decide. Null
    languages and sources are values like any other; null and empty texts fail the base rules;
    repeated rows count and are judged each; an empty table gives no rows; columns named like
    results are replaced, all others pass through. Eager: narrow tables go to the shared folder."""
    results = [*STATS, "base_failed", "distance", "kept"]
    others = [c for c in df.columns if c != text_col and c not in results]
    rows = written(_stats(df, list(groups), text_col, results), "stats")
    sound = rows.where(~F.col("base_failed"))
    z = [f"z{k}" for k in range(DIMS)]
    keys = written(_keys(sound, len(groups), min_rows), "groups")
    total = keys.agg(F.sum("n")).first()[0] or 0
    keyed = written(join_counted(sound.drop("base_failed"), keys, "g", "n", total).drop("g", "n"),
                    "keyed")
    found = fit(keyed.where(F.col("key").isNotNull()).select("key", *z), total, steps)
    far = join_counted(keyed.where(F.col("key").isNotNull()), found, "key", "n", total) \
        .withColumn("distance", _distance())
    out = ["row", *STATS, "base_failed", "distance", "kept"]
    no = F.lit(None).cast("double")
    parts = [
        far.select("row", *STATS, F.lit(False).alias("base_failed"), "distance",
                   (F.col("distance") <= quantile(WITHIN)).alias("kept")),
        keyed.where(F.col("key").isNull()).select(
            "row", *STATS, F.lit(False).alias("base_failed"), no.alias("distance"),
            F.lit(True).alias("kept")),
        rows.where("base_failed").select("row", *STATS, "base_failed", no.alias("distance"),
                                         F.lit(False).alias("kept"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*out)
    return both.select(*[F.col("row").getField(c).alias(c) for c in others], *out[1:])
