"""How certain a difference between training regimes is.

Poisson bootstrap: in every replicate a row counts 0, 1, 2, ... times, drawn from its id by md5, so
replicates need no order, no driver and no second pass, and all regimes see the same draws (the
differences are paired). All replicates of all regimes are one aggregation of whole-number sums
with partial sums before the shuffle; what follows has ``regimes x replicates`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.constants import SHUFFLE_SEED

#: FIXED VALUES: 65536 x P(X <= k) for a Poisson variable of mean 1, rounded down, k = 0, 1, ...
POISSON_STEPS = (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535)
#: Draws from one digest: 32 hex digits, four a draw.
DRAWS = 8
#: Shares are taken in so many parts, so that ranks are whole numbers without rounding.
TAILS = 2000


def _tail(level: float) -> int:
    """Parts of ``TAILS`` left out on either side."""
    return (TAILS - round(TAILS * level)) // 2


def digest(id_col: Column, block: Column, seed: int = SHUFFLE_SEED) -> Column:
    """The digest of a row's replicates ``8 * block`` to ``8 * block + 7``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string"), block.cast("string")))


def places(digest: Column) -> Column:
    """The eight numbers below 65536 in a digest."""
    return F.array(*[F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("int")
                     for k in range(DRAWS)])


def count_at(u: Column) -> Column:
    """How often a row is drawn that has the number ``u``."""
    return sum(((u >= t).cast("bigint") for t in POISSON_STEPS[1:]),
               (u >= POISSON_STEPS[0]).cast("bigint"))


def replicates(scored: DataFrame, by: str = "regime", id_col: str = "id", label: str = "label",
               pred: str = "pred", n: int = 200, seed: int = SHUFFLE_SEED) -> DataFrame:
    """``(<by>, replicate, rows, right)``: drawn rows and right answers; replicate -1 counts every
    row once. A NULL prediction is wrong, as in the report; NULL ids share their draws."""
    right = F.coalesce((F.col(pred) == F.col(label)).cast("bigint"), F.lit(0))
    each = scored.select(F.col(by), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_i"),
                         right.alias("_r"))
    # one pass over the scored rows, block -1 for the row as it is; a digest is a column of its own
    # below the generator, which would work out its input anew for each of the eight numbers
    blocks = each.select(by, "_i", "_r", F.explode(
        F.sequence(F.lit(-1), F.lit(-(-n // DRAWS) - 1))).alias("_b"))
    numbers = blocks.select(by, "_r", "_b", digest(F.col("_i"), F.col("_b"), seed).alias("_d")) \
        .select(by, "_r", "_b", F.posexplode(places(F.col("_d"))).alias("_k", "_u"))
    whole = F.col("_b") == -1
    drawn = numbers.select(
        by, "_r",
        F.when(whole, -1).otherwise(F.col("_b") * DRAWS + F.col("_k")).cast("int").alias("replicate"),
        F.when(whole, F.when(F.col("_k") == 0, 1).otherwise(0)).otherwise(count_at(F.col("_u")))
         .cast("bigint").alias("_w")).where((F.col("replicate") < n) & (F.col("_w") > 0))
    return drawn.groupBy(by, "replicate").agg(
        F.sum("_w").alias("rows"), F.sum(F.col("_w") * F.col("_r")).alias("right"))


def compare(scored: DataFrame, by: str = "regime", id_col: str = "id", label: str = "label",
            pred: str = "pred", n: int = 200, level: float = 0.95, seed: int = SHUFFLE_SEED
            ) -> DataFrame:
    """For every pair of regimes ``first < second``: ``difference`` of their accuracies, the
    interval ``low`` to ``high`` that holds the ``level`` middle share of the replicates'
    differences (nearest ranks), and ``significant``: it does not hold 0."""
    reps = replicates(scored, by, id_col, label, pred, n, seed)
    rate = F.col("right").cast("double") / F.col("rows").cast("double")
    one = reps.select(F.col(by).alias("first"), "replicate", rate.alias("a"))
    two = reps.select(F.col(by).alias("second"), "replicate", rate.alias("b"))
    diffs = one.join(two, "replicate").where(F.col("first") < F.col("second")) \
        .select("first", "second", "replicate", (F.col("a") - F.col("b")).alias("d"))
    # places from the count: a replicate that draws no row of a small set has no rate
    w = Window.partitionBy("first", "second")
    drawn = diffs.where(F.col("replicate") >= 0) \
        .withColumn("r", F.row_number().over(w.orderBy("d"))) \
        .withColumn("m", F.count(F.lit(1)).over(w))
    tail = _tail(level)

    def at(share: int) -> Column:
        place = F.floor((F.col("m") * share + TAILS - 1) / TAILS)
        return F.max(F.when(F.col("r") == F.greatest(place, F.lit(1)), F.col("d")))

    ranges = drawn.groupBy("first", "second").agg(at(tail).alias("low"),
                                                  at(TAILS - tail).alias("high"))
    whole = diffs.where(F.col("replicate") == -1).select("first", "second",
                                                         F.col("d").alias("difference"))
    return whole.join(ranges, ["first", "second"], "left").withColumn(
        "significant", (F.col("low") > 0) | (F.col("high") < 0))


def compare_sql(source: str, by: str = "regime", n: int = 200, level: float = 0.95,
                seed: int = SHUFFLE_SEED) -> str:
    """The DuckDB twin of :func:`compare` over a relation ``source (<by>, id, label, pred)``; to
    follow a ``WITH`` list."""
    u = "('0x' || substr(md5('{seed}:' || coalesce(CAST(id AS VARCHAR), '') || ':' || CAST(b // {k} AS VARCHAR)), " \
        "4 * (b % {k}) + 1, 4))::BIGINT".format(seed=seed, k=DRAWS)
    weight = " + ".join(f"CASE WHEN {u} >= {t} THEN 1 ELSE 0 END" for t in POISSON_STEPS)
    tail = _tail(level)
    return f""", boot AS (
  SELECT {by} AS g, CAST(b AS BIGINT) AS b, {weight} AS w, CASE WHEN pred = label THEN 1 ELSE 0 END AS ok
  FROM {source}, range({n}) r(b)
  UNION ALL SELECT {by}, -1, 1, CASE WHEN pred = label THEN 1 ELSE 0 END FROM {source}
), rate AS (
  SELECT g, b, CAST(sum(w * ok) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS a FROM boot WHERE w > 0 GROUP BY g, b
), diff AS (
  SELECT x.g AS first, y.g AS second, x.b, x.a - y.a AS d FROM rate x JOIN rate y ON y.b = x.b AND x.g < y.g
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY first, second ORDER BY d) AS r,
         count(*) OVER (PARTITION BY first, second) AS m FROM diff WHERE b >= 0
), span AS (
  SELECT first, second, max(CASE WHEN r = greatest((m * {tail} + {TAILS - 1}) // {TAILS}, 1) THEN d END) AS low,
         max(CASE WHEN r = greatest((m * {TAILS - tail} + {TAILS - 1}) // {TAILS}, 1) THEN d END) AS high FROM placed GROUP BY first, second
)
SELECT diff.first, diff.second, diff.d AS difference, low, high, low > 0 OR high < 0 AS significant
FROM diff LEFT JOIN span ON span.first = diff.first AND span.second = diff.second WHERE diff.b = -1"""
