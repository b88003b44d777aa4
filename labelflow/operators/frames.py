"""Frame operators: first informative frame (W1), uniform k-sample (W2, W3, J5) and the
content gate on numeric vectors (A1).

A frame table has one row per ``(item_id, frame_idx)`` with a per-frame ``variance`` (from
:mod:`labelflow.functions.pixels` for real images) and a ``readable`` flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.constants import FRAMES_PER_VIDEO, VARIANCE_THRESHOLD

BLOCK = 62  # frame indices per bitmap block (bits 0..61 of a bigint, so bitmap + 1 fits)


def first_informative(frames: DataFrame, group: str = "item_id", idx: str = "frame_idx",
                      variance: str = "variance", readable: str | None = "readable",
                      threshold: float = VARIANCE_THRESHOLD, strict: bool = False,
                      details: bool = False) -> DataFrame:
    """Per group, the frame the reference's loop stops at.

    The loop starts at frame 0 and advances while the frame is not informative
    (``variance > threshold`` is false) and frame ``i+1`` exists. So the answer is the smallest
    informative index inside the gap-free run that starts at 0, else the last index of that run.

    Plan (one scan, no join, no window over a group). The run from 0 ends just before the
    smallest missing index (the *mex*). Frames are cut into blocks of ``BLOCK`` = 62 indices;
    one partial aggregate per ``(group, block)`` builds a bitmap of the present offsets
    (``bit_or``) and the block's first informative and first unreadable index — frames of a
    video sit together, so the map-side combine sends about one row per block, not per frame,
    and a hot video spreads over its blocks. Inside a block the first missing offset is the
    count of trailing ones of the bitmap. The first *absent* block comes from successor markers
    on the block table (62× smaller than the frames). Per group, a map-side combined aggregate
    then yields
      ``mex`` = least(first missing index of a partial block, first absent block × 62),
      ``e = mex − 1`` (end of the run from 0), ``f`` = first informative readable frame,
      ``u`` = first unreadable frame;
    answer = ``f`` if ``f <= e`` else ``e``. The frames (and their pixel variance, for real
    images) are computed once. Negative indices are not frames the loop can reach.

    Output: ``group, frame_idx, status`` with status ``ok``, ``frame 0 missing`` or
    ``unreadable frame at or before the choice`` (the reference raises for the last two; with
    ``strict`` so do we). ``details`` adds ``run_end`` (last index of the run from 0, −1 when
    frame 0 is missing) and ``first_hit`` (first informative index, anywhere).
    """
    ok_read = F.col(readable) if readable else F.lit(True)
    i = F.col(idx).cast("bigint")
    informative = ok_read & (F.col(variance) > F.lit(threshold))
    b = F.lit(BLOCK)
    per_block = frames.filter(i >= 0).groupBy(
        F.col(group).alias("_g"), F.floor(i / b).cast("bigint").alias("_b")).agg(
        # 2**offset is exact in a double for offsets below 62
        F.bit_or(F.pow(F.lit(2.0), (i % b).cast("double")).cast("bigint")).alias("_bits"),
        F.min(F.when(informative, i)).alias("_f"),
        F.min(F.when(~ok_read, i)).alias("_u"))
    # trailing ones of the bitmap = first missing offset (BLOCK when the block is full); the
    # bitmap is below 2**62, so bits + 1 cannot overflow
    trail = F.bit_count(F.col("_bits").bitwiseXOR(F.col("_bits") + 1)) - 1
    me = F.struct(F.col("_b").alias("b"), F.lit(1).alias("self"), F.lit(0).alias("nxt"),
                  trail.cast("bigint").alias("t"), F.col("_f").alias("f"),
                  F.col("_u").alias("u"))
    marker = F.struct((F.col("_b") - 1).alias("b"), F.lit(0).alias("self"),
                      F.lit(1).alias("nxt"), F.lit(None).cast("bigint").alias("t"),
                      F.lit(None).cast("bigint").alias("f"),
                      F.lit(None).cast("bigint").alias("u"))
    both = per_block.select("_g", F.explode(F.array(me, marker)).alias("r"))
    blocks = both.groupBy("_g", F.col("r.b").alias("_b")).agg(
        F.max("r.self").alias("_self"), F.max("r.nxt").alias("_nxt"), F.max("r.t").alias("_t"),
        F.min("r.f").alias("_f"), F.min("r.u").alias("_u")) \
        .filter(F.col("_self") == 1)
    g = blocks.groupBy("_g").agg(
        F.max(F.when(F.col("_b") == 0, F.lit(1)).otherwise(F.lit(0))).alias("_hasb0"),
        F.min(F.when(F.col("_t") < b, F.col("_b") * b + F.col("_t"))).alias("_partial"),
        F.min(F.when(F.col("_nxt") == 0, F.col("_b"))).alias("_lastrun"),
        F.min("_f").alias("_f"), F.min("_u").alias("_u"))
    absent = F.when(F.col("_hasb0") == 1, (F.col("_lastrun") + 1) * b).otherwise(F.lit(0))
    mex = F.least(F.col("_partial"), absent)
    agg = g.select("_g", (mex - 1).alias("_e"), F.when(mex > 0, 1).otherwise(0).alias("_has0"),
                   "_f", "_u")
    chosen = F.when(F.col("_has0") == 0, F.lit(None).cast("bigint")) \
              .when(F.col("_f").isNotNull() & (F.col("_f") <= F.col("_e")), F.col("_f")) \
              .otherwise(F.col("_e"))
    out = agg.select(F.col("_g").alias(group), chosen.cast("int").alias("frame_idx"),
                     F.col("_has0"), F.col("_u"), F.col("_e").alias("run_end"),
                     F.col("_f").alias("first_hit"))
    status = F.when(F.col("_has0") == 0, F.lit("frame 0 missing")) \
              .when(F.col("_u").isNotNull() & (F.col("_u") <= F.col("frame_idx")),
                    F.lit("unreadable frame at or before the choice")) \
              .otherwise(F.lit("ok"))
    if strict:
        status = F.when(status != "ok",
                        F.raise_error(F.concat(F.lit("Image could not be loaded: "),
                                               F.col(group).cast("string"))).cast("string")) \
                  .otherwise(status)
    extra = ["run_end", "first_hit"] if details else []
    return out.select(group, "frame_idx", status.alias("status"), *extra)


def sample_predicate(idx: Column, n: Column, k: int = FRAMES_PER_VIDEO) -> Column:
    """W2 closed form: is ``idx`` one of ``floor(j * n / k)`` for ``j`` in ``[0, k)``?

    The smallest ``j`` with ``j * n / k >= idx`` is ``ceil(k * idx / n)``; the index is taken
    iff that ``j < k`` and ``floor(j * n / k) == idx``. Integer arithmetic only."""
    some = F.greatest(n, F.lit(1))  # a count of 0 takes no frame and divides nothing
    j = _div(F.lit(k) * idx + some - F.lit(1), some)
    return (n > 0) & (j < F.lit(k)) & (_div(j * some, F.lit(k)) == idx)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def uniform_sample(frames: DataFrame, group: str = "item_id", idx: str = "frame_idx",
                   k: int = FRAMES_PER_VIDEO, out_pos: str | None = "sample_pos",
                   counts: DataFrame | None = None) -> DataFrame:
    """W2 + W3 + J5: keep the frames at ``numpy.arange(0, n, n / k).astype(int)``; every
    frame at most once, so ``n < k`` keeps all ``n`` frames; ``n = 0`` keeps nothing.

    ``n`` per group comes from a partial aggregate joined back on the group key; AQE's
    skew-join handling splits a hot group's side of that join. ``counts`` (``group, n``)
    replaces the aggregate when the counts are cheaper elsewhere — for image frames, from the
    file listing (:func:`labelflow.sources.frames.frame_counts`), so the frame table (and its
    decoding) is read once."""
    if counts is not None:
        n = counts.select(F.col(group).alias("_g"), F.col("n").alias("_n"))
    else:
        n = frames.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    j = frames.join(n, frames[group] == n["_g"], "inner")
    i = F.col(idx).cast("bigint")
    kept = j.filter(sample_predicate(i, F.col("_n"), k))
    if out_pos:
        kept = kept.withColumn(out_pos, _div(F.lit(k) * i + F.col("_n") - 1, F.col("_n"))
                               .cast("int"))
    return kept.drop("_g", "_n")


def vector_variance(vec) -> Column:
    """A1 on numeric arrays: population variance, two passes over the array (mean, then
    squared deviations), evaluated JVM-side with ``aggregate``."""
    v = F.col(vec) if isinstance(vec, str) else vec
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")) / n
    # the mean rides in the accumulator's start value, so it is computed once per array (as a
    # free expression inside the lambda it would be recomputed for every element)
    start = F.struct(mean.alias("m"), F.lit(0.0).cast("double").alias("s"))
    ss = F.aggregate(v, start, lambda a, x: F.struct(
        a["m"].alias("m"),
        (a["s"] + (x.cast("double") - a["m"]) * (x.cast("double") - a["m"])).alias("s")),
        lambda a: a["s"])
    return F.when(F.size(v) > 0, ss / n)


def is_informative(variance, threshold: float = VARIANCE_THRESHOLD) -> Column:
    """A1 gate: strictly greater than the threshold."""
    v = F.col(variance) if isinstance(variance, str) else variance
    return v > F.lit(threshold)


def videos_without_frames(items: DataFrame, counts: DataFrame, frames_col: str = "frames"
                          ) -> DataFrame:
    """W2's empty case: items whose frames directory has no frame at all (``counts``: ``item_id,
    n``), with the ``reason`` for the quarantine. A uniform sample has no row for them."""
    some = counts.filter(F.col("n") > 0).select(F.col("item_id").alias(frames_col))
    return items.filter(F.col(frames_col).isNotNull()).join(some, frames_col, "left_anti") \
        .withColumn("reason", F.lit("video without frames"))
