"""Row filters, media routing and quarantine.

All are narrow transformations (no shuffle) except ``resolve_media``, which joins the items to
one chosen frame per frames directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions.prompts import frame_path_col


def train_split(df: DataFrame, type_col: str = "type") -> DataFrame:
    """Rows whose type is not ``test``; a NULL type is kept (Python ``None != 'test'``)."""
    return df.filter(~F.col(type_col).eqNullSafe("test"))


def test_split(df: DataFrame, type_col: str = "type") -> DataFrame:
    """Rows whose type is ``test``."""
    return df.filter(F.col(type_col) == "test")


def labelled(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Drop rows without a label."""
    return df.filter(F.col(label_col).isNotNull())


def exemplar_rows(df: DataFrame, ids, id_col: str = "id") -> DataFrame:
    """Rows whose id is in the exemplar list (a short literal list → ``isin``; a DataFrame
    of ids → left-semi join, which AQE broadcasts when small)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col,
                       "left_semi")
    return df.filter(F.col(id_col).isin(list(ids)))


def is_mp4(path) -> Column:
    """P5: the last three characters are ``mp4`` (case-sensitive, no dot needed)."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.right(c, F.lit(3)) == F.lit("mp4"), F.lit(False))


def media_kind(df: DataFrame, video: str = "video", out: str = "kind") -> DataFrame:
    """``video`` when the media path is an mp4 file, else ``image``."""
    return df.withColumn(out, F.when(is_mp4(video), F.lit("video")).otherwise(F.lit("image")))


def media_col(mode: str = "video") -> Column:
    """The media field a mode reads (``video`` falls back to ``image``)."""
    if mode == "video":
        return F.coalesce(F.col("video"), F.col("image"))
    if mode == "image":
        return F.col("image")
    raise ValueError(f"unknown mode {mode!r}")


def resolve_media(items: DataFrame, chosen: DataFrame | None = None,
                  frames_col: str = "frames") -> DataFrame:
    """P6 + J4: an item with a frames directory takes the chosen frame as its image; an item
    without a ``video`` value (or column) uses its image as video.

    ``chosen`` is :func:`labelflow.operators.frames.first_informative` output (one row per
    directory: ``item_id, frame_idx, status``). Items whose directory has no frame 0 get status
    ``frame 0 missing`` (the reference raises); items without a directory get ``ok``.
    """
    out = items
    if "video" not in out.columns:
        out = out.withColumn("video", F.lit(None).cast("string"))
    if chosen is not None:
        c = chosen.select(F.col("item_id").alias("_dir"), F.col("frame_idx").alias("_fidx"),
                          F.col("status").alias("_fstatus"))
        out = out.join(c, out[frames_col] == c["_dir"], "left")
        has_dir = F.col(frames_col).isNotNull()
        out = out.withColumn(
            "status",
            F.when(~has_dir, F.lit("ok"))
             .when(F.col("_dir").isNull(), F.lit("frame 0 missing"))
             .otherwise(F.col("_fstatus")))
        out = out.withColumn(
            "image",
            F.when(has_dir & F.col("_fidx").isNotNull(),
                   frame_path_col(F.col(frames_col), F.col("_fidx")))
             .otherwise(F.col("image")))
        out = out.drop("_dir", "_fidx", "_fstatus")
    else:
        out = out.withColumn("status", F.lit("ok"))
    return out.withColumn("video", F.coalesce(F.col("video"), F.col("image")))


def tagged(df: DataFrame, reason: Column, out: str = "reason") -> DataFrame:
    """P9 as one frame: ``out`` is NULL on good rows. Both outputs can be written from it (persist
    it, or write it partitioned by ``out IS NULL``) while the pipeline before it is planned and
    run once."""
    return df.withColumn(out, reason)


def quarantine(df: DataFrame, reason: Column, strict: bool = False):
    """Split rows into ``(good, bad)``; ``bad`` carries the ``reason``.

    The reference drops undecodable media silently (bare ``except: continue``); here nothing is
    dropped silently: bad rows are returned for the caller to write. With ``strict`` a bad row
    raises instead, as the still-image path does."""
    tagged = df.withColumn("_reason", reason)
    if strict:
        tagged = tagged.withColumn(
            "_reason", F.when(F.col("_reason").isNotNull(),
                              F.raise_error(F.concat(F.lit("Image could not be loaded: "),
                                                     F.col("_reason"))).cast("string")))
        # the filter keeps the check alive: an unused column would be pruned away
        return tagged.filter(F.col("_reason").isNull()).drop("_reason"), None
    good = tagged.filter(F.col("_reason").isNull()).drop("_reason")
    bad = tagged.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return good, bad
