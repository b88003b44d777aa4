"""Frame images and single images through Spark's ``image`` source.

Frames live as ``<frames dir>/<index>.png``; the index is parsed as an **integer** (string
order would put 10 before 2). Pixels are reduced to a variance right after the scan, so the
decoded bytes never enter a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions.pixels import pixel_variance, readable

# frame numbers as the reference writes them: no leading zeros, at most nine digits
FRAME_PATTERN = r"^(.*)/(0|[1-9]\d{0,8})\.png$"
# up to this many undecided directories are read by path, beyond it by file-name pattern
BY_PATH = 1000


def _strip_scheme(c):
    return F.regexp_replace(c, r"^file:(//)?", "")


def read_images(spark: SparkSession, path: str | list[str], recursive: bool = True,
                glob: str | None = None) -> DataFrame:
    """One row per image file: ``path, image`` (unreadable files kept, height −1).
    ``glob`` filters file names before any file is opened (``pathGlobFilter``)."""
    r = spark.read.format("image").option("dropInvalid", "false") \
        .option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    return df.select(_strip_scheme(F.col("image.origin")).alias("path"), "image")


def read_frames(spark: SparkSession, root: str | list[str], glob: str | None = None) -> DataFrame:
    """S3: ``item_id (frames dir), frame_idx int, variance, readable`` for every numbered PNG
    under ``root`` (only the file names matching ``glob`` when given)."""
    im = read_images(spark, root, glob=glob)
    im = im.filter(F.col("path").rlike(FRAME_PATTERN))
    return im.select(
        F.regexp_extract("path", FRAME_PATTERN, 1).alias("item_id"),
        F.regexp_extract("path", FRAME_PATTERN, 2).cast("int").alias("frame_idx"),
        pixel_variance("image").alias("variance"),
        readable("image").alias("readable"),
    )


def list_frames(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """S3 without decoding: ``item_id, frame_idx, path`` of every numbered PNG under ``root``,
    from a ``binaryFile`` listing whose ``content`` column is never selected (so no file is
    opened)."""
    ls = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.png").load(root) \
        .select(_strip_scheme(F.col("path")).alias("path"))
    ls = ls.filter(F.col("path").rlike(FRAME_PATTERN))
    return ls.select(F.regexp_extract("path", FRAME_PATTERN, 1).alias("item_id"),
                     F.regexp_extract("path", FRAME_PATTERN, 2).cast("int").alias("frame_idx"),
                     "path")


def frame_counts(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Frames per directory (``item_id, n``) from the listing: the counts the uniform sample
    (W2) needs, without decoding the images a second time."""
    return list_frames(spark, root).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def _window_glob(lo: int, hi: int) -> str:
    """A file-name pattern for frames ``lo`` to ``hi - 1``."""
    return f"{{{','.join(str(i) for i in range(lo, hi))}}}.png"


def first_informative_frames(spark: SparkSession, root: str | list[str],
                             threshold: float | None = None, chunk: int = 8,
                             strict: bool = False, max_window: int = 1024) -> DataFrame:
    """S3 + A1 + W1 with early termination, as the reference's loop stops at the first
    informative frame. Frames ``0 … chunk-1`` of every video are decoded first (a file-name glob:
    no other file is opened) and decide every video whose answer lies there. A video is undecided
    only when all frames so far exist and none is informative; its next window, twice as long, is
    decoded then (by directory when few are undecided, else by file name), and so on; a window
    beyond ``max_window`` takes all the rest. The set of videos comes from the listing, so one
    without any of the first names is reported as ``frame 0 missing``. A round ends in one small
    count on a checkpointed per-video table. Output as
    :func:`labelflow.operators.frames.first_informative`."""
    from labelflow.constants import VARIANCE_THRESHOLD
    from labelflow.operators.frames import first_informative
    from labelflow.operators.ordering import checkpointed
    thr = VARIANCE_THRESHOLD if threshold is None else threshold
    videos = list_frames(spark, root).select("item_id").distinct()
    lo, hi, where, seen, out = 0, chunk, root, None, None
    while True:
        last = hi > max_window
        part = read_frames(spark, where, glob=None if last else _window_glob(lo, hi))
        if seen is not None:  # earlier windows of the undecided videos are kept, not read again
            part = seen.unionByName(part.filter(F.col("frame_idx") >= lo)
                                    .join(videos, "item_id", "left_semi"))
        seen = checkpointed(part)
        first = checkpointed(first_informative(seen, threshold=thr, details=True))
        named = videos.join(first, "item_id", "left")
        open_ = F.lit(False) if last else F.coalesce(
            (F.col("run_end") == hi - 1) & F.col("first_hit").isNull(), F.lit(False))
        done = named.filter(~open_).select(
            "item_id", "frame_idx",
            F.coalesce("status", F.lit("frame 0 missing")).alias("status"))
        out = done if out is None else out.unionByName(done)
        undecided = checkpointed(named.filter(open_).select("item_id"))
        some = [r[0] for r in undecided.limit(BY_PATH + 1).collect()]
        if not some:
            break
        where = some if len(some) <= BY_PATH else root
        videos = undecided
        seen = seen.join(undecided, "item_id", "left_semi")
        lo, hi = hi, 2 * hi
    if strict:
        bad = F.raise_error(F.concat(F.lit("Image could not be loaded: "), F.col("item_id")))
        out = out.withColumn("status", F.when(F.col("status") != "ok", bad.cast("string"))
                             .otherwise(F.col("status")))
    return out
