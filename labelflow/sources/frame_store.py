"""A store of encoded frames in Parquet, read by key: choose on narrow columns, decode late.

Frames arrive as files (one listing and one read of each, no decoding) or as rows with PNG bytes,
and are written clustered by ``(item_id, frame_idx)``: ranges of videos to files, frames in order
inside. With each frame go the video's frame count ``n`` and, for frames of the uniform sample,
their place in it (``sample_pos``, else NULL). Pages hold a few rows, so Parquet's column index
lets a scan that filters on a key column skip the other frames' bytes: choosing reads key columns
alone, and fetching the sample reads and decodes the sampled frames alone.

The first informative frame is found by an ordered scan: a task goes through its part of a video
in frame order and decodes no further than the first informative one. A long video is cut between
tasks; what each found is merged by an aggregate. One job, whatever the videos' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.constants import FRAMES_PER_VIDEO, VARIANCE_THRESHOLD
from labelflow.functions.png import decoder, variance_of
from labelflow.operators.frames import first_informative, sample_predicate
from labelflow.session import bounded_batches
from labelflow.sources.frames import FRAME_PATTERN, _strip_scheme

KEYS = ["item_id", "frame_idx", "n", "sample_pos"]
#: Rows of a Parquet page, and bytes of a row group.
PAGE_ROWS, GROUP_BYTES = 4, 64 << 20


def read_encoded(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """S3 without decoding: ``item_id, frame_idx, content`` of every numbered PNG under
    ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.png").load(root) \
        .select(_strip_scheme(F.col("path")).alias("path"), "content")
    files = files.filter(F.col("path").rlike(FRAME_PATTERN))
    return files.select(F.regexp_extract("path", FRAME_PATTERN, 1).alias("item_id"),
                        F.regexp_extract("path", FRAME_PATTERN, 2).cast("int").alias("frame_idx"),
                        "content")


def write_store(frames: DataFrame, path: str, k: int = FRAMES_PER_VIDEO,
                counts: DataFrame | None = None, files: int | None = None,
                page_rows: int = PAGE_ROWS) -> None:
    """Write ``frames (item_id, frame_idx, content)`` as a store with the places of a uniform sample
    of ``k``. Frames are counted from their key columns (``counts (item_id, n)`` where they are
    known, as from a listing). ``files``: ranges of (video, frame) written, by default one a
    shuffle partition; a video longer than a range goes on in the next."""
    bounded_batches(frames.sparkSession)
    n = counts if counts is not None else \
        frames.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    i = F.col("frame_idx").cast("bigint")
    place = F.expr(f"({k} * cast(frame_idx as bigint) + n - 1) div n").cast("int")
    rows = frames.join(n, "item_id").select(
        "item_id", "frame_idx", "n",
        F.when(sample_predicate(i, F.col("n"), k), place).alias("sample_pos"), "content")
    by = ["item_id", "frame_idx"]
    dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode("errorifexists") \
        .option("parquet.page.row.count.limit", str(page_rows)) \
        .option("parquet.page.size.row.check.min", str(page_rows)) \
        .option("parquet.block.size", str(GROUP_BYTES)).parquet(path)


def store_keys(spark: SparkSession, path: str) -> DataFrame:
    """The key columns; a frame's bytes are not read."""
    return spark.read.parquet(path).select(*KEYS)


def fetch_sample(spark: SparkSession, path: str, counter=None) -> DataFrame:
    """W2 / J5 over pictures: the uniform sample with decoded pixels (``image``). The filter on the
    stored place reaches the scan; only sampled frames are decoded."""
    bounded_batches(spark)
    chosen = spark.read.parquet(path).where(F.col("sample_pos").isNotNull())
    return chosen.select(*KEYS, decoder(counter)("content").alias("image"))


def fetch(spark: SparkSession, path: str, keys: DataFrame, counter=None) -> DataFrame:
    """Chosen frames with decoded pixels: ``keys (item_id, frame_idx)`` against the store by a
    semi-join, behind which frames are decoded. The keys' least and greatest frame number and
    video bound the scan."""
    low_i, high_i, low_v, high_v = keys.agg(F.min("frame_idx"), F.max("frame_idx"),
                                            F.min("item_id"), F.max("item_id")).first()
    frames = spark.read.parquet(path).select(*KEYS, "content")
    if low_i is None:
        frames = frames.limit(0)
    else:
        frames = frames.where(F.col("frame_idx").between(low_i, high_i)
                              & F.col("item_id").between(low_v, high_v))
    chosen = frames.join(keys.select("item_id", "frame_idx"), ["item_id", "frame_idx"], "left_semi")
    return chosen.select(*KEYS, decoder(counter)("content").alias("image"))


def scan_informative(spark: SparkSession, path: str, threshold: float = VARIANCE_THRESHOLD,
                     counter=None) -> DataFrame:
    """``(item_id, frame_idx, variance, readable)`` of the frames a task had to look at: its part
    of each video in order, up to the first informative frame. What stands behind it in that
    part cannot change the video's first informative frame."""
    frames = spark.read.parquet(path).select("item_id", "frame_idx", "content")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, before, found = None, -1, False
        for b in batches:
            out = []
            for at, (v, i) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if v != item or i <= before:  # another video, or another file's part
                    item, found = v, False
                before = i
                if found:
                    continue
                var = variance_of(b.column(2)[at].as_py())
                if counter is not None:
                    counter.add(1)
                out.append((v, i, var, var is not None))
                found = var is not None and var > threshold
            kinds = [b.schema.field(0).type, pa.int32(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)],
                names=["item_id", "frame_idx", "variance", "readable"])

    kind = frames.schema["item_id"].dataType.simpleString()
    return frames.mapInArrow(look, f"item_id {kind}, frame_idx int, variance double, "
                                   "readable boolean")


def first_informative_in_store(spark: SparkSession, path: str,
                               threshold: float = VARIANCE_THRESHOLD, counter=None,
                               strict: bool = False) -> DataFrame:
    """W1 over pictures: as :func:`labelflow.operators.frames.first_informative`, in one job."""
    return first_informative(scan_informative(spark, path, threshold, counter),
                             threshold=threshold, strict=strict)
