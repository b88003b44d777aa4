"""F14 + P5: every item as a short video, in one relation.

An item whose media is an mp4 gives its video's uniform sample of frames; any other item gives as
many augmented copies of its picture. Frames come from a frame store (only sampled ones are read and
decoded), copies are drawn and rendered beside the picture; both arrive as rows of one shape.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.constants import FRAMES_PER_VIDEO, SHUFFLE_SEED
from labelflow.functions.augment import pseudo_video
from labelflow.operators.rows import is_mp4
from labelflow.session import bounded_batches


def short_videos(items: DataFrame, sampled: DataFrame, pictures: DataFrame,
                 k: int = FRAMES_PER_VIDEO, seed: int = SHUFFLE_SEED) -> DataFrame:
    """``(id, source, pos, height, width, data)`` for ``items (id, media, frames)``: ``source`` is
    ``frame`` or ``copy``, ``data`` the pixels (RGB, row by row). ``sampled (item_id, sample_pos,
    image)`` is what :func:`labelflow.sources.frame_store.fetch_sample` gives (BGR), met by the
    item's ``frames`` directory; ``pictures (id, image)`` are decoded pictures (BGR structs). An item
    without a readable picture or any frame has no rows; NULL media is no mp4."""
    bounded_batches(items.sparkSession)
    videos = items.where(is_mp4("media")).select("id", "frames")
    frames = videos.join(sampled, videos["frames"] == sampled["item_id"]) \
        .where(F.col("image.height") > 0) \
        .select("id", F.lit("frame").alias("source"), F.col("sample_pos").alias("pos"),
                F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                rgb("image").alias("data"))
    stills = items.where(~is_mp4("media")).select("id").join(pictures, "id") \
        .where(F.col("image.height") > 0) \
        .select("id", F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                rgb("image").alias("data"))
    copies = pseudo_video(stills, "id", k=k, seed=seed).select(
        "id", F.lit("copy").alias("source"), F.col("aug_k").alias("pos"), "height", "width",
        F.col("aug_data").alias("data"))
    return frames.unionByName(copies)


@F.pandas_udf(T.BinaryType())
def _turned(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    out = []
    for h, w, c, d in zip(height, width, channels, data):
        px = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))
        out.append((px[..., 2::-1] if c >= 3 else np.repeat(px[..., :1], 3, axis=2)).tobytes())
    return pd.Series(out, dtype="object")


def rgb(image: str) -> Column:
    """RGB bytes of a readable BGR (or gray) image struct."""
    im = F.col(image)
    return _turned(im["height"], im["width"], im["nChannels"], im["data"])
