"""F13 with smoothing, and F12 / A1 in whole numbers.

Resizing is two passes, along rows and then along columns, with a triangle kernel that widens with
the factor when a picture shrinks, so every input pixel counts. Coefficients are fixed-point
numbers that add up to exactly one: a picture of one colour keeps it, and results do not depend on
floating-point order.

Grayscale values are whole numbers by fixed-point weights. A picture's moments (pixels, their sum,
their sum of squares) are whole numbers too, so those of tiles add up to those of the picture, and
"variance above a threshold" is decided without rounding.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.constants import VARIANCE_THRESHOLD

#: Bits of a coefficient's fraction.
BITS = 22
#: FIXED VALUES: grayscale weights of red, green and blue in 1/16384 (0.299, 0.587, 0.114).
GRAY_BITS, GRAY = 14, (4899, 9617, 1868)


@lru_cache(64)
def coefficients(size: int, out: int) -> np.ndarray:
    """``out x size`` fixed-point weights; every row adds up to ``1 << BITS``."""
    factor = size / out
    reach = max(1.0, factor)
    at = np.arange(size) + 0.5
    table = np.zeros((out, size), np.int64)
    for x in range(out):
        weight = np.maximum(0.0, 1.0 - np.abs(at - (x + 0.5) * factor) / reach)
        table[x] = np.floor(weight / weight.sum() * (1 << BITS)).astype(np.int64)
        table[x, int(weight.argmax())] += (1 << BITS) - table[x].sum()
    table.setflags(write=False)
    return table


def resample(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """A uint8 picture (height x width x channels) in another size."""
    half = 1 << BITS - 1
    rows = np.einsum("xj,yjc->yxc", coefficients(img.shape[1], width), img.astype(np.int64))
    rows = np.clip((rows + half) >> BITS, 0, 255)
    both = np.einsum("yi,ixc->yxc", coefficients(img.shape[0], height), rows)
    return np.clip((both + half) >> BITS, 0, 255).astype(np.uint8)


def shrink_images(df: DataFrame, image: str = "image", side: int = 560, out: str = "pixels"
                  ) -> DataFrame:
    """``out`` = RGB bytes of ``side x side``, smoothed; NULL for an unreadable picture."""
    @F.pandas_udf(T.BinaryType())
    def resized(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series
                ) -> pd.Series:
        got = []
        for h, w, c, d in zip(height, width, channels, data):
            if d is None or h is None or h < 1 or w < 1:
                got.append(None)
                continue
            px = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))
            rgb = px[..., 2::-1] if c >= 3 else np.repeat(px[..., :1], 3, axis=2)
            got.append(resample(rgb, side, side).tobytes())
        return pd.Series(got, dtype="object")

    im = F.col(image)
    return df.withColumn(out, resized(im["height"], im["width"], im["nChannels"], im["data"]))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "s1", "s2")]))
def _moments(channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = []
    for c, d in zip(channels, data):
        px = np.frombuffer(d if d is not None else b"", np.uint8).astype(np.int64)
        if c is not None and c >= 3:
            px = px.reshape(-1, int(c))
            r, g, b = GRAY
            px = (r * px[:, 2] + g * px[:, 1] + b * px[:, 0] + (1 << GRAY_BITS - 1)) >> GRAY_BITS
        rows.append((len(px), int(px.sum()), int((px * px).sum())))
    return pd.DataFrame(rows, columns=["n", "s1", "s2"])


def image_moments(df: DataFrame, key: str, image: str = "image", band_bytes: int = 1 << 20
                  ) -> DataFrame:
    """``(<key>, n, s1, s2)``: pixels of each key's pictures, the sum of their gray values and of
    the values' squares. A picture is cut into bands of whole rows of about ``band_bytes``, which
    go to Python one by one, and their moments are added up; an unreadable picture has
    ``n = 0``. Pictures that share a key (NULL too) are added up together."""
    im = F.col(image)
    stride = F.greatest(im["width"].cast("bigint") * im["nChannels"], F.lit(1).cast("bigint"))
    per = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(band_bytes) / stride))
    height = F.greatest(F.coalesce(im["height"], F.lit(0)), F.lit(0)).cast("bigint")
    bands = F.greatest(F.ceil(height / per), F.lit(1).cast("bigint"))
    cut = df.select(key, im["nChannels"].alias("_c"), im["data"].alias("_d"),
                    (per * stride).alias("_size"), height.alias("_h"),
                    F.explode(F.sequence(F.lit(0).cast("bigint"), bands - 1)).alias("_k"))
    band = F.when(F.col("_h") > 0, F.substring(
        "_d", (F.col("_k") * F.col("_size") + 1).cast("int"), F.col("_size").cast("int")))
    told = cut.select(key, _moments(F.col("_c"), band).alias("m"))
    return told.groupBy(key).agg(*[F.sum(f"m.{c}").alias(c) for c in ("n", "s1", "s2")])


def above_threshold(n: Column, s1: Column, s2: Column, threshold: int = int(VARIANCE_THRESHOLD)
                    ) -> Column:
    """A1 on moments: whether the population variance exceeds a whole threshold, exactly."""
    n, s1, s2 = (c.cast("decimal(19,0)") for c in (n, s1, s2))
    return n * s2 - s1 * s1 > F.lit(threshold).cast("decimal(9,0)") * n * n
