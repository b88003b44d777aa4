"""Pixel work on Spark's ``image`` struct: grayscale (F12), variance gate (A1), resize.

Spark's image source decodes PNG/JPEG into ``origin, height, width, nChannels, mode, data``
with **BGR** bytes, row-major; an unreadable file has height −1. The UDFs are Arrow-batched
(``pandas_udf``): decoded pixels cross to Python once per batch, not per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _to_array(height, width, channels, data) -> np.ndarray | None:
    if data is None or height is None or height < 0:
        return None
    a = np.frombuffer(data, dtype=np.uint8)
    c = int(channels)
    return a.reshape(int(height), int(width), c)


def gray(img: np.ndarray) -> np.ndarray:
    """luma 0.299 R + 0.587 G + 0.114 B (input BGR), rounded to uint8 like an 8-bit
    grayscale decode."""
    if img.shape[2] == 1:
        return img[..., 0]
    b, g, r = img[..., 0].astype(np.float64), img[..., 1].astype(np.float64), img[..., 2].astype(np.float64)
    return np.clip(np.rint(0.299 * r + 0.587 * g + 0.114 * b), 0, 255).astype(np.uint8)


@F.pandas_udf(T.DoubleType())
def _gray_variance(height: pd.Series, width: pd.Series, channels: pd.Series,
                   data: pd.Series) -> pd.Series:
    out = []
    for h, w, c, d in zip(height, width, channels, data):
        img = _to_array(h, w, c, d)
        out.append(None if img is None else float(np.var(gray(img))))
    return pd.Series(out, dtype="float64")


def pixel_variance(image="image") -> Column:
    """A1: population variance of the grayscale pixels; NULL for an unreadable image."""
    im = F.col(image) if isinstance(image, str) else image
    return _gray_variance(im["height"], im["width"], im["nChannels"], im["data"])


def readable(image="image") -> Column:
    im = F.col(image) if isinstance(image, str) else image
    return im["height"] >= 0


def _resize_rgb(img: np.ndarray, side: int) -> np.ndarray:
    from labelflow.functions.augment import _resize_bilinear
    rgb = img[..., ::-1] if img.shape[2] >= 3 else np.repeat(img, 3, axis=2)
    return np.clip(np.rint(_resize_bilinear(rgb[..., :3], side, side)), 0, 255).astype(np.uint8)


def resize_udf(side: int):
    """decode → RGB → ``side × side`` bilinear (NumPy; close to, not bit-equal with PIL)."""
    @F.pandas_udf(T.BinaryType())
    def _resize(height: pd.Series, width: pd.Series, channels: pd.Series,
                data: pd.Series) -> pd.Series:
        out = []
        for h, w, c, d in zip(height, width, channels, data):
            img = _to_array(h, w, c, d)
            out.append(None if img is None else _resize_rgb(img, side).tobytes())
        return pd.Series(out, dtype="object")
    return _resize


def prepare_images(df, image: str = "image", side: int = 560, out: str = "pixels"):
    """F13 on a DataFrame: ``out`` = RGB bytes of ``side × side`` (NULL when unreadable)."""
    im = F.col(image)
    return df.withColumn(out, resize_udf(side)(im["height"], im["width"], im["nChannels"],
                                               im["data"]))
