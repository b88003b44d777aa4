"""Encoded pictures: a PNG reader and writer on NumPy, and expressions that decode late.

Spark's image source decodes every file it lists. Here the encoded bytes are a column, so a plan
can choose rows first and decode only those. 8-bit grayscale, RGB, palette and alpha pictures
without interlacing are read; anything else is unreadable (NULL), like a broken file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions.pixels import gray

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: colour type → values a pixel
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Rows without their filter: each is told relative to the left and upper values."""
    rows = raw.reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a zero row above, zeros to the left
    for y in range(height):
        kind, line, up = rows[y, 0], rows[y, 1:], out[y, step:]
        own = out[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            for c in range(step):
                own[step + c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            own[step:] = line + up
        elif kind in (3, 4):
            for x in range(0, stride, step):
                left = own[x:x + step].astype(np.int16)
                above = up[x:x + step].astype(np.int16)
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    corner = out[y, x:x + step].astype(np.int16)
                    p = left + above - corner
                    a, b, c = abs(p - left), abs(p - above), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                own[step + x:2 * step + x] = (line[x:x + step] + guess).astype(np.uint8)
        else:
            raise ValueError("unknown row filter")
    return out[1:, step:]


def decode_png(data: bytes | None) -> np.ndarray | None:
    """Pixels as height x width x channels in BGR order (or one gray channel), without alpha; None
    for what is no readable PNG."""
    try:
        if data is None or not data.startswith(SIGNATURE):
            return None
        at, body, palette, head = len(SIGNATURE), [], None, None
        while at + 8 <= len(data):
            size, tag = struct.unpack_from(">I4s", data, at)
            part = data[at + 8:at + 8 + size]
            if tag == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif tag == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif tag == b"IDAT":
                body.append(part)
            elif tag == b"IEND":
                break
            at += 12 + size
        width, height, depth, colour, _, _, interlaced = head
        if depth != 8 or interlaced or colour not in _CHANNELS or not width or not height:
            return None
        step = _CHANNELS[colour]
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
        px = _unfilter(raw, height, width * step, step).reshape(height, width, step)
        if colour == 3:
            px = palette[px[..., 0]]
        elif colour in (4, 6):
            px = px[..., :-1]
        return np.ascontiguousarray(px[..., ::-1])
    except (ValueError, IndexError, TypeError, struct.error, zlib.error):
        return None


def encode_png(bgr: np.ndarray) -> bytes:
    """A picture (height x width x 1 or 3, BGR) as PNG bytes."""
    height, width, channels = bgr.shape
    rows = np.zeros((height, width * channels + 1), np.uint8)
    rows[:, 1:] = bgr[..., ::-1].reshape(height, -1)

    def chunk(tag: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + tag + part \
            + struct.pack(">I", zlib.crc32(tag + part) & 0xFFFFFFFF)

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8,
                                                  2 if channels == 3 else 0, 0, 0, 0)) \
        + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


IMAGE = T.StructType([T.StructField("height", T.IntegerType()),
                      T.StructField("width", T.IntegerType()),
                      T.StructField("nChannels", T.IntegerType()),
                      T.StructField("data", T.BinaryType())])


@F.pandas_udf(T.BinaryType())
def _encoded(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series
             ) -> pd.Series:
    return pd.Series([None if d is None or h is None or h < 0 else encode_png(
        np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c)))
        for h, w, c, d in zip(height, width, channels, data)], dtype="object")


def encoded(image: str | Column = "image") -> Column:
    """An image struct as PNG bytes; NULL for an unreadable one."""
    im = F.col(image) if isinstance(image, str) else image
    return _encoded(im["height"], im["width"], im["nChannels"], im["data"])


def decoder(counter=None):
    """A ``pandas_udf`` from PNG bytes to ``height, width, nChannels, data`` (BGR, row by row; height
    -1 when unreadable). ``counter``: an accumulator that counts the pictures decoded."""
    @F.pandas_udf(IMAGE)
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            px = decode_png(data)
            rows.append((-1, -1, -1, b"") if px is None else (*px.shape, px.tobytes()))
        if counter is not None:
            counter.add(len(rows))
        return pd.DataFrame(rows, columns=IMAGE.names)

    return decode


def variance_of(data: bytes | None) -> float | None:
    """Variance of a PNG's grayscale pixels; None when unreadable."""
    px = decode_png(data)
    return None if px is None else float(np.var(gray(px)))
