"""turn a still image into a 16-frame pseudo-video by random augmentation.

``augmentation_plan`` draws every random parameter JVM-side from ``md5(seed:id:k:name)``, so
a plan is reproducible and independent of partitioning (torchvision's own random stream is
not reproduced). ``apply_augmentation`` renders the plan on decoded pixels with NumPy inside
``mapInPandas`` (flip, resized crop, shift, brightness, contrast, saturation, rotation).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.constants import FRAMES_PER_VIDEO, SHUFFLE_SEED
from labelflow.session import bounded_batches

# FIXED VALUES: the augmentation ranges (rotation ±15°, flip p = 0.5, colour jitter
# brightness/contrast/saturation 0.2 and hue 0.1, resized crop scale 0.8–1.0 with aspect
# ratio 3/4–4/3, affine rotation ±10° and shift ±10 %).
# name → (low, high) of a uniform draw; "flip" is a Bernoulli draw with p = 0.5.
PARAMS: dict[str, tuple[float, float]] = {
    "rotation": (-15.0, 15.0),
    "brightness": (0.8, 1.2),
    "contrast": (0.8, 1.2),
    "saturation": (0.8, 1.2),
    "hue": (-0.1, 0.1),
    "crop_scale": (0.8, 1.0),
    "crop_log_ratio": (float(np.log(3 / 4)), float(np.log(4 / 3))),
    "crop_x": (0.0, 1.0),
    "crop_y": (0.0, 1.0),
    "affine_deg": (-10.0, 10.0),
    "shift_x": (-0.1, 0.1),
    "shift_y": (-0.1, 0.1),
}
UNIT = 4294967296.0  # 16**8: the first 8 hex digits of md5 as a fraction of this


def uniform(id_col: Column, k: Column, name: str, seed: int = SHUFFLE_SEED) -> Column:
    """A uniform draw in [0, 1) from ``md5(seed:id:k:name)``."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string"), k.cast("string"),
                          F.lit(name)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(UNIT)


def augmentation_plan(df: DataFrame, id_col: str = "id", k: int = FRAMES_PER_VIDEO,
                      seed: int = SHUFFLE_SEED, digits: int | None = None) -> DataFrame:
    """One row per ``(row, k)`` with the drawn parameters. ``explode(sequence(0, k-1))`` is a
    per-row generator: no join, and ``k`` output rows per input row."""
    frames = df.withColumn("aug_k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    idc, kc = F.col(id_col), F.col("aug_k")
    cols = [F.when(uniform(idc, kc, "flip", seed) < 0.5, F.lit(1)).otherwise(F.lit(0))
            .alias("flip")]
    for name, (lo, hi) in PARAMS.items():
        v = F.lit(lo) + F.lit(hi - lo) * uniform(idc, kc, name, seed)
        cols.append((F.round(v, digits) if digits is not None else v).alias(name))
    return frames.select("*", *cols)


def plan_sql(table: str, id_col: str, k: int = FRAMES_PER_VIDEO, seed: int = SHUFFLE_SEED,
             digits: int = 6) -> str:
    """The DuckDB twin of :func:`augmentation_plan` (for the oracle)."""
    def u(name):
        return (f"(('0x' || substr(md5('{seed}:' || CAST({id_col} AS VARCHAR) || ':' || "
                f"CAST(aug_k AS VARCHAR) || ':{name}'), 1, 8))::BIGINT / {UNIT})")
    cols = [f"CASE WHEN {u('flip')} < 0.5 THEN 1 ELSE 0 END AS flip"]
    for name, (lo, hi) in PARAMS.items():
        cols.append(f"round({lo!r} + {hi - lo!r} * {u(name)}, {digits}) AS {name}")
    return (f"SELECT {id_col}, CAST(aug_k AS INTEGER) AS aug_k, {', '.join(cols)} "
            f"FROM {table}, range({k}) r(aug_k)")


# ------------------------------------------------------------------ rendering on pixels

def _resize_bilinear(img: np.ndarray, h: int, w: int) -> np.ndarray:
    H, W = img.shape[:2]
    ys = (np.arange(h) + 0.5) * H / h - 0.5
    xs = (np.arange(w) + 0.5) * W / w - 0.5
    y0 = np.clip(np.floor(ys).astype(int), 0, H - 1)
    x0 = np.clip(np.floor(xs).astype(int), 0, W - 1)
    y1, x1 = np.clip(y0 + 1, 0, H - 1), np.clip(x0 + 1, 0, W - 1)
    wy = np.clip(ys - y0, 0, 1)[:, None, None]
    wx = np.clip(xs - x0, 0, 1)[None, :, None]
    a = img.astype(np.float64)
    top = a[y0][:, x0] * (1 - wx) + a[y0][:, x1] * wx
    bot = a[y1][:, x0] * (1 - wx) + a[y1][:, x1] * wx
    return top * (1 - wy) + bot * wy


def _moved(img: np.ndarray, deg: float, dy: float = 0.0, dx: float = 0.0) -> np.ndarray:
    """Rotation about the centre, then a shift by (dy, dx) pixels; what comes in is black."""
    H, W = img.shape[:2]
    t = np.deg2rad(deg)
    cy, cx = (H - 1) / 2, (W - 1) / 2
    yy, xx = np.mgrid[0:H, 0:W].astype(np.float64)
    yy, xx = yy - dy - cy, xx - dx - cx
    yi = np.rint(np.cos(t) * yy - np.sin(t) * xx + cy).astype(int)
    xi = np.rint(np.sin(t) * yy + np.cos(t) * xx + cx).astype(int)
    ok = (yi >= 0) & (yi < H) & (xi >= 0) & (xi < W)
    out = np.zeros_like(img)
    out[ok] = img[yi[ok], xi[ok]]
    return out


# FIXED VALUES: the NTSC luma-chroma matrix; a turn of the chroma plane turns the hue
_TO_YIQ = np.array([[0.299, 0.587, 0.114], [0.596, -0.274, -0.322], [0.211, -0.523, 0.312]])
_FROM_YIQ = np.linalg.inv(_TO_YIQ)


def _hue(f: np.ndarray, turn: float) -> np.ndarray:
    """Turn the hue by ``turn`` (a share of the full circle)."""
    c, s = np.cos(2 * np.pi * turn), np.sin(2 * np.pi * turn)
    turned = _FROM_YIQ @ np.array([[1, 0, 0], [0, c, -s], [0, s, c]]) @ _TO_YIQ
    return f @ turned.T


def render(img: np.ndarray, p: dict) -> np.ndarray:
    """Apply one plan row to an ``H×W×3`` uint8 RGB image; returns uint8 of the same size."""
    H, W = img.shape[:2]
    a = _moved(img, p["rotation"])
    if p["flip"]:
        a = a[:, ::-1]
    f = a.astype(np.float64)
    f = f * p["brightness"]
    gray = (0.299 * f[..., 0] + 0.587 * f[..., 1] + 0.114 * f[..., 2])
    f = (f - gray.mean()) * p["contrast"] + gray.mean()
    g2 = (0.299 * f[..., 0] + 0.587 * f[..., 1] + 0.114 * f[..., 2])[..., None]
    f = (f - g2) * p["saturation"] + g2
    f = _hue(f, p["hue"]) if p["hue"] else f
    area = p["crop_scale"] * H * W
    ratio = float(np.exp(p["crop_log_ratio"]))
    ch = int(min(H, max(1, round(np.sqrt(area / ratio)))))
    cw = int(min(W, max(1, round(np.sqrt(area * ratio)))))
    y = int(p["crop_y"] * (H - ch + 1)) if H > ch else 0
    x = int(p["crop_x"] * (W - cw + 1)) if W > cw else 0
    f = _resize_bilinear(f[y:y + ch, x:x + cw], H, W)
    f = _moved(f, p["affine_deg"], round(p["shift_y"] * H), round(p["shift_x"] * W))
    return np.clip(np.rint(f), 0, 255).astype(np.uint8)


def apply_augmentation(plan: DataFrame, height: str = "height", width: str = "width",
                       data: str = "data", aug: str = "aug_k") -> DataFrame:
    """Render every plan row: input columns ``height, width, data`` (RGB bytes, row-major) plus
    the plan; output adds ``aug_data`` (binary, same size). Used on a plan that was exploded and
    joined by the caller; :func:`pseudo_video` draws and renders in one step, where a picture
    crosses to Python once for all its copies."""
    names = ["flip", *PARAMS]
    fields = [F.col(n).cast("double").alias(n) for n in names]
    out = _render_udf()(F.col(height), F.col(width), F.col(data), F.array(F.struct(*fields)))
    return plan.withColumn("aug_data", out[0])


def _render_udf():
    from pyspark.sql import types as T
    names = ["flip", *PARAMS]

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def rendered(h: pd.Series, w: pd.Series, d: pd.Series, plans: pd.Series) -> pd.Series:
        out = []
        for hh, ww, raw, rows in zip(h, w, d, plans):
            if raw is None:
                out.append(None)
                continue
            img = np.frombuffer(raw, dtype=np.uint8).reshape(int(hh), int(ww), 3)
            out.append([render(img, {n: r[n] for n in names}).tobytes() for r in rows])
        return pd.Series(out, dtype="object")

    return rendered


def pseudo_video(df: DataFrame, id_col: str = "id", height: str = "height", width: str = "width",
                 data: str = "data", k: int = FRAMES_PER_VIDEO, seed: int = SHUFFLE_SEED
                 ) -> DataFrame:
    """F14 in one step: ``k`` augmented copies of every picture as rows ``aug_k, aug_data``. The
    parameters are drawn as an array beside the picture, so the picture's bytes cross Arrow once
    and the copies are exploded behind the rendering."""
    def drawn(i: Column) -> Column:
        flip = F.when(uniform(F.col(id_col), i, "flip", seed) < 0.5, 1.0).otherwise(0.0)
        rest = [(F.lit(lo) + F.lit(hi - lo) * uniform(F.col(id_col), i, n, seed)).alias(n)
                for n, (lo, hi) in PARAMS.items()]
        return F.struct(flip.alias("flip"), *rest)

    bounded_batches(df.sparkSession)
    plans = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), drawn)
    made = _render_udf()(F.col(height), F.col(width), F.col(data), plans)
    return df.withColumn("_aug", made).select(
        *[c for c in df.columns if c != data], F.posexplode("_aug").alias("aug_k", "aug_data"))
