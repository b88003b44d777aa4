"""S3, S4, A1, F12, F13, F14 on PNG files written here (zlib + struct; no imaging library)."""

import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from labelflow.functions.augment import augmentation_plan, apply_augmentation
from labelflow.functions.pixels import prepare_images
from labelflow.operators.frames import first_informative
from labelflow.sources.frames import read_frames, read_images


def write_png(path, rgb: np.ndarray):
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(tag, data):
        c = struct.pack(">I", len(data)) + tag + data
        return c + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + \
        chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(png)


def flat(v):
    return np.full((8, 8, 3), v, dtype=np.uint8)


def noisy(seed):
    return np.random.default_rng(seed).integers(0, 256, (8, 8, 3), dtype=np.uint8)


def test_frames_scan_and_choice(spark, tmp_path):
    root = str(tmp_path)
    # v12: 12 frames, only no. 11 informative (10 must sort after 2)
    for i in range(12):
        write_png(f"{root}/v12/{i}.png", noisy(i) if i == 11 else flat(10 * i))
    # vgap: frame 2 missing, informative frame 3 unreachable → last of run = 1
    for i in (0, 1, 3):
        write_png(f"{root}/vgap/{i}.png", noisy(i) if i == 3 else flat(5))
    # vbad: unreadable frame 1 after the informative frame 0 → fine
    write_png(f"{root}/vbad/0.png", noisy(7))
    with open(f"{root}/vbad/1.png", "wb") as f:
        f.write(b"not a png")
    fr = read_frames(spark, root)
    got = {r.item_id.split("/")[-1]: (r.frame_idx, r.status) for r in first_informative(fr).collect()}
    assert got["v12"] == (11, "ok")
    assert got["vgap"] == (1, "ok")
    assert got["vbad"] == (0, "ok")


def test_variance_is_grayscale_population(spark, tmp_path):
    img = noisy(3)
    write_png(f"{tmp_path}/v/0.png", img)
    r = read_frames(spark, str(tmp_path)).collect()[0]
    g = np.clip(np.rint(0.299 * img[..., 0] + 0.587 * img[..., 1] + 0.114 * img[..., 2]), 0, 255)
    assert abs(r.variance - float(np.var(g))) < 1e-9
    assert r.readable


def test_prepare_images_size(spark, tmp_path):
    write_png(f"{tmp_path}/a.png", noisy(1))
    df = prepare_images(read_images(spark, str(tmp_path)), side=16)
    px = df.collect()[0].pixels
    assert len(px) == 16 * 16 * 3


def test_augmentation_plan_and_render(spark, tmp_path):
    write_png(f"{tmp_path}/a.png", noisy(2))
    im = read_images(spark, str(tmp_path)).select(
        F.lit("a").alias("id"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.reverse(F.col("image.data")).alias("data_rev"),
        F.col("image.data").alias("data"))
    plan = augmentation_plan(im.drop("data_rev"), "id")
    rows = plan.collect()
    assert len(rows) == 16 and sorted(r.aug_k for r in rows) == list(range(16))
    assert all(-15 <= r.rotation <= 15 and 0.8 <= r.crop_scale <= 1.0 for r in rows)
    assert plan.collect() == augmentation_plan(im.drop("data_rev").repartition(3), "id").collect()
    out = apply_augmentation(plan).collect()
    assert all(len(r.aug_data) == 8 * 8 * 3 for r in out)


NEUTRAL = {"flip": 0, "rotation": 0.0, "brightness": 1.0, "contrast": 1.0, "saturation": 1.0,
           "hue": 0.0, "crop_scale": 1.0, "crop_log_ratio": 0.0, "crop_x": 0.0, "crop_y": 0.0,
           "affine_deg": 0.0, "shift_x": 0.0, "shift_y": 0.0}


def test_each_augmentation_parameter_alone():
    from labelflow.functions.augment import _TO_YIQ, render
    img = np.random.default_rng(3).integers(30, 200, (16, 16, 3), dtype=np.uint8)
    assert (render(img, NEUTRAL) == img).all()

    def one(**kw):
        return render(img, {**NEUTRAL, **kw}).astype(int)

    assert (one(flip=1) == img[:, ::-1]).all()
    assert abs(one(brightness=1.2) - np.rint(img * 1.2)).max() <= 1
    gray = img @ np.array([0.299, 0.587, 0.114])
    assert abs(one(contrast=0.8) - ((img - gray.mean()) * 0.8 + gray.mean())).max() <= 1
    assert abs(one(saturation=0.8) - ((img - gray[..., None]) * 0.8 + gray[..., None])).max() <= 1
    for turn in (-0.1, -0.08, 0.06, 0.1):  # the hue turns, the luma stays
        got = one(hue=turn)
        assert (got != img).any()
        a, b = (x.astype(float) @ _TO_YIQ.T for x in (img, got))
        inside = ((got > 0) & (got < 255)).all(axis=2)
        assert abs(a[..., 0] - b[..., 0])[inside].max() < 1.5
        angle = np.angle((b[..., 1] + 1j * b[..., 2]) / (a[..., 1] + 1j * a[..., 2]))
        strong = inside & (np.hypot(a[..., 1], a[..., 2]) > 40)
        assert abs(angle[strong] - 2 * np.pi * turn).max() < 0.06
    right = one(shift_x=0.125)  # two columns, black comes in
    assert (right[:, :2] == 0).all() and (right[:, 2:] == img[:, :-2]).all()
    down = one(shift_y=-0.125)
    assert (down[-2:] == 0).all() and (down[:-2] == img[2:]).all()
    assert (one(rotation=90.0) == np.rot90(img, -1)).all() or (one(rotation=90.0) == np.rot90(img)).all()
    assert (one(crop_scale=0.8) != img).any() and (one(affine_deg=10.0) != img).any()


def test_pseudo_video_equals_plan_then_render(spark, tmp_path):
    from labelflow.functions.augment import pseudo_video
    rows = [(f"p{i}", 6, 5, bytes(np.random.default_rng(i).integers(0, 256, 90, dtype=np.uint8)))
            for i in range(3)] + [("none", None, None, None)]
    df = spark.createDataFrame(rows, "id string, height int, width int, data binary")
    a = {(r.id, r.aug_k): bytes(r.aug_data) for r in pseudo_video(df).collect()}
    b = {(r.id, r.aug_k): bytes(r.aug_data) for r in
         apply_augmentation(augmentation_plan(df.filter("data IS NOT NULL"), "id")).collect()}
    assert a == b and len(a) == 48


def test_uniform_sample_with_listing_counts(spark, tmp_path):
    from labelflow.operators.frames import uniform_sample
    from labelflow.sources.frames import frame_counts, list_frames
    root = str(tmp_path)
    for i in range(20):
        write_png(f"{root}/v20/{i}.png", flat(i))
    for i in range(3):
        write_png(f"{root}/v3/{i}.png", flat(i))
    listed = sorted((r.item_id.split("/")[-1], r.frame_idx) for r in list_frames(spark, root).collect())
    assert listed == sorted([("v20", i) for i in range(20)] + [("v3", i) for i in range(3)])
    fr = read_frames(spark, root)
    a = sorted(tuple(r) for r in uniform_sample(fr, counts=frame_counts(spark, root))
               .select("item_id", "frame_idx", "sample_pos").collect())
    b = sorted(tuple(r) for r in uniform_sample(fr).select("item_id", "frame_idx", "sample_pos")
               .collect())
    assert a == b
    assert [x[1] for x in a if x[0].endswith("v20")] == [0, 1, 2, 3, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 18]


def test_first_informative_early_termination(spark, tmp_path):
    from labelflow.sources.frames import first_informative_frames
    root = str(tmp_path)
    for i in range(12):      # only no. 11 informative: needs the second pass
        write_png(f"{root}/late/{i}.png", noisy(i) if i == 11 else flat(3 * i))
    for i in range(10):      # informative at 2: decided by the first chunk
        write_png(f"{root}/early/{i}.png", noisy(i) if i == 2 else flat(1))
    for i in (0, 1, 2, 4, 5):    # gap at 3: run ends at 2
        write_png(f"{root}/gap/{i}.png", flat(i) if i != 4 else noisy(4))
    for i in range(1, 4):    # no frame 0
        write_png(f"{root}/nozero/{i}.png", noisy(i))
    want = {r.item_id: (r.frame_idx, r.status) for r in first_informative(read_frames(spark, root)).collect()}
    for chunk in (2, 4, 8, 16):
        got = {r.item_id: (r.frame_idx, r.status)
               for r in first_informative_frames(spark, root, chunk=chunk).collect()}
        assert got == want, chunk
    assert {k.split("/")[-1]: v for k, v in want.items()} == {
        "late": (11, "ok"), "early": (2, "ok"), "gap": (2, "ok"), "nozero": (None, "frame 0 missing")}
    # directories without any of the first names, padded and long numeric names
    for name in ("8", "9"):
        write_png(f"{root}/vb/{name}.png", noisy(1))
    for name in ("00", "01", "20240101123456"):
        write_png(f"{root}/vc/{name}.png", noisy(1))
    write_png(f"{root}/vd/0.png", noisy(1))
    write_png(f"{root}/vd/00.png", flat(1))
    want = {r.item_id: (r.frame_idx, r.status) for r in first_informative(read_frames(spark, root)).collect()}
    for chunk in (1, 4, 8):
        got = {r.item_id: (r.frame_idx, r.status)
               for r in first_informative_frames(spark, root, chunk=chunk).collect()}
        assert got == want, chunk
    assert {k.split("/")[-1]: v for k, v in want.items() if "/v" in k} == {
        "vb": (None, "frame 0 missing"), "vd": (0, "ok")}
    # all decided in the first chunk: no second pass needed, same answer
    sub = f"{root}/early"
    got = {r.item_id: r.frame_idx for r in first_informative_frames(spark, sub, chunk=4).collect()}
    assert list(got.values()) == [2]


def test_first_informative_early_termination_strict(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException
    from labelflow.sources.frames import first_informative_frames
    root = str(tmp_path)
    for i in range(1, 3):    # frame 0 missing: the reference raises
        write_png(f"{root}/nozero/{i}.png", noisy(i))
    write_png(f"{root}/fine/0.png", noisy(0))
    with pytest.raises(PySparkException):
        first_informative_frames(spark, root, strict=True).collect()
    ok = first_informative_frames(spark, f"{root}/fine", strict=True).collect()
    assert [(r.frame_idx, r.status) for r in ok] == [(0, "ok")]
