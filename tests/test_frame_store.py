"""S3, S4, W1, W2, J5 over pictures: choose on key columns, decode late."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.functions.png import decode_png, encode_png, encoded
from labelflow.operators.frames import first_informative, uniform_sample
from labelflow.sources import frame_store as FS
from labelflow.sources.frames import frame_counts, read_frames, read_images

from .test_images import flat, noisy, write_png


def videos(root):
    rng = np.random.default_rng(5)
    for v, n, hit in [("a", 40, 33), ("b", 16, 0), ("c", 5, None), ("d", 130, 100), ("e", 1, None)]:
        for i in range(n):
            if (v, i) == ("d", 70):
                continue  # a gap before the informative frame
            write_png(f"{root}/{v}/{i}.png", noisy(i) if i == hit else flat(int(rng.integers(200))))
    with open(f"{root}/c/2.png", "wb") as f:
        f.write(b"broken")
    write_png(f"{root}/f/1.png", noisy(1))  # frame 0 missing
    with open(f"{root}/f/x.txt", "w") as f:
        f.write("no frame")


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    for shape in [(3, 5, 3), (1, 1, 1), (7, 2, 1)]:
        img = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (decode_png(encode_png(img)) == img).all()
    for bad in (None, b"", b"\x89PNG\r\n\x1a\n", encode_png(img)[:40], b"GIF89a"):
        assert decode_png(bad) is None


@pytest.mark.parametrize("kind", range(5))
def test_png_row_filters(kind):
    import struct
    import zlib
    rng = np.random.default_rng(kind)
    img = rng.integers(0, 256, (6, 4, 3), dtype=np.uint8)
    raw, prev = b"", np.zeros(12, int)
    for y in range(6):
        line = img[y].reshape(-1).astype(int)
        left = np.concatenate([[0] * 3, line[:-3]])
        corner = np.concatenate([[0] * 3, prev[:-3]])
        p = left + prev - corner
        near = [min(((abs(p[k] - left[k]), 0, left[k]), (abs(p[k] - prev[k]), 1, prev[k]),
                     (abs(p[k] - corner[k]), 2, corner[k])))[2] for k in range(12)]
        guess = [0 * left, left, prev, (left + prev) // 2, np.array(near)][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        prev = line

    def chunk(tag, part):
        return struct.pack(">I", len(part)) + tag + part + struct.pack(">I", zlib.crc32(tag + part))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0)) \
        + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (decode_png(png) == img[..., ::-1]).all()


@pytest.fixture
def store(spark, tmp_path):
    videos(f"{tmp_path}/in")
    root = f"{tmp_path}/in"
    FS.write_store(FS.read_encoded(spark, root), f"{tmp_path}/store",
                   counts=frame_counts(spark, root), files=7, page_rows=2)
    return root, f"{tmp_path}/store"


def test_only_sampled_frames_are_read_and_decoded(spark, store):
    root, path = store
    counter = spark.sparkContext.accumulator(0)
    got = FS.fetch_sample(spark, path, counter)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(sample_pos)" in plan
    rows = got.collect()
    want = uniform_sample(read_frames(spark, root), counts=frame_counts(spark, root)).collect()
    assert {(r.item_id, r.frame_idx, r.sample_pos) for r in rows} == \
        {(r.item_id, r.frame_idx, r.sample_pos) for r in want}
    assert counter.value == len(rows) == len(want) < FS.store_keys(spark, path).count() / 3
    images = {(r.path.split("/")[-2], r.path.split("/")[-1]): r.image for r in
              read_images(spark, root, glob="*.png").collect()}
    for r in rows:
        old = images[r.item_id.split("/")[-1], f"{r.frame_idx}.png"]
        assert (r.image.height, bytes(r.image.data)) == (old.height, bytes(old.data))


def test_choosing_reads_key_columns_only(spark, store):
    _, path = store
    keys = FS.store_keys(spark, path).where("frame_idx < 3")
    schema = keys._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1]
    assert "content" not in schema and "frame_idx" in schema
    counter = spark.sparkContext.accumulator(0)
    got = FS.fetch(spark, path, keys.where("frame_idx > 0"), counter).collect()
    assert counter.value == len(got) == keys.where("frame_idx > 0").count() > 0
    assert FS.fetch(spark, path, keys.limit(0)).collect() == []


def test_pages_of_other_frames_are_skipped(spark, tmp_path):
    rows = [("v", i, bytearray(np.random.default_rng(i).bytes(2000))) for i in range(1600)]
    FS.write_store(spark.createDataFrame(rows, "item_id string, frame_idx int, content binary"),
                   f"{tmp_path}/s", files=1)
    df = spark.read.parquet(f"{tmp_path}/s").where("sample_pos is not null").select("content")
    df.collect()
    scan = df._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert 16 <= read <= 16 * FS.PAGE_ROWS


def test_first_informative_by_an_ordered_scan(spark, store):
    root, path = store
    want = {(r.item_id, r.frame_idx, r.status) for r in
            first_informative(read_frames(spark, root)).collect()}
    counter = spark.sparkContext.accumulator(0)
    got = FS.first_informative_in_store(spark, path, counter=counter)
    assert {(r.item_id, r.frame_idx, r.status) for r in got.collect()} == want
    assert ("a", 33) in {(i.split("/")[-1], k) for i, k, _ in want}
    total = FS.store_keys(spark, path).count()
    assert counter.value < total  # nothing behind a hit is decoded
    with pytest.raises(Exception, match="Image could not be loaded"):
        FS.first_informative_in_store(spark, path, strict=True).collect()


def test_encoded_images(spark, tmp_path):
    write_png(f"{tmp_path}/a.png", noisy(3))
    (tmp_path / "b.png").write_bytes(b"no")
    im = read_images(spark, str(tmp_path)).select("image", encoded("image").alias("png"))
    for r in im.collect():
        px = decode_png(None if r.png is None else bytes(r.png))
        assert px is None if r.image.height < 0 else px.tobytes() == bytes(r.image.data)


def test_short_videos_are_frames_or_rendered_copies(spark, store):
    from labelflow.functions.augment import PARAMS, augmentation_plan, render
    from labelflow.operators.media import short_videos
    root, path = store
    rng = np.random.default_rng(9)
    pics = {f"i{k}": rng.integers(0, 256, (8, 8, 3), dtype=np.uint8) for k in range(3)}
    rows = [(i, (8, 8, 3, bytearray(p[..., ::-1].tobytes()))) for i, p in pics.items()]
    rows.append(("broken", (-1, -1, -1, bytearray())))
    pictures = spark.createDataFrame(
        rows, "id string, image struct<height:int,width:int,nChannels:int,data:binary>")
    items = [(i, f"{i}.png", None) for i in (*pics, "broken", "nowhere")] \
        + [("va", "clip.mp4", f"{root}/a"), ("vc", "cmp4", f"{root}/c"), ("i1", None, None),
           ("no", "x.mp4", f"{root}/none")]
    items = spark.createDataFrame(items, "id string, media string, frames string")
    got = short_videos(items, FS.fetch_sample(spark, path), pictures).collect()
    frames = {(r.id, r.pos): bytes(r.data) for r in got if r.source == "frame"}
    assert sorted({i for i, _ in frames}) == ["va", "vc"]
    assert len([1 for i, _ in frames if i == "va"]) == 16
    assert len([1 for i, _ in frames if i == "vc"]) == 4  # one of its five is broken
    copies = [r for r in got if r.source == "copy"]
    assert len(copies) == 16 * 4  # i1 stands twice
    plan = augmentation_plan(spark.createDataFrame([(i,) for i in pics], "id string")).collect()
    want = {(p.id, p.aug_k): render(pics[p.id], {n: p[n] for n in ("flip", *PARAMS)}).tobytes()
            for p in plan}
    assert {(r.id, r.pos): bytes(r.data) for r in copies} == want


def test_batches_of_pictures_are_bounded_in_bytes(spark, tmp_path):
    """Copies of pictures are rendered from Arrow batches of bounded bytes, not of 10,000 rows."""
    from labelflow.functions.augment import pseudo_video
    from labelflow.session import BATCH_BYTES
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    @F.pandas_udf("int")
    def rows_at_once(d):
        return d.map(lambda _: len(d))

    side = 32
    df = spark.range(0, 3000, 1, 1).select(
        F.col("id").cast("string").alias("id"), F.lit(side).alias("height"),
        F.lit(side).alias("width"), F.unhex(F.repeat(F.lit("7f"), side * side * 3)).alias("data"))
    spark.conf.unset(name)
    made = pseudo_video(df.limit(3), "id", k=2)
    assert int(spark.conf.get(name)) <= BATCH_BYTES and made.count() == 6
    most = df.select(rows_at_once("data").alias("n")).agg(F.max("n")).first()[0]
    assert most * side * side * 3 < 2 * BATCH_BYTES
    spark.conf.unset(name)
    FS.write_store(spark.createDataFrame([("v", 0, b"x")], "item_id string, frame_idx int, "
                                         "content binary"), f"{tmp_path}/bounded")
    assert int(spark.conf.get(name)) <= BATCH_BYTES
