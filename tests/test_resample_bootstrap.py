"""F13 with smoothing, exact moments, bootstrap intervals."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.functions import resample as RS
from labelflow.operators import bootstrap as BS


@pytest.mark.parametrize("size,out", [(8, 3), (3, 8), (560, 560), (1000, 7), (1, 5), (5, 1)])
def test_coefficients_add_up_and_keep_a_colour(size, out):
    k = RS.coefficients(size, out)
    assert (k.sum(1) == 1 << RS.BITS).all() and (k >= 0).all()
    for v in (0, 1, 127, 255):
        img = np.full((size if size < 100 else 4, size, 3), v, np.uint8)
        assert (RS.resample(img, out if size < 100 else 2, out) == v).all()
    if size == out:
        assert (k == np.eye(size, dtype=np.int64) << RS.BITS).all()


def test_shrinking_smooths():
    img = np.zeros((64, 64, 1), np.uint8)
    img[::2] = 255  # stripes finer than the result's pixels
    small = RS.resample(img, 4, 4)
    assert abs(small.astype(int) - 127).max() <= 6


def _image(rng, h, w, c=3):
    return (h, w, c, bytearray(rng.integers(0, 256, h * w * c, dtype=np.uint8).tobytes()))


def test_moments_add_up_over_bands(spark):
    rng = np.random.default_rng(1)
    rows = [(k, _image(rng, h, w, c)) for k, (h, w, c) in
            enumerate([(5, 7, 3), (64, 3, 1), (1, 1, 3), (33, 20, 4)])]
    rows += [(9, (-1, -1, -1, bytearray())), (10, None), (0, _image(rng, 2, 2))]
    schema = "k int, image struct<height:int,width:int,nChannels:int,data:binary>"
    df = spark.createDataFrame(rows, schema)
    want: dict = {}
    for k, im in rows:
        n = s1 = s2 = 0
        if im is not None and im[0] > 0:
            px = np.frombuffer(bytes(im[3]), np.uint8).reshape(-1, im[2]).astype(int)
            g = px[:, 0] if im[2] == 1 else \
                (4899 * px[:, 2] + 9617 * px[:, 1] + 1868 * px[:, 0] + 8192) >> 14
            n, s1, s2 = len(g), int(g.sum()), int((g * g).sum())
        want[k] = tuple(a + b for a, b in zip(want.get(k, (0, 0, 0)), (n, s1, s2)))
    for band in (1, 40, 1 << 20):
        got = RS.image_moments(df, "k", band_bytes=band).collect()
        assert {r.k: (r.n, r.s1, r.s2) for r in got} == want
    edge = spark.createDataFrame([(2, 20, 400), (2, 20, 401)], "n bigint, s1 bigint, s2 bigint")
    told = edge.select(RS.above_threshold(F.col("n"), F.col("s1"), F.col("s2")).alias("a")).collect()
    assert [r.a for r in told] == [False, True]  # exactly the threshold is not above it


def _draws(i, n):
    out = []
    for b in range(n):
        digest = hashlib.md5(f"42:{i}:{b // 8}".encode()).hexdigest()
        u = int(digest[4 * (b % 8):4 * (b % 8) + 4], 16)
        out.append(sum(u >= t for t in BS.POISSON_STEPS))
    return out


def test_intervals_equal_plain_python(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        label = int(rng.integers(0, 2))
        rows.append(("a", str(i), label, label if rng.random() < 0.9 else None))
        answer = label if rng.random() < 0.6 else 1 - label
        rows.append(("b", str(i), label, answer))
        rows.append(("c", str(i), label, 1 - answer if i % 50 == 0 else answer))
    n = 40
    rate = {}
    for g in "abc":
        own = [(r[1], int(r[3] == r[2])) for r in rows if r[0] == g]
        w = np.array([_draws(i, n) for i, _ in own])
        ok = np.array([o for _, o in own])
        rate[g] = ((w * ok[:, None]).sum(0) / w.sum(0), ok.mean())
    df = spark.createDataFrame(rows, "regime string, id string, label int, pred int").repartition(5)
    got = {(r.first, r.second): r for r in BS.compare(df, n=n).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), r in got.items():
        d = np.sort(rate[x][0] - rate[y][0])
        assert r.difference == rate[x][1] - rate[y][1]
        assert (r.low, r.high) == (d[0], d[38])
        assert r.significant == (d[0] > 0 or d[38] < 0)
    assert got["a", "b"].significant and not got["b", "c"].significant
    mean = np.mean([_draws(i, 80) for i in range(400)])
    assert abs(mean - 1) < 0.02


def test_replicates_read_the_scored_rows_once_and_digest_a_block_once(spark):
    df = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 0)],
                               "regime string, id string, label int, pred int")
    plan = BS.replicates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("md5(") == 1
    assert not any("md5(" in line for line in plan.splitlines() if "posexplode" in line)
