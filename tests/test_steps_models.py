"""M1-M3, K1: training in steps, shipped models, resumable scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.operators import model_store as MS
from labelflow.operators import predict as P
from labelflow.operators import steps as ST
from labelflow.operators.batches import assign_batches
from labelflow.sources import resume as RS

PARAMS = ST.StepParams(epochs=3, features=64, rate=0.8)


def _rows(n=150, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 2)) if rng.random() < 0.9 else None
        x = rng.integers(0, 64, rng.integers(0, 12)).tolist() + ([7] * 3 if label else [])
        rows.append((str(i), label, [int(f) for f in x]))
    return rows + [rows[3], rows[3]]


def plain(ordered, params):
    """One loop over the rows in their order, an update every step."""
    w, b = np.zeros(params.features), 0.0
    size = params.batch_size * params.accumulation
    for _ in range(params.epochs):
        for lo in range(0, len(ordered), size):
            g, gb = np.zeros(params.features, np.int64), 0
            step = ordered[lo:lo + size]
            for _, label, x in step:
                share = np.bincount(x, minlength=params.features) / max(1, len(x))
                where = np.flatnonzero(share)
                miss = 1 / (1 + np.exp(-(float(w[where] @ share[where]) + b))) - label
                g += np.rint(miss * share * ST.UNIT).astype(np.int64)
                gb += int(np.rint(miss * ST.UNIT))
            where = np.flatnonzero(g)
            gd, bd = g / (ST.UNIT * len(step)), gb / (ST.UNIT * len(step))
            norm = np.sqrt((gd[where] ** 2).sum() + bd * bd)
            scale = params.rate * min(1.0, params.max_norm / norm) if norm else 0.0
            w, b = w - scale * gd, b - scale * bd
    return w, b


def test_steps_equal_a_plain_loop_for_any_number_of_tasks(spark):
    df = spark.createDataFrame(_rows(), "id string, label int, features array<bigint>")
    known = assign_batches(df.where("label is not null"), "id").orderBy("pos").collect()
    want, want_b = plain([(r.id, r.label, r.features) for r in known], PARAMS)
    got = [ST.train_in_steps(df.repartition(p), params=PARAMS, tasks=t)
           for p, t in ((1, 1), (5, 2), (3, 4))]
    for w, b in got:
        assert (w == got[0][0]).all() and b == got[0][1]
    assert np.allclose(got[0][0], want, rtol=0, atol=1e-12) and abs(got[0][1] - want_b) < 1e-12
    scored = ST.margins(df.where("label is not null"), *got[0]).collect()
    assert np.mean([(r.margin > 0) == (r.label == 1) for r in scored]) > 0.8


def test_no_rows_and_too_many_features(spark):
    none = spark.createDataFrame([], "id string, label int, features array<bigint>")
    w, b = ST.train_in_steps(none, params=PARAMS)
    assert not w.any() and b == 0.0
    with pytest.raises(ValueError):
        ST.train_in_steps(none, params=ST.StepParams(features=1 << 30))


def test_models_are_saved_shipped_and_checked(spark, tmp_path):
    path = f"{tmp_path}/models/tuned one"
    weights = np.arange(400_000, dtype=np.float64)
    digest = MS.save_model(spark, path, {"w": weights, "names": np.array(["a", "bé"])})
    assert len(digest) == 64 and MS.has_model(spark, path)
    with pytest.raises(Exception):
        MS.save_model(spark, path, {"w": weights})  # never overwritten
    df = spark.range(50).select(F.array(F.col("id").cast("double")).alias("x")).repartition(3)

    def build(arrays):
        total = float(arrays["w"].sum()) + len(arrays["names"])
        return lambda x: np.asarray(x)[:, 0] + total

    base = P.linear_rule([2.0])
    for where, want in ((path, weights.sum() + 2), (f"{tmp_path}/none", None), (None, None)):
        fn = MS.tuned_or_base(spark, where, build, base)
        got = P.predict(df, fn, "x", input_tensor_shapes=[[1]]).collect()
        assert all(r.prediction == (r.x[0] + want if want else 2 * r.x[0]) for r in got)


def test_an_exchanged_model_is_noticed(spark, tmp_path):
    MS.save_model(spark, f"{tmp_path}/m2", {"w": np.ones(3)})
    fn = MS.load_model_fn(spark, f"{tmp_path}/m2", lambda a: lambda x: x)
    fn()  # the driver can load it, too
    folder, digest = "m2", "0" * 64
    with pytest.raises(RuntimeError, match="is not the one"):
        MS._arrays(folder, digest)


def test_scoring_resumes_without_scoring_twice(spark, tmp_path):
    path, schema = f"{tmp_path}/scored", "id string, response string, n bigint"
    rows = spark.createDataFrame([(str(i % 90), i) for i in range(100)] + [(None, 7), (None, 8)],
                                 "id string, n bigint").repartition(4)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def answer(n):
        calls.add(1)
        return f"r{n}"

    def score(df):
        return df.select("id", answer("n").alias("response"), "n")

    first = RS.score_resumable(rows, score, path, parts=5, at_most=2)
    some = first.count()
    assert 0 < some < 102 and calls.value == some and len(RS.finished_parts(spark, path)) == 2
    # a part that a stopped job left half-written is not read
    (tmp_path / "scored" / f"run-{'a' * 32}-part-00009").mkdir()
    got = RS.score_resumable(rows, score, path, parts=3)
    assert sorted(map(tuple, got.collect()), key=repr) == \
        sorted(((r.id, f"r{r.n}", r.n) for r in rows.collect()), key=repr)
    assert calls.value == 102
    more = rows.unionByName(spark.createDataFrame([("new", 5)], rows.schema))
    assert RS.score_resumable(more, score, path).count() == 103 and calls.value == 103
    assert RS.read_scored(spark, f"{tmp_path}/nothing", schema).collect() == []


def test_segments_of_steps_equal_one(spark):
    df = spark.createDataFrame(_rows(400), "id string, label int, features array<bigint>")
    (w, b), (w2, b2) = (ST.train_in_steps(df, params=PARAMS, segment=n) for n in (3, 1000))
    assert (w == w2).all() and b == b2 and w.any()


def test_arrow_batches_of_a_text_model_are_bounded_in_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("x"), 50_000).alias("prompt"))
    answer = P.text_predictor(lambda: lambda texts: [str(len(texts))] * len(texts), 10_000)
    got = [int(r.response) for r in answer(df).select("response").collect()]
    assert len(got) == 600 and max(got) * 50_000 < 8 << 20


CLUSTER = """
import sys
sys.path.insert(0, sys.argv[1])
import numpy as np
from pyspark.sql import functions as F
from labelflow.operators import model_store as MS, predict as P
from labelflow.session import get_spark
spark = get_spark(master="local-cluster[2,1,1024]", shuffle_partitions=2, extra={
    "spark.checkpoint.dir": f"file://{sys.argv[2]}/kept", "spark.driver.host": "127.0.0.1",
    "spark.local.dir": f"{sys.argv[2]}/local"})
MS.save_model(spark, f"file://{sys.argv[2]}/tuned", {"w": np.arange(5.0)})
fn = MS.load_model_fn(spark, f"file://{sys.argv[2]}/tuned",
                      lambda a: lambda x: np.asarray(x)[:, 0] + a["w"].sum())
df = spark.range(20).select(F.array(F.col("id").cast("double")).alias("x")).repartition(4)
got = sorted(r.prediction for r in P.predict(df, fn, "x", input_tensor_shapes=[[1]]).collect())
assert got == [i + 10.0 for i in range(20)], got
print("scored on two executors")
"""


def test_a_model_in_a_folder_reaches_the_executors_of_a_cluster(tmp_path):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", CLUSTER, root, str(tmp_path)], text=True,
                         capture_output=True, timeout=240)
    assert "scored on two executors" in got.stdout, got.stderr[-2000:]
