"""K2, O2, O3, M3, P11 and the splittable item reader."""

import os


from labelflow.operators import classifier as CL
from labelflow.operators import rows as R
from pyspark.sql import functions as F

from labelflow.operators.ordering import first_k, list_positions
from labelflow.sources.items import read_items
from labelflow.sources.sinks import observe_size


def test_observe_size_counts_while_writing(spark):
    df, obs = observe_size(spark.range(37), "train")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 37


def test_first_k_explicit_order(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in (5, 3, 9, 1, 7)], "line int, v string")
    assert [r.v for r in first_k(df, "line", 3).collect()] == ["r1", "r3", "r5"]
    assert first_k(df, "line", 0).count() == 0


def test_list_positions(spark):
    got = list_positions(spark, ["b", "a", "c"]).orderBy("pos").collect()
    assert [(r.pos, r.id) for r in got] == [(0, "b"), (1, "a"), (2, "c")]


def test_media_col(spark):
    df = spark.createDataFrame([("i.png", None), ("i.png", "v.mp4")], "image string, video string")
    assert [r.m for r in df.select(R.media_col("video").alias("m")).collect()] == ["i.png", "v.mp4"]
    assert [r.m for r in df.select(R.media_col("image").alias("m")).collect()] == ["i.png"] * 2


def _texts(spark):
    pos = [(f"p{i}", f"awful hateful words number {i}", 1) for i in range(12)]
    neg = [(f"n{i}", f"nice friendly greeting number {i}", 0) for i in range(30)]
    return spark.createDataFrame(pos + neg, "id string, text string, label int")


def test_fit_classifier_separates_easy_classes(spark):
    df = _texts(spark)
    for algorithm in ("bayes", "logistic"):
        model = CL.fit_classifier(df, algorithm=algorithm, num_features=1 << 10)
        got = {r.id: r.pred for r in CL.classify(model, df, num_features=1 << 10).collect()}
        assert all(got[f"p{i}"] == 1 for i in range(12)), algorithm
        assert all(got[f"n{i}"] == 0 for i in range(30)), algorithm


def test_read_items_splittable_mode(spark, tmp_path):
    p = os.path.join(tmp_path, "mhc_items.csv")
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write('id,text,label,type,image\r\n1,"a ""quoted"" text",1.0,test,a.png\r\n'
                '2,plain,0,,b.png\r\n')
    for ml in (True, False):
        got = sorted((r.id, r.text, r.label, r.type, r.dataset)
                     for r in read_items(spark, p, multi_line=ml).collect())
        assert got == [("1", 'a "quoted" text', 1, "test", "mhc"), ("2", "plain", 0, None, "mhc")]


def test_scale_conf_sizes_partitions():
    from labelflow.session import scale_conf
    small, big = scale_conf(1 << 30), scale_conf(100 * (1 << 40))
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert big["spark.sql.shuffle.partitions"] == "200000"
    assert int(scale_conf(10 * (1 << 40))["spark.sql.shuffle.partitions"]) == 40960


def test_compare_regimes_ml_runs(spark):
    from labelflow.operators import regimes as RG
    from labelflow.plans import catalog as C
    from .conftest import SF001
    rows = RG.compare_regimes_ml(C.regime_items(spark, SF001)).collect()
    assert sorted(r.regime for r in rows) == sorted(RG.REGIMES)
    assert all(0.0 <= r.accuracy <= 1.0 and r.n == rows[0].n for r in rows)


def test_videos_without_frames(spark):
    from labelflow.operators.frames import videos_without_frames
    items = spark.createDataFrame([("a", "f/a"), ("b", "f/b"), ("c", None), ("d", "f/d")],
                                  "id string, frames string")
    counts = spark.createDataFrame([("f/a", 3), ("f/d", 0)], "item_id string, n bigint")
    got = videos_without_frames(items, counts).collect()
    assert sorted((r.id, r.reason) for r in got) == [
        ("b", "video without frames"), ("d", "video without frames")]


def test_user_collator_sees_batches_in_slot_order(spark):
    import pandas as pd

    from labelflow.operators.batches import assign_batches, collate, collate_with
    rows = assign_batches(spark.range(11).select(F.col("id").cast("string").alias("id")))

    def join(pdf):
        return pd.DataFrame({"batch_id": pdf.batch_id[:1], "ids": [" ".join(pdf.id)]})

    got = {r.batch_id: r.ids for r in
           collate_with(rows, join, "batch_id bigint, ids string").collect()}
    want = {r.batch_id: " ".join(r.id) for r in collate(rows, ["id"]).collect()}
    assert got == want and len(got) == 3


def test_model_path_and_prompt_rule(spark, tmp_path):
    from labelflow.operators import predict as P
    from labelflow.functions.prompts import prompt_col
    there = tmp_path / "model"
    there.mkdir()
    assert P.choose_model(str(there), lambda p: p, lambda: "base", spark)() == str(there)
    assert P.choose_model(str(tmp_path / "none"), lambda p: p, lambda: "base", spark)() == "base"
    assert P.choose_model(None, lambda p: p, lambda: "base")() == "base"
    df = spark.createDataFrame([(f"t{i}", "mhc") for i in range(60)], "text string, dataset string") \
        .withColumn("prompt", prompt_col("text", "dataset", "image"))
    out = P.text_predictor(P.prompt_rule)(df, "prompt", "generated").withColumn(
        "response", P.strip_prompt_text(F.col("generated"), F.col("prompt"))).collect()
    seen = {r.response for r in out}
    assert {"offensive", "non-offensive"} <= seen and all("Analyze" not in x for x in seen)
