"""Rows, labels, prompts: P1–P5, P9–P11, F1–F3, F10, F11, J3, S6."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelflow import constants as K
from labelflow.functions.labels import class_name, label_int, resolve_profile, resolve_profile_name
from labelflow.functions.prompts import demo_line_col, frame_path_col, prompt_col
from labelflow.operators import rows as R


def items(spark):
    rows = [("a", "hello", "1", "train"), ("b", None, "1.0", None), ("c", "x {text} 'q' \"d\"\nz", "0", "test"),
            ("d", "t", None, "test"), ("e", "t", "0", "other"), ("a", "dup", "1", "test")]
    return spark.createDataFrame(rows, "id string, text string, label string, type string") \
        .withColumn("dataset", F.lit("hatemm")).withColumn("label", label_int("label"))


def test_label_cast_accepts_float_text(spark):
    got = spark.createDataFrame([("1",), ("1.0",), ("0",), (None,), ("x",)], "l string") \
        .select(label_int("l").alias("v")).collect()
    assert [r.v for r in got] == [1, 1, 0, None, None]


def test_train_split_keeps_null_type(spark):
    ids = sorted(r.id for r in R.train_split(items(spark)).collect())
    assert ids == ["a", "b", "e"]


def test_test_split_and_labelled(spark):
    ids = sorted(r.id for r in R.labelled(R.test_split(items(spark))).collect())
    assert ids == ["a", "c"]


def test_prompt_single_substitution_and_none(spark):
    df = items(spark).select("id", prompt_col("text", "dataset", "image").alias("p"))
    got = {r.id: r.p for r in df.collect()}
    pos, neg = K.LABEL_NAMES["hatemm"][1], K.LABEL_NAMES["hatemm"][0]
    tmpl = ("Text: '{text}' \n Analyze the image and text to determine if the content is " + pos +
            ". Respond with '" + pos + "' or '" + neg + "'—just one word, no sentences.")
    assert got["b"] == tmpl.format(text=None)
    assert got["c"] == tmpl.format(text="x {text} 'q' \"d\"\nz")


def test_video_mode_word(spark):
    df = items(spark).select(prompt_col("text", "dataset", "video").alias("p")).limit(1)
    assert "Analyze the video and text" in df.collect()[0].p


def test_demo_line(spark):
    df = spark.createDataFrame([("mhc", "desc", "txt", "offensive")],
                               "dataset string, description string, text string, label string")
    got = df.select(demo_line_col("description", "text", "label", "dataset", "video").alias("d")).collect()[0].d
    assert got == ("Video with vision content: 'desc' and Text: 'txt'. \n Analyze the video and text to "
                   "determine if the content is offensive. Respond with 'offensive' or 'non-offensive'"
                   "—just one word, no sentences. \n offensive \n ")


def test_class_name_and_unknown_label(spark):
    df = spark.createDataFrame([("mhc", 1), ("hatemm", 0), ("mhc", None)], "dataset string, label int")
    got = [r.label_name for r in class_name(df).collect()]
    assert got == ["offensive", "non-hateful", None]
    bad = spark.createDataFrame([("mhc", 2)], "dataset string, label int")
    with pytest.raises(PySparkException):
        class_name(bad).collect()


def test_profile_last_key_wins(spark):
    assert resolve_profile_name("/data/hatemm_and_mhc.csv") == "mhc"
    assert resolve_profile_name("/data/hatemm.csv") == "hatemm"
    with pytest.raises(ValueError):
        resolve_profile_name("/data/other.csv")
    df = spark.createDataFrame([("x/mhc/hatemm.csv",), ("x/hatemm.csv",)], "p string")
    assert [r.d for r in df.select(resolve_profile("p").alias("d")).collect()] == ["mhc", "hatemm"]


def test_mp4_suffix_rule(spark):
    df = spark.createDataFrame([("clip.mp4",), ("clip.MP4",), ("xmp4",), (None,), ("a.png",)], "video string")
    got = [r.kind for r in R.media_kind(df).collect()]
    assert got == ["video", "image", "video", "image", "image"]


def test_frame_path(spark):
    df = spark.createDataFrame([("d/v1", 12)], "frames string, i int")
    assert df.select(frame_path_col("frames", "i").alias("p")).collect()[0].p == "d/v1/12.png"


def test_resolve_media_video_fallback(spark):
    it = spark.createDataFrame([("a", "a.png", None), ("b", "b.png", "d/b")],
                               "id string, image string, frames string")
    chosen = spark.createDataFrame([("d/b", 3, "ok")], "item_id string, frame_idx int, status string")
    got = {r.id: (r.image, r.video, r.status) for r in R.resolve_media(it, chosen).collect()}
    assert got == {"a": ("a.png", "a.png", "ok"), "b": ("d/b/3.png", "d/b/3.png", "ok")}


def test_quarantine_split_and_strict(spark):
    df = spark.createDataFrame([("a", 1), ("b", -1)], "id string, h int")
    reason = F.when(F.col("h") < 0, F.lit("unreadable"))
    good, bad = R.quarantine(df, reason)
    assert [r.id for r in good.collect()] == ["a"]
    assert [(r.id, r.reason) for r in bad.collect()] == [("b", "unreadable")]
    strict, _ = R.quarantine(df, reason, strict=True)
    with pytest.raises(PySparkException):
        strict.collect()


def test_exemplar_rows_list_and_frame(spark):
    df = items(spark)
    assert sorted(r.id for r in R.exemplar_rows(df, ["c", "e"]).collect()) == ["c", "e"]
    ids = spark.createDataFrame([("c",), ("c",)], "id string")
    assert [r.id for r in R.exemplar_rows(df, ids).collect()] == ["c"]
