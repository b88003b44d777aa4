"""Stream equals batch (§2.9), token rows (F6–F9), chat (F4–F5), prediction (M1–M2)."""

import os

import numpy as np
from pyspark.sql import functions as F

from labelflow.functions import chat as C
from labelflow.functions import tokens as TK
from labelflow.operators import predict as P
from labelflow.sources.items import read_items
from labelflow.streaming.stream import run_available, scoring_prompts, stream_items


def test_stream_equals_batch(spark, tmp_path):
    src = os.path.join(tmp_path, "in", "hatemm")
    os.makedirs(src)
    with open(os.path.join(src, "part1.csv"), "w") as f:
        f.write('id,text,label,type,image\n1,"a ""q"" b",1,test,x.png\n2,b,0,train,y.png\n3,c,0,test,z.png\n')
    batch = scoring_prompts(read_items(spark, src, dataset="hatemm"))
    cols = ["id", "text", "label", "type", "image"]
    stream = scoring_prompts(stream_items(spark, src, dataset="hatemm", columns=cols))
    run_available(stream, "prompts_out")
    got = spark.table("prompts_out")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0
    assert got.count() == 2


def test_pad_truncate_and_mask(spark):
    df = spark.createDataFrame([([5, 6, 1, 7],), (list(range(2, 12)),)], "ids array<bigint>")
    r = df.select(TK.pad_truncate("ids", 6).alias("p")).select(
        "p", TK.mask_labels("p").alias("l"), TK.attention_mask("p").alias("m")).collect()
    assert r[0].p == [5, 6, 1, 7, 0, 0] and r[0].l == [5, 6, -100, 7, -100, -100]
    assert r[0].m == [1, 1, 1, 1, 0, 0]
    assert r[1].p == list(range(2, 8))


def test_token_ids_whole_text(spark):
    import hashlib
    text = "  a  b\tc\n" + " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(text,)], "text string")
    ids = df.select(TK.token_ids("text").alias("i")).collect()[0].i
    words = text.split()
    assert len(ids) == len(words)
    assert ids[0] == int(hashlib.md5(b"a").hexdigest()[:7], 16) % 32000 + 2


def test_strip_prompt(spark):
    df = spark.createDataFrame([([9, 9, 9, 1, 4, 0, 5, 0],)], "g array<bigint>")
    assert df.select(TK.strip_prompt("g", 3).alias("s")).collect()[0].s == [4, 5]


def test_messages_and_render(spark):
    df = spark.createDataFrame([("a.png", "hello", "hateful")], "img string, t string, a string")
    m = df.select(C.messages_col(F.col("img"), F.col("t"), F.col("a")).alias("m"))
    r = m.select(C.render_chat("m", generation_prompt=True).alias("r")).collect()[0].r
    assert r == "<|user|>\n<|image|>hello<|end|>\n<|assistant|>\nhateful<|end|>\n<|assistant|>\n"


def test_predict_batch_and_model_choice(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([4.0, 0.0, 0.0, 1.0],)], "v array<float>")
    make = P.choose_model(os.path.join(tmp_path, "missing"), lambda p: None,
                          P.linear_rule(P.alternating_weights(4)))
    got = [r.s for r in P.predict(df, make, "v", out="s", input_tensor_shapes=[[4]]).collect()]
    assert np.allclose(got, [-2.0, 3.0])


def test_text_predictor(spark):
    def make():
        return lambda prompts: ["hateful" if "bad" in p else "non-hateful" for p in prompts]
    df = spark.createDataFrame([("bad one",), ("fine",)], "prompt string")
    got = [r.response for r in P.text_predictor(make)(df).collect()]
    assert got == ["hateful", "non-hateful"]


def test_attended_equals_mask_sum(spark):
    from pyspark.sql import functions as F
    from labelflow.functions.tokens import attended, attention_mask, pad_truncate
    df = spark.createDataFrame([([5, 6, 7],), ([],), ([9] * 20,)], "ids array<bigint>") \
        .select(pad_truncate("ids", 8).alias("p"))
    got = df.select(attended("p").alias("a"),
                    F.aggregate(attention_mask("p"), F.lit(0), lambda s, x: s + x).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(3, 3), (0, 0), (8, 8)]


def test_media_marker_is_media_token_and_masked(spark):
    from labelflow.constants import IGNORE_INDEX, MEDIA_ID
    from labelflow.functions.tokens import mask_labels, token_ids
    df = spark.createDataFrame([("<|user|>\n<|image|>Text: 'hi' <|video|> end",)], "t string")
    r = df.select(token_ids("t").alias("ids")).select("ids", mask_labels("ids").alias("lab")).first()
    assert len(r.ids) == 6 and r.ids[1] == MEDIA_ID and r.ids[4] == MEDIA_ID
    assert r.lab[1] == IGNORE_INDEX and r.lab[4] == IGNORE_INDEX
    assert [i for i in r.ids if i != MEDIA_ID] == [i for i in r.lab if i != IGNORE_INDEX]
