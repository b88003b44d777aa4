"""CSV scans with hard quoting, and the prediction sink round trip."""

import csv
import io
import os

import pytest
from pyspark.errors import PySparkException

from labelflow.operators import exemplars as X
from labelflow.sources.descriptions import read_description_rows, read_descriptions
from labelflow.sources.items import read_items
from labelflow.sources.sinks import prediction_rows, write_predictions

# Invented rows of the same shape as the exemplar description files: CRLF, doubled quotes, and
# one quoted field with unescaped quotes inside.
DESC = (
    'id,label,description,text\r\n'
    'v1,non-hateful,"A person waves at a crowd, smiling.","Good morning everyone"\r\n'
    'v2,hateful,"Someone says ""go away"" loudly.","Text with ""quotes"""\r\n'
    'v3,hateful,"The clip shows a "sign" on a wall.","plain"\r\n'
    'v4,non-hateful,"Two dogs play.","last, with comma"\r\n'
    'v2,hateful,"second v2 row","wins"\r\n'
)


def write(path, text, newline=""):
    with open(path, "w", encoding="utf-8", newline=newline) as f:
        f.write(text)


def python_rows(text):
    return list(csv.DictReader(io.StringIO(text, newline="")))


def test_descriptions_equal_python_csv(spark, tmp_path):
    p = os.path.join(tmp_path, "hatemm_demo_description.csv")
    write(p, DESC)
    got = [(r.id, r.label, r.description, r.text) for r in
           read_description_rows(spark, p).orderBy("pos").collect()]
    want = [(r["id"], r["label"], r["description"], r["text"]) for r in python_rows(DESC)]
    assert got == want


def test_descriptions_last_wins_and_profile(spark, tmp_path):
    p = os.path.join(tmp_path, "hatemm_demo_description.csv")
    write(p, DESC)
    d = {r.id: (r.dataset, r.description) for r in read_descriptions(spark, p).collect()}
    assert d["v2"] == ("hatemm", "second v2 row")
    assert len(d) == 4


def test_exemplar_lookup_order_and_missing(spark, tmp_path):
    p = os.path.join(tmp_path, "hatemm_demo_description.csv")
    write(p, DESC)
    pool = read_descriptions(spark, p)
    ids = X.exemplar_id_table(spark, {"hatemm": ["v4", "v1", "v3", "zz"]})
    ex = X.ordered_exemplars(ids, pool, 3).orderBy("pos").collect()
    assert [r.id for r in ex] == ["v4", "v1", "v3"]
    block = X.demo_block(X.ordered_exemplars(ids, pool, 3), 3).collect()[0].demo
    assert block.index("Two dogs play.") < block.index("A person waves")
    assert block.endswith(" Video with vision content as shown and ")
    with pytest.raises(PySparkException):
        X.ordered_exemplars(ids, pool, 4).collect()
    assert X.demo_block(X.ordered_exemplars(ids, pool, 0), 0).count() == 0


ITEMS = (
    'id,text,label,type,image,frames\n'
    'm1,"hi, ""you""",1.0,train,a.png,\n'
    'm2,"multi\nline",0,test,b.png,fr/m2\n'
    'm3,,,test,c.png,\n'
)


def test_read_items_missing_video_and_label_cast(spark, tmp_path):
    p = os.path.join(tmp_path, "mhc.csv")
    write(p, ITEMS)
    got = {r.id: r for r in read_items(spark, p).collect()}
    assert got["m1"].text == 'hi, "you"' and got["m1"].label == 1
    assert got["m2"].text == "multi\nline" and got["m2"].frames == "fr/m2"
    assert got["m3"].label is None and got["m3"].text is None
    assert all(r.video is None and r.dataset == "mhc" for r in got.values())


def test_prediction_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'He said "hateful", then left.\nok', "hateful"),
                                ("2", None, "non-hateful")], "id string, response string, label_name string")
    out = os.path.join(tmp_path, "pred")
    write_predictions(prediction_rows(df), out)
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(out)
    got = sorted((r.id, r.response, r.label) for r in back.collect())
    assert got == [("1", 'He said "hateful", then left.\nok', "hateful"), ("2", None, "non-hateful")]


def test_items_of_different_headers(spark, tmp_path):
    write(os.path.join(tmp_path, "a_hatemm.csv"), "id,text,label,type,image\n1,hello,1.0,test,i1\n"
          "2,\"two\nlines\",,train,i2\n")
    write(os.path.join(tmp_path, "b_hatemm.csv"), "id,label,text,type,frames,video\n"
          "3,0,swapped,test,f3,v3.mp4\n")
    write(os.path.join(tmp_path, "c_hatemm.csv"), "video,id\nonly.mp4,4\n")
    write(os.path.join(tmp_path, "d_hatemm.csv"), "")
    got = {r.id: r.asDict() for r in read_items(spark, str(tmp_path), positions=True).collect()}
    assert (got["1"]["text"], got["1"]["label"], got["1"]["image"], got["1"]["frames"]) == \
        ("hello", 1, "i1", None)
    assert got["2"]["text"] == "two\nlines" and got["2"]["label"] is None
    assert (got["3"]["text"], got["3"]["label"], got["3"]["frames"], got["3"]["video"]) == \
        ("swapped", 0, "f3", "v3.mp4")
    assert got["4"]["video"] == "only.mp4" and got["4"]["dataset"] == "hatemm"
    assert sorted(got, key=lambda i: got[i]["file_pos"]) == ["1", "2", "3", "4"]


def test_malformed_labels(spark, tmp_path):
    from labelflow.functions.labels import label_int
    from labelflow.sources.items import split_malformed
    write(os.path.join(tmp_path, "x_mhc.csv"), "id,label\n1,1\n2,abc\n3,NaN\n4,\n5,1.0\n")
    with pytest.raises(PySparkException):
        read_items(spark, str(tmp_path)).collect()
    raw = spark.read.option("header", True).csv(str(tmp_path))
    good, bad = split_malformed(raw)
    assert {r.id: r.l for r in good.select("id", label_int("label").alias("l")).collect()} == \
        {"1": 1, "4": None, "5": 1}
    assert sorted((r.id, r.reason) for r in bad.collect()) == [
        ("2", "label is no number: abc"), ("3", "label is no number: NaN")]


def test_stream_fails_on_another_header(spark, tmp_path):
    from labelflow.sources.items import items_stream
    os.mkdir(os.path.join(tmp_path, "in"))
    write(os.path.join(tmp_path, "in", "mhc.csv"), "id,label,text\n1,0,t\n")
    df = items_stream(spark, os.path.join(tmp_path, "in"), "mhc", columns=["id", "text", "label"])
    with pytest.raises(Exception, match="CSV|header|Header"):
        df.writeStream.format("memory").queryName("items_header").trigger(availableNow=True) \
            .option("checkpointLocation", os.path.join(tmp_path, "cp")).start().awaitTermination()


def test_checkpoint_folder_is_required_on_clusters():
    from labelflow.session import needs_shared_folder
    assert not needs_shared_folder("local") and not needs_shared_folder("local[8]")
    assert not needs_shared_folder("local[*]")
    for master in ("yarn", "spark://h:7077", "k8s://x", "local-cluster[3,2,1024]"):
        assert needs_shared_folder(master)


def test_exemplar_lists_shorter_than_k(spark):
    assert X.check_k(8) == 8
    with pytest.raises(ValueError):
        X.check_k(9)
    ids = X.exemplar_id_table(spark, {"hatemm": ["a"]})
    pool = spark.createDataFrame([("hatemm", "a", "x")], "dataset string, id string, text string")
    assert X.ordered_exemplars(ids, pool, 1).count() == 1
    with pytest.raises(PySparkException):
        X.ordered_exemplars(ids, pool, 2).collect()
    got = X.exemplar_overlap(spark.createDataFrame([("mhc", "pQbEa24u-HM"), ("mhc", "z"),
                                                    ("hatemm", "q")], "dataset string, id string"))
    assert sorted(map(tuple, got.collect())) == [("hatemm", 0), ("mhc", 1)]


def test_description_rows_in_ranges_equal_python_csv(spark, tmp_path):
    """Files of several ranges, of which some have records over two: rows, places and texts are
    those of Python's reader, and no file is held whole."""
    want = {}
    for name, n, text in (("a", 4000, "two\nlines, " * 9), ("b", 2500, "one line"), ("c", 0, "")):
        rows = [f'{i % (n - 10)},hateful,"d{i} ""q"", {text}",{"" if i % 3 else f"t{i}"}\n'
                for i in range(n)]
        write(os.path.join(tmp_path, f"{name}_hatemm.csv"), "id,label,description,text\n\n"
              + "".join(rows) + ("9999,short\n" if n else ""))
        want[name] = python_rows("id,label,description,text\n" + "".join(rows)
                                 + ("9999,short\n" if n else ""))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], str(1 << 20))
        spark.conf.set(names[1], "1000")  # ranges depend on the bytes of all files
        rows = read_description_rows(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        got = rows.collect()
        last = read_descriptions(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, own in want.items():
        mine = sorted((r for r in got if f"/{name}_hatemm" in r.file), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(own)))
        assert [(r.id, r.label, r.description, r.text) for r in mine] == \
            [(r["id"], r["label"], r["description"], r["text"]) for r in own]
    newest = {r["id"]: r for name in "ab" for r in want[name]}
    assert {r.id: (r.description, r.text) for r in last} == \
        {i: (r["description"], r["text"]) for i, r in newest.items()}
