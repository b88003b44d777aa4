"""Multi-line CSV files in byte ranges equal Python's csv module, rows and order."""

import csv
import io
import os
import random

import pytest

from labelflow.sources import csv_ranges as R
from labelflow.sources.items import read_items

COLUMNS = ["id", "text", "label"]


def python_rows(text):
    """Rows as ``csv`` gives them, NULL where nothing stands between the commas."""
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""),
                                  quoting=csv.QUOTE_NOTNULL) if r]
    if not rows:
        return []
    at = {name: k for k, name in enumerate(rows[0])}
    return [tuple(r[at[c]] if c in at and at[c] < len(r) else None for c in COLUMNS)
            for r in rows[1:]]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.fixture
def ranges(spark):
    """Sets the size of a range."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
    yield of
    for n, v in old.items():
        spark.conf.set(n, v)


FIELDS = ["", "a", '""', '"x\ny"', '"say ""hi"", ok"', 'b"c', '"t"z', '"\n\n,\n"', "é日", '"\r\n"',
          '"' + "long, " * 30 + '\n"', '"""\n"""', " s ", '"a" b']


def adversarial(seed, n=60, end="\n"):
    rng = random.Random(seed)
    lines = ["id,text,label"]
    for i in range(n):
        row = [str(i), *[rng.choice(FIELDS) for _ in range(2)]]
        if rng.random() < 0.1:
            row = row[:rng.randint(1, 2)] if rng.random() < 0.5 else [*row, "more", '"m,\n"']
        lines.append(",".join(row))
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + end


def read(spark, path, **kw):
    rows, found = R.read_csv(spark, path, COLUMNS, **kw)
    got = sorted(rows.collect(), key=lambda r: r["file_pos"])
    return [tuple(r[c] for c in COLUMNS) for r in got], found


@pytest.mark.parametrize("seed,end,size", [(1, "\n", 40), (2, "\r\n", 40), (3, "\n", 97),
                                           (4, "\n", 1 << 20), (5, "\r", 64)])
def test_equals_python_csv_in_ranges(spark, ranges, tmp_path, seed, end, size):
    ranges(size)
    text = adversarial(seed, end=end)
    write(f"{tmp_path}/in/x.csv", text)
    got, found = read(spark, f"{tmp_path}/in")
    assert got == python_rows(text) and found == set(COLUMNS)
    if size < 100 and end != "\r":
        lines = R._lines(spark, f"{tmp_path}/in")
        assert lines.select("start").distinct().count() > 10


def test_a_record_over_many_ranges_and_none_at_all(spark, ranges, tmp_path):
    ranges(50)
    field = "line of text\n" * 100
    text = f'id,text,label\n1,"{field}",0\n2,b,1\n3,"{field}{field}",0\n4,"open\nto the end'
    write(f"{tmp_path}/in/a.csv", text)
    write(f"{tmp_path}/in/b.csv", "")
    write(f"{tmp_path}/in/c.csv", "\n\n")
    write(f"{tmp_path}/in/d.csv", "﻿label,id\n7,first\n\n,\n")
    got, _ = read(spark, f"{tmp_path}/in")
    want = python_rows(text)
    assert got[:3] == want[:3]
    assert got[3] == ("4", "open\nto the end\n", None)  # a newline is supplied at a file's end
    assert got[4:] == [("first", None, "7"), (None, None, None)]


def test_many_files_of_other_layouts_and_names(spark, ranges, tmp_path):
    ranges(64)
    want = []
    for k, name in enumerate(["a b.csv", "c%20d.csv", "e.csv", "f,g.csv"]):
        text = adversarial(10 + k, n=15)
        if k % 2:
            text = text.replace("id,text,label", "text,label,id", 1)
        write(f"{tmp_path}/my items/hatemm/{name}", text)
        want.append(python_rows(text))
    got, _ = read(spark, f"{tmp_path}/my items/hatemm")
    assert sorted(got, key=repr) == sorted([r for w in want for r in w], key=repr)
    for w in want:  # each file's rows stand together, in order
        assert any(got[k:k + len(w)] == w for k in range(len(got)))
    items = read_items(spark, f"{tmp_path}/my items/hatemm", multi_line=False).limit(0)
    assert "dataset" in items.columns
    rows = read_items(spark, f"{tmp_path}/my items/hatemm/e.csv", positions=True)
    assert rows.columns[-1] == "file_pos" and {r.dataset for r in rows.select("dataset")
                                               .distinct().collect()} == {"hatemm"}


def test_newlines_end_rows_without_multi_line(spark, tmp_path):
    write(f"{tmp_path}/in/x.csv", 'id,text\n1,"a\n2,b"\n')
    got, _ = read(spark, f"{tmp_path}/in", multi_line=False)
    assert [g[0] for g in got] == ["1", "2"]


def test_state_by_line():
    for line, out, into in [("a,b\n", False, True), ('"a\n', True, False), ('a"b\n', False, False),
                            ('x,"y\n', True, True), ('"a""b"c"\n', False, True), ('""\n', False, True),
                            ('"a","b\n', True, True), ('"\n', True, False)]:
        assert R._inside_after(line, False) == out
        if line not in ('x,"y\n',):
            text = '"' + line
            got = list(csv.reader(io.StringIO(text + "Z\n", newline="")))
            assert R._inside_after(line, True) == (len(got) == 1)
    assert R._inside_after('x,"y\n', True) is False


def test_ranges_that_change_are_an_error(spark, tmp_path):
    write(f"{tmp_path}/in/x.csv", "id,text,label\n1,a,0\n")
    lines = R._lines(spark, f"{tmp_path}/in")
    import numpy as np
    none = np.zeros(0, np.int64)
    rows = R._records(lines, COLUMNS, (none, none, none), (none, none, []))
    with pytest.raises(Exception, match="ranges of a file changed"):
        rows.collect()
