import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import topk

SCHEMA = "vec_id bigint, vector array<bigint>, id int, v int"


def plain(rows, queries, k):
    rows = [r for r in rows if r[1] is not None]
    first: dict = {}
    for r in queries:
        if r[0] is not None and r[1] is not None:
            first[r[0]] = min(first.get(r[0], r[1]), r[1])
    out = []
    for q, v in first.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, r[1])), r[0] is None, r[0] or 0)
                         for r in rows if r[0] != q))[:k]
        out += [(q, i + 1, None if none else i_d, -s) for i, (s, none, i_d) in enumerate(scored)]
    return sorted(out, key=repr)


def _rows(seed, n, dims, top):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-top, top) for _ in range(dims)], 1, 2) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1, 2), (n + 1, None, 1, 2),
             (n + 2, [0] * dims, 1, 2), (n + 5, [], 1, 2), (n + 6, rows[7][1][:2], 1, 2)]
    rows += [(200 + i, rows[8][1], 1, 2) for i in range(30)]  # ties
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("dims,top", [(1, 2), (3, 1), (8, 30), (5, 10**6), (4, 10**9)])
def test_equals_brute_force(spark, dims, top):
    rows = _rows(dims, 120, dims, top)
    queries = [r for r in rows if r[0] is not None and r[0] % 5 == 0]
    got = topk.top_k(_frame(spark, queries), _frame(spark, rows), 20, group_rows=50,
                     group_queries=7)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, queries, 20)


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    rows = rng.integers(-3, 4, (20_000, 2))
    rows[:50] += 100
    lists = topk.Lists(np.arange(len(rows)), rows)
    scored = []
    real = lists.scores
    lists.scores = lambda q, which: scored.append(len(which)) or real(q, which)
    at, score = lists.best(np.array([1, 1]), -1, 20)
    assert sum(scored) < len(rows) / 10
    want = np.sort(rows.sum(1))[::-1][:20]
    assert (np.sort(score)[::-1] == want).all()


def test_usable_and_quantised(spark):
    df = spark.createDataFrame([(1, [0.5, -0.01]), (2, None), (3, [1.0, None]),
                                (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [])],
                               "vec_id bigint, e array<float>")
    got = df.where(topk.usable(F.col("e"))).select("vec_id", topk.quantised(F.col("e"))).collect()
    assert sorted((r[0], r[1]) for r in got) == [(1, [32, -1]), (6, [])]


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(1, [1, 2], 0, 0), (2, [3, 4], 0, 0)]
    assert len(topk.top_k(_frame(spark, rows), _frame(spark, rows), 20).collect()) == 2
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, _frame(spark, rows), 5).collect() == []
    assert topk.top_k(_frame(spark, rows), none, 5).collect() == []
