import random

import numpy as np
import pytest

from labelflow.llm import vector_codes

SCHEMA = "vec_id bigint, vector array<bigint>, label int, _key string, code string, n int"


def plain(rows, parts, entries, rounds):
    """Every part measured against every entry, with Python's whole numbers."""
    rows = [r for r in rows if r[1] is not None]
    size = max((len(r[1]) for r in rows), default=0)
    width = -(-size // parts)
    rows = [(r[0], [*r[1], *[0] * (parts * width - len(r[1]))], r[2], r[1]) for r in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k)
                   for k, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = [[list(e) for e in b] for b in books]
        for p in range(parts):
            at = [nearest(r[1], p)[1] for r in rows]
            for k in range(len(books[p])):
                own = [cut(r[1], p) for r, a in zip(rows, at) if a == k]
                if own:
                    moved[p][k] = [sum(c) // len(own) for c in zip(*own)]
        books = moved
    out = [(r[0], [nearest(r[1], p) for p in range(parts)], r[2]) for r in rows]
    out = [(i, [k for _, k in got], min((1 << 63) - 1, sum(d for d, _ in got)), lab)
           for i, got, lab in out]
    totals: dict = {}
    for *_, e, lab in out:
        totals[lab] = totals.get(lab, 0) + e
    return sorted(((i, c, e, min((1 << 63) - 1, totals[lab])) for i, c, e, lab in out),
                  key=repr), books


def _rows(seed, n, size, top):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-top, top) for _ in range(size)], rng.choice([1, 2, 3, None]), "k",
             "c", 1) for i in range(n)]
    rows += [rows[0], rows[3], rows[3], (None, rows[5][1], None, None, None, None),
             (2, rows[7][1], 9, "k", "c", 1), (n + 1, None, 1, "k", "c", 1),
             (n + 2, [], 1, "k", "c", 1), (n + 3, rows[4][1][:3], 1, "k", "c", 1)]
    return rows + [(500 + i, rows[8][1], 7, "k", "c", 1) for i in range(60)]  # copies, one label


@pytest.mark.parametrize("size,top,parts", [(16, 3, 8), (16, 4096, 8), (13, 50, 4), (6, 10**12, 2),
                                            (4, 1 << 61, 2)])
def test_equals_brute_force(spark, size, top, parts):
    rows = _rows(size, 80, size, top)
    want, want_books = plain(rows, parts, 16, 4)
    for p in (1, 5):
        df = spark.createDataFrame(rows, SCHEMA).repartition(p)
        got, books = vector_codes.compress(df, parts=parts, rounds=4)
        assert books == want_books
        assert got.columns == ["vec_id", "label", "_key", "n", "code", "error", "label_error"]
        got = got.select("vec_id", "code", "error", "label_error").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_search_reads_few_entries_and_ties_go_low():
    rng = np.random.default_rng(2)
    centres = rng.integers(-10**6, 10**6, (64, 4))
    book = vector_codes.Book(centres.tolist())
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-50, 50, (5000, 4))
    gap = ((x[:, None, :] - centres[None]) ** 2).sum(-1)
    at, best = book.nearest(x)
    assert (at == gap.argmin(1)).all() and (best == gap.min(1)).all()
    line = vector_codes.Book([[4], [0], [2], [2], [0]])
    at, best = line.nearest(np.array([[1], [3], [2], [0], [9]]))
    assert at.tolist() == [1, 0, 2, 1, 0] and best.tolist() == [1, 1, 0, 0, 25]


def test_fewer_vectors_than_entries_and_empty(spark):
    df = spark.createDataFrame([(1, [1, 2], 0), (2, [5, 6], 0)],
                               "vec_id bigint, vector array<bigint>, label int")
    got, books = vector_codes.compress(df, parts=2)
    assert sorted(map(tuple, got.select("vec_id", "code", "error").collect())) \
        == [(1, [0, 0], 0), (2, [1, 1], 0)] and len(books[0]) == 2
    got, books = vector_codes.compress(df.limit(0))
    assert got.collect() == [] and got.columns == ["vec_id", "label", "code", "error",
                                                   "label_error"]


def test_key_totals_hot_and_rare(spark):
    rows = [(i, f"k{i}" if i % 3 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, k string, v bigint")
    got = vector_codes.with_key_total(df, "k", "v", "t").collect()
    none = sum(i for i in range(3000) if i % 3 == 0)
    assert len(got) == 3000
    assert all(r["t"] == (r["v"] if r["k"] else none) for r in got)


def test_hex_code(spark):
    df = spark.createDataFrame([([0, 15, 16, 255],)], "code array<int>")
    assert df.select(vector_codes.hex_code().alias("h")).first()[0] == "000f10ff"
    assert vector_codes.digest([[[1, -2]], [[3, 4]]]) == vector_codes.digest([[[1, -2], [3, 4]]])
