import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from labelflow.llm import quality as q

from .helpers import awkward_rows, frame, prose, same, with_clashes

SMALL = q.FtrlParams(bits=14, epochs=6, max_rows=500)


def _corpus(n=300, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(5, 80))
        if not good:
            text = " ".join(w + "$$$" for w in text.split()) if i % 2 else \
                " ".join(f"{w} {w} {w}" for w in text.split())
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), -7, 10**12]] + [(None,)],
                               "doc_id bigint")
    for r in df.withColumn("h", q.held_out()).collect():
        want = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["h"] == want


def test_held_out_accuracy(spark):
    rows, labels = _corpus()
    lab = spark.createDataFrame(labels, "doc_id bigint, label int")
    w = q.fit(frame(spark, rows), lab.where(~q.held_out()), SMALL)
    got = {r["doc_id"]: r["score"] for r in
           q.score(frame(spark, rows), w, SMALL).where(q.held_out()).collect()}
    truth = dict(labels)
    assert len(got) > 70
    assert np.mean([(s >= 0.5) == truth[i] for i, s in got.items()]) > 0.95


def test_scores_are_sparse_dot_products(spark):
    w = np.random.default_rng(1).normal(size=(1 << SMALL.bits) + 1)
    for r in q.score(frame(spark), w, SMALL).collect():
        i, x = q.features(r["text"] or "", SMALL.bits)
        z = sum(w[a] * b for a, b in zip(i, x)) + w[-1]
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_ftrl_follows_its_formula():
    """One feature, one row: the closed form of the first updates."""
    p = q.FtrlParams(bits=1, alpha=0.5, beta=1.0, l1=0.0, l2=0.0, epochs=1)
    model = q.Ftrl(p)
    model.learn(np.array([0]), np.array([1.0]), 1)
    w = model.weights()
    g = 0.5 - 1
    want = -g / ((1.0 + abs(g)) / 0.5)
    assert abs(w[0] - want) < 1e-12 and abs(w[-1] - want) < 1e-12


def test_fit_is_the_same_at_any_partitioning(spark):
    rows, labels = _corpus(80)
    lab = spark.createDataFrame(labels, "doc_id bigint, label int")
    a, b = (q.fit(frame(spark, rows, parts=p), lab.repartition(p), SMALL) for p in (1, 5))
    assert (a == b).all()


def test_sample_bound_and_awkward_labels(spark):
    lab = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(None, 1), (5, None), (6, 1)],
                                "doc_id bigint, label int")
    keys = q.sample_keys(lab, q.FtrlParams(max_rows=100))
    assert keys.count() == 100 and keys.select("k").distinct().count() == 100
    none = lab.where(F.lit(False))
    assert not q.fit(frame(spark), none, SMALL).any()


def test_awkward_rows(spark):
    w = np.zeros((1 << SMALL.bits) + 1)
    w[-1] = 1.0
    rows = same(spark, lambda df: q.score(df, w, SMALL).select("doc_id", "score"))
    assert len(rows) == len(awkward_rows())
    assert all(0 <= r[1] <= 1 for r in rows)
    assert q.score(frame(spark, []), w, SMALL).collect() == []
    assert q.score(with_clashes(frame(spark)), w, SMALL).columns.count("score") == 1


def test_what_only_the_end_of_a_long_text_tells_is_learnt(spark):
    same_start = " ".join(prose(random.Random(4), 2100).split()[:2050])
    rows = [(i, same_start + (" fine" if i % 2 else " poor") * 60, "en", "s", 0)
            for i in range(40)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, label int")
    w = q.fit(frame(spark, rows), lab, SMALL)
    index, _ = q.features(rows[0][1], SMALL.bits)
    assert (w[index] != 0).any()
    for r in q.score(frame(spark, rows), w, SMALL).collect():
        assert (r["score"] >= 0.5) == bool(r["doc_id"] % 2)


def test_vectors_travel_in_small_rows():
    rng = np.random.default_rng(2)
    want, rows = [], []
    for h, n in enumerate((0, 1, q.PIECE, 3 * q.PIECE + 5)):
        i, x = np.sort(rng.choice(1 << 18, n, replace=False)), rng.random(n)
        want.append((i, x, h % 2))
        rows += [r for b in q.vector_rows(h, str(h), h % 2, i, x) for r in b.to_pylist()]
    assert max(len(r["x"]) for r in rows) == 8 * q.PIECE
    got = list(q.joined_vectors(tuple(r[c] for c in ("h", "k", "y", "i", "x")) for r in rows))
    assert len(got) == len(want)
    for g, (i, x, y) in zip(got, want):
        assert (g[0] == i).all() and (g[1] == x).all() and g[2] == y
    assert list(q.joined_vectors([])) == []


def test_epochs_as_jobs_equal_a_loop_in_their_order(spark):
    rows, labels = _corpus(60)
    got = q.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, label int"), SMALL)
    keyed = spark.createDataFrame([(i, str(i)) for i, _ in labels], "d bigint, k string") \
        .withColumn("h", F.xxhash64(F.lit(SMALL.seed), "d"))
    model, text, label = q.Ftrl(SMALL), {r[0]: r[1] for r in rows}, dict(labels)
    for epoch in range(SMALL.epochs):
        for r in keyed.orderBy(F.xxhash64(F.lit(SMALL.seed + epoch), "h", "k"), "h", "k").collect():
            model.learn(*q.features(text[r["d"]], SMALL.bits), label[r["d"]])
    assert (got == model.weights()).all()
