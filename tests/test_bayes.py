"""M3/M4 as aggregations: naive Bayes margins against a plain Python computation."""

import hashlib
import math
import re

import pytest

from labelflow.operators.bayes import fit_naive_bayes, score_naive_bayes, word_features
from labelflow.operators.regimes import regime_memberships

D = 64


def feats(text):
    words = [w for w in re.split(r"\W+", text or "", flags=re.ASCII) if w]
    return [int(hashlib.md5(w.lower().encode()).hexdigest()[:7], 16) % D for w in words]


def brute(train, text):
    """``train``: list of (label, text) of one group → margin of ``text``."""
    m, p = len(train), sum(y for y, _ in train)
    w = {1: m / (2.0 * max(p, 1)), 0: m / (2.0 * max(m - p, 1))}
    df, s = [0] * D, {0: [0.0] * D, 1: [0.0] * D}
    for y, t in train:
        x = feats(t)
        for f in set(x):
            df[f] += 1
        for f in x:
            s[y][f] += w[y]
    idf = [math.log((m + 1.0) / (df[j] + 1.0)) for j in range(D)]
    n = {c: [idf[j] * s[c][j] for j in range(D)] for c in (0, 1)}
    tot = {c: sum(n[c]) + D for c in (0, 1)}
    theta = {c: [math.log(n[c][j] + 1.0) - math.log(tot[c]) for j in range(D)] for c in (0, 1)}
    wc = {c: sum(w[y] for y, _ in train if y == c) for c in (0, 1)}
    prior = math.log(wc[1] + 1.0) - math.log(wc[0] + 1.0)
    return prior + sum(idf[f] * (theta[1][f] - theta[0][f]) for f in feats(text))


TRAIN = {
    "a": [(1, "Bad, awful words!"), (1, "awful awful thing"), (0, "nice day"), (0, "a nice, kind note"),
          (0, "kind words")],
    "b": [(1, "ugly"), (0, "lovely lovely"), (0, "")],
    "c": [(1, ""), (0, None), (0, "!!")],      # no word at all: only the priors count
}
SCORE = ["awful day", "nice", "", None, "unseen-token here", "awful awful awful kind"]


def test_word_features_match_python(spark):
    df = spark.createDataFrame([(t,) for t in SCORE + ["Ünïcode wörds_1 x"]], "t string")
    got = [r.x for r in df.select(word_features("t", D).alias("x")).collect()]
    assert got == [feats(t) for t in SCORE + ["Ünïcode wörds_1 x"]]


def test_margins_equal_brute_force(spark):
    rows = [(g, y, t) for g, ts in TRAIN.items() for y, t in ts]
    train = spark.createDataFrame(rows, "g string, y int, t string") \
        .select("g", "y", word_features("t", D).alias("x"))
    model = fit_naive_bayes(train, group="g", label="y", features="x", num_features=D)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(SCORE)], "i int, text string")
    out = score_naive_bayes(target, model, ["a", "b", "c", "none"]).collect()
    assert len(out) == 4 * len(SCORE)
    for r in out:
        if r.group == "none":   # no training rows: margin 0, negative class
            assert r.margin == 0.0 and r.pred == 0
            continue
        want = brute(TRAIN[r.group], SCORE[r.i])
        assert r.margin == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert r.pred == (1 if want > 0 else 0)


def test_duplicate_texts_scored_once_each_row_kept(spark):
    train = spark.createDataFrame([("a", 1, "bad"), ("a", 0, "good")], "g string, y int, t string") \
        .select("g", "y", word_features("t", D).alias("x"))
    model = fit_naive_bayes(train, group="g", label="y", features="x", num_features=D)
    target = spark.createDataFrame([(1, "bad bad"), (2, "bad bad"), (3, "good")], "i int, text string")
    got = {r.i: r.margin for r in score_naive_bayes(target, model, ["a"]).collect()}
    assert got[1] == got[2] > 0 > got[3]


def test_regime_memberships(spark):
    rows = [("m1", "t1", 1, 0, "meme", "train"), ("m2", "t2", None, 1, "meme", None),
            ("v1", "t3", 0, None, "video", "train"), ("v2", "t4", 1, None, "video", "test")]
    items = spark.createDataFrame(rows, "id string, text string, label int, rm_label int, "
                                        "domain string, type string")
    got = sorted(tuple(r) for r in regime_memberships(items, ["om_ft", "rm_ft", "vid_ft", "vid_rm"])
                 .collect())
    assert got == sorted([("om_ft", 1, "t1"), ("rm_ft", 0, "t1"), ("rm_ft", 1, "t2"),
                          ("vid_ft", 0, "t3"), ("vid_rm", 0, "t3"), ("vid_rm", 0, "t1"),
                          ("vid_rm", 1, "t2")])
