import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import robust_rules as R
from tests.llm.helpers import awkward_rows, frame, prose, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for k in range(len(words) - 2):
        at[tuple(words[k:k + 3])].append(k)
    rep = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            sum(x in lines[:k] for k, x in enumerate(lines)), len(rep), len(lines))


def plain_judge(rows, min_rows, steps=6):
    """(doc_id, n_words, base_failed, kept) with whole groups in memory."""
    judged, members = [], defaultdict(list)
    for at, (i, text, lang, source, _) in enumerate(rows):
        s = plain_stats(text)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        judged.append([i, s[0], failed, not failed])
        if not failed:
            members[lang, source].append((at, R.transformed(s)))
    groups, pool = [], defaultdict(list)
    for (lang, _), own in members.items():
        (groups.append(own) if len(own) >= min_rows else pool[lang].extend(own))
    rest = []
    for own in pool.values():
        (groups.append(own) if len(own) >= min_rows else rest.extend(own))
    if len(rest) >= min_rows:
        groups.append(rest)
    for own in groups:
        z = np.array([v for _, v in own], float)
        far = _plain_distances(z, steps)
        for (at, _), d in zip(own, far):
            judged[at][3] = bool(d <= R.quantile(R.WITHIN))
    return sorted((tuple(j) for j in judged), key=repr)


def _plain_distances(z, steps):
    n = len(z)
    low = lambda v: np.sort(v, axis=0)[(n - 1) // 2]
    mid = low(z)
    mad = low(np.abs(z - mid))
    floor = np.diag(np.square(np.array(R.FLOORS, float)))

    def distances(m, c):
        return np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)

    def over(pick):
        share = pick.sum() / n
        return z[pick].mean(0), np.cov(z[pick].T, bias=True) * R.consistency(share) + floor

    ends = []
    for spread in (np.square(1.4826 * mad), np.zeros(R.DIMS)):
        m, c = mid, np.diag(spread) + floor
        for _ in range(steps):
            bins = np.minimum(np.floor(R.BINS * np.log2(1 + distances(m, c))), R.MOST_BINS)
            m, c = over(bins <= np.sort(bins)[(n + R.DIMS + 1) // 2 - 1])
        ends.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(ends, key=lambda e: e[0])
    pick = distances(m, c) <= R.quantile(R.REWEIGHT)
    m, c = z[pick].mean(0), np.cov(z[pick].T, bias=True) + floor
    return distances(m, c)


def _rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
                  for _ in range(3000)]
    rows, i = awkward_rows(), 1000
    for lang, source, n in [("en", "a", 150), ("en", "b", 10), ("en", None, 20), ("de", "a", 30),
                            (None, None, 15), ("fr", "a", 12), ("", "a", 9)]:
        for _ in range(n):
            words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 150))]
            if rng.random() < 0.2:
                words = [w + rng.choice(["#", "$$$", "", "***longer"]) * 3 for w in words]
            if rng.random() < 0.1:
                words += words[:rng.randint(5, 60)]
            rows.append((i, "".join(w + rng.choice([" ", " ", "\n"]) for w in words), lang, source,
                         None))
            i += 1
    copy = rows[-80][1]
    return rows + [(5000 + k, copy, "en", "a", 0) for k in range(60)] + [rows[-1]]


@pytest.mark.parametrize("min_rows", [25, 100_000])
def test_equals_plain(spark, min_rows):
    rows = _rows()
    want = plain_judge(rows, min_rows)
    for parts in (1, 5):
        got = R.judge(frame(spark, rows, parts), min_rows=min_rows)
        got = got.select("doc_id", "n_words", "base_failed", "kept").collect()
        assert sorted(map(tuple, got), key=repr) == want
    if min_rows == 25:
        sound = [w[3] for w in want if not w[2]]
        assert 0 < sound.count(False) < sound.count(True)


@pytest.mark.parametrize("text", ["", " \n\t", "a", "a b c", "a b c a b c", "a a a a", "x\n\nx\ny\nx",
                                  "a b\x0bc\x1cd a b", "é#ñ é#ñ $", "a\r\nb\r\na\r\na\n"])
def test_stats(text):
    assert R.text_stats(text) == plain_stats(text)


def test_stats_of_random_texts():
    rng = random.Random(5)
    for _ in range(200):
        text = prose(rng, rng.choice([5, 50, 500])) + rng.choice(["", "\n# |", " <a>&"])
        assert R.text_stats(text) == plain_stats(text)


def test_a_half_of_junk_copies_does_not_hide_itself():
    rng = np.random.default_rng(1)
    clean = rng.normal(0, 60, (520, 4)) + [1600, 50, 0, 0]
    junk = np.tile([2100.0, 2800, 300, 200], (480, 1))
    far = _plain_distances(np.round(np.vstack([clean, junk])), 6)
    assert (far[520:] > R.quantile(R.WITHIN)).all()
    assert (far[:520] <= R.quantile(R.WITHIN)).mean() > 0.99


def test_clashing_columns_empty_and_small(spark):
    df = with_clashes(frame(spark)).withColumn("g", F.lit("g"))
    got = R.judge(df.withColumnRenamed("bucket", "n_words"))
    assert [c for c in got.columns if c == "n_words"] == ["n_words"]
    assert dict(got.dtypes)["n_words"] == "bigint" and "key" not in got.columns
    assert {r["g"] for r in got.collect()} == {"g"} and got.count() == len(awkward_rows())
    none = R.judge(frame(spark, []))
    assert none.collect() == []


def test_quantiles():
    assert math.isclose(R.quantile(0.95), 9.487729, abs_tol=1e-5)
    assert math.isclose(R.quantile(0.9999), 23.512742, abs_tol=1e-5)
    assert R.consistency(1.0) == 1.0 and 2 < R.consistency(0.5) < 2.2
