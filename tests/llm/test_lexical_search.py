import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from labelflow.llm import lexical_search as L
from tests.llm.helpers import awkward_rows, frame, prose, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(queries, docs, k):
    """Every document scored for every query, straight from the formula."""
    held = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    n_docs = sum(1 for _, c in held if c)
    n_terms = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, text in set(queries):
        scored = []
        for i, c in held:
            score = 0
            for t in set(TERM.findall((text or "").translate(FOLD))) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for r, (s, none, i) in enumerate(sorted(scored)[:k]):
            out.append((q, r + 1, None if none else i, -s))
    return sorted(out, key=repr)


QUERIES = [(1, "The QUICK brown fox"), (2, "ñandú Élan 日本!"), (3, ""), (4, None), (5, "absent"),
           (6, "lazy dog lazy dog"), (6, "runs"), (6, "runs"), (None, "jumps over"),
           (7, "x" * 5000)]


def _queries(spark, rows=QUERIES):
    return spark.createDataFrame([(*r, 7) for r in rows],
                                 "item_id bigint, text string, rank int")


@pytest.mark.parametrize("k,blocks", [(5, {}), (50, {"block_queries": 2}), (3, {"block_pairs": 1})])
def test_equals_brute_force(spark, k, blocks, monkeypatch):
    rng = random.Random(4)
    rows = awkward_rows() + [(100 + i, prose(rng, rng.choice([2, 9, 40])), "en", "s", 0)
                             for i in range(200)]
    want = plain(QUERIES, [(r[0], r[1]) for r in rows], k)
    for parts in (1, 5):
        got = L.rank(_queries(spark), with_clashes(frame(spark, rows, parts)), k, **blocks)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_empty_tables(spark):
    assert L.rank(_queries(spark), frame(spark, []), 5).collect() == []
    assert L.rank(_queries(spark, [(1, "a")]).limit(0), frame(spark), 5).collect() == []
    assert L.rank(_queries(spark), frame(spark, [(1, " .!", "en", "s", 0)]), 5).collect() == []


def test_terms():
    for text in ("A-b_C9 \x00é\x7fñ~[x]", "日本 ÀB", "", "İKẞ a b"):
        got = [t.decode() for t in L.terms(text.encode())]
        assert got == TERM.findall(text.translate(FOLD))


def _random_tree(seed, n, width, leaf=4):
    rng = np.random.default_rng(seed)
    groups = rng.random((6, width)) < 0.15
    dense = (groups[rng.integers(0, 6, n)] & (rng.random((n, width)) < 0.7)) \
        * rng.integers(1, 10**10, (n, width))
    start = np.concatenate([[0], np.cumsum((dense > 0).sum(1))])
    return dense, L.Tree(start, np.nonzero(dense)[1], dense[dense > 0], width, leaf)


def test_bounds_hold_and_prune():
    dense, tree = _random_tree(1, 700, 90)
    rng = random.Random(2)
    block = L.Block([(q, f"t{t:03d}", 1) for q in range(20)
                     for t in sorted(rng.sample(range(90), 8))]
                    + [(20, f"t{t:03d}", 1) for t in range(90)])
    number = {t: int(t[1:]) for t in block.vocabulary}
    assert list(number.values()) == list(range(90))
    bounds, rows = tree.bounds(block), dense[tree.order]
    for q, own in enumerate(block.terms):
        score = rows[:, own].sum(1)
        for i in range(len(tree.first)):
            assert score[tree.first[i]:tree.last[i]].max() <= bounds[i, q]
    seen = []
    real = tree.leaf_scores
    tree.leaf_scores = lambda i, holds: seen.append(i) or real(i, holds)
    ids = list(range(700))
    got: dict = {}
    for q, r, s in tree.search(block, ids, 5, np.zeros(block.size, np.int64)):
        got.setdefault(q, []).append((-s, r))
    for q, own in enumerate(block.terms):
        score = rows[:, own].sum(1)
        want = sorted((-int(s), r) for r, s in enumerate(score) if s > 0)[:5]
        assert sorted(got.get(q, []))[:5] == want
    leaves = len(tree.first) - tree.inner
    assert len(seen) < 0.8 * leaves * block.size  # subtrees were dropped


def test_a_floor_and_ties_lose_nothing():
    dense = np.ones((300, 3), np.int64) * 7
    start = np.arange(301) * 3
    tree = L.Tree(start, np.tile(np.arange(3), 300), dense.ravel(), 3, 4)
    block = L.Block([(0, "a", 1), (0, "b", 1), (0, "c", 1)])
    ids = [300 - int(o) for o in tree.order]
    found = sorted((ids[r], s) for _, r, s in tree.search(block, ids, 5, np.array([21])))[:5]
    assert found == [(i, 21) for i in range(1, 6)]
    assert list(tree.search(block, ids, 5, np.array([22]))) == []
