import random

import numpy as np
import pytest

from labelflow.llm import suffix_dedup as sd

from .helpers import awkward_rows, frame, same, with_clashes


def plain(rows, length=50):
    """Every window of every document, from the definition."""
    raw = [((r[0] if r[0] is not None else 1 << 62), (r[1] or "").encode()) for r in rows]
    low: dict = {}
    for k, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            low[w] = min(low.get(w, k), k)
    out = []
    for (k, b), r in zip(raw, rows):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if low[b[i:i + length]] < k:
                gone[i:i + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], kept, len(b), sum(gone), spans))
    return sorted(out, key=repr)


def _result(df, **kw):
    out = sd.remove_repeats(df, **kw).select("doc_id", "kept", "n_bytes", "n_removed", "n_spans")
    return sorted(((r[0], bytes(r[1]), *r[2:]) for r in map(tuple, out.collect())), key=repr)


def test_equals_brute_force(spark):
    want = plain(awkward_rows())
    assert sum(r[3] for r in want) > 1000
    for parts in (1, 5):
        assert _result(frame(spark, parts=parts)) == want
        assert _result(frame(spark, parts=parts), group_bytes=100) == want  # many groups


@pytest.mark.parametrize("frequent", [0, 2])
def test_frequent_anchors_by_longer_keys(spark, frequent):
    assert _result(frame(spark), group_bytes=100, frequent=frequent) == plain(awkward_rows())


@pytest.mark.parametrize("length", [21, 30, 51])
def test_other_lengths(spark, length):
    assert _result(frame(spark), length=length) == plain(awkward_rows(), length)


def test_few_letters_and_long_runs(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(30)) * rng.choice([1, 3, 9])
             + "a" * rng.choice([0, 49, 50, 51, 200]), "en", "s", 0) for i in range(40)]
    assert _result(frame(spark, rows), group_bytes=500) == plain(rows)


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(150):
        n, width = rng.randint(1, 12), rng.randint(21, 40)
        depth = rng.randint(1, 20)
        rows = np.array([[rng.choice([0, 1, 2, 255]) for _ in range(width)] for _ in range(n)],
                        np.uint8)
        order = sd.two_stage_order(rows, depth, width - depth)
        keys = [rows[p // (width + 1), p % (width + 1):][:depth].tobytes() for p in order.tolist()]
        assert keys == sorted(keys) and len(set(order.tolist())) == n * (width - depth + 1)


def test_text_result_drops_cut_characters(spark):
    rows = [(1, "y" * 25 + "é" * 30, "", "", 0), (2, "y" * 25 + "é" * 13 + "日" * 20, "", "", 0)]
    out = {r["doc_id"]: r["kept"] for r in
           sd.remove_repeats(frame(spark, rows), as_text=True).collect()}
    assert out[1] == rows[0][1]
    assert out[2] in ("é" * 0 + "日" * 20, "日" * 20)


def test_empty_table_and_clashing_names(spark):
    assert sd.remove_repeats(frame(spark, [])).collect() == []
    assert _result(with_clashes(frame(spark))) == plain(awkward_rows())


def test_partitioning_does_not_matter(spark):
    same(spark, lambda df: sd.remove_repeats(df).select("doc_id", "n_removed", "n_spans"))


def _hot_passage():
    """One passage in a third of the documents, behind random text."""
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(90))
    rows = []
    for i in range(240):
        own = "".join(rng.choice("klmnopqrst ") for _ in range(60))
        rows.append((i, own + passage if i % 3 == 0 else own, "en", "s", 0))
    return rows


@pytest.mark.parametrize("frequent", [5, 20])
def test_hot_passage_behind_random_text(spark, frequent):
    rows = _hot_passage()
    assert _result(frame(spark, rows), group_bytes=1000, frequent=frequent) == plain(rows)


def test_hot_passage_fills_no_key():
    rows = _hot_passage()
    own = sd.Group([r[1] for r in rows], np.array([r[0] for r in rows]), 50)

    def counted(h, doc):
        h, n = np.unique(np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1)[0],
                         return_counts=True)
        return h[n > 1], h[n > 20]

    pos, h = own.anchors()
    shared, often = counted(h & ~np.uint64(15), own.doc_of(pos))
    assert len(often)
    longer, often_longer = counted(*own.longer_keys(often))
    contexts, windows = own.contexts(shared, often, longer, often_longer)
    for key in (contexts[4], windows[2]):  # distinct rows that meet under one key
        assert not len(key) or np.unique(key, return_counts=True)[1].max() <= 20
    assert len(windows[0]) > 80


def _group(texts):
    return sd.Group(texts, np.arange(len(texts)), 50)


def _all_anchors(own):
    return np.unique(own.anchors()[1] & ~np.uint64(15))


def test_a_window_is_in_one_context():
    rng = random.Random(4)
    own = _group(["".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (400, 49, 50, 0, 90)])
    none = np.zeros(0, np.uint64)
    (_, _, first, last, _, of, pos, _), _ = own.contexts(_all_anchors(own), none, none, none)
    held = np.concatenate([np.arange(p - 30 + first[c], p - 30 + last[c])
                           for p, c in zip(pos.tolist(), of.tolist())])
    assert sorted(held.tolist()) == np.flatnonzero(own.window).tolist()


@pytest.mark.parametrize("letters", ["ab", "abcdefghij "])
def test_slices_do_not_matter(letters, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(9)]
    own = _group([*texts, "a" * 200, "ab" * 80])
    want = own._around(_all_anchors(own))
    monkeypatch.setattr(sd, "_SLICE", 64)
    for x, y in zip(own._around(_all_anchors(own)), want):
        assert x.tolist() == y.tolist()


def test_suffix_order_of_some_columns():
    rng = random.Random(8)
    for _ in range(150):
        n, width = rng.randint(1, 12), rng.randint(21, 60)
        depth = rng.randint(1, width)
        wide = width - depth + 1
        rows = np.array([[rng.choice([0, 1, 255]) for _ in range(width)] for _ in range(n)],
                        np.uint8)
        first = np.array([rng.randint(0, wide) for _ in range(n)])
        last = np.array([rng.randint(0, wide) for _ in range(n)])
        order = sd.two_stage_order(rows, depth, wide - 1, first, last).tolist()
        keys = [rows[p // (width + 1), p % (width + 1):][:depth].tobytes() for p in order]
        assert keys == sorted(keys)
        assert sorted(order) == [r * (width + 1) + c for r in range(n)
                                 for c in range(first[r], last[r])]


def test_shared_phrases_shorter_than_a_window_are_not_sorted():
    rng = random.Random(9)
    phrase, letters = "a phrase that is no window", "klmnopqrst"
    texts = ["".join(rng.choice(letters) for _ in range(80)) + phrase
             + "".join(rng.choice(letters) for _ in range(80)) for _ in range(200)]
    passage = "".join(rng.choice(letters) for _ in range(60))
    own = _group([*texts, "1" * 30 + passage + "2" * 30, "3" * 30 + passage + "4" * 30])
    h, n = np.unique(own.anchors()[1] & ~np.uint64(15), return_counts=True)
    none = np.zeros(0, np.uint64)
    (rows, low, first, last, *_), _ = own.contexts(h[n > 1], none, none, none)
    assert len(rows) >= 50
    begin, end = sd.with_partners(rows, first, last, 50)
    kept = [{rows[i, c:c + 50].tobytes() for c in range(a, b)}
            for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist()))]
    windows = [{rows[i, c:c + 50].tobytes() for c in range(a, b)}
               for i, (a, b) in enumerate(zip(first.tolist(), last.tolist()))]
    assert sum(map(bool, kept)) < 10  # of 50 and more
    for i, w in enumerate(windows):  # what another context holds is kept
        assert all(x in kept[i] for x in w if any(x in v for j, v in enumerate(windows) if j != i))
    assert {passage[i:i + 50].encode() for i in range(11)} <= set().union(*kept)
