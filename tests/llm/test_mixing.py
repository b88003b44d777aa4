import re
from collections import Counter, defaultdict

import pytest

from labelflow.llm import mixing

from .helpers import awkward_rows, frame, same, with_clashes

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return GAP.findall(text or "")


def level_by_rounds(sizes, weights, share, cap):
    """Targets by resharing the excess again and again, as the definition says."""
    total, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(cap * sizes[i] for i in capped)
        level = rest / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if level * weights[i] > cap * sizes[i]]
        if not over:
            return [cap * s if i in capped else level * weights[i] for i, s in enumerate(sizes)]
        capped |= set(over)


@pytest.mark.parametrize("sizes", [[10, 20, 30, 40], [1000, 1, 1, 1], [5, 0, 5], [7], [0, 0],
                                   [1, 2, 4, 8, 16, 32, 64, 128, 256]])
def test_targets(sizes):
    weights = [[3, 1, 2][i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 1.5, 2)
    assert got == pytest.approx(level_by_rounds(sizes, weights, 1.5, 2), abs=1e-9)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))


@pytest.mark.parametrize("block", [1, 7, 128])
def test_every_source_gives_its_target_to_the_word(spark, block):
    per, pieces, _, plan = mixing.mix(frame(spark), [3, 1, 2], 1.5, block=block, shard_slots=50)
    rows, want = per.collect(), awkward_rows()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == \
        Counter((r[0], r[3], len(words(r[1]))) for r in want)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    targets = level_by_rounds([sizes[s] for s in names],
                              [[3, 1, 2][i % 3] for i in range(len(names))], 1.5, 2)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[names.index(r["source"])])
    for s, t in zip(names, targets):
        assert abs(taken[s] - t) <= 1
    assert sum(r["n"] for r in pieces.collect()) == sum(taken.values())


def test_pieces_name_real_words_and_documents_rebuild(spark):
    per, pieces, texts, _ = mixing.mix(frame(spark), [3, 1, 2], 1.5, block=5, shard_slots=50)
    slots = defaultdict(set)
    by_pass = Counter()
    of_row = {r["row"]: r for r in texts.collect()}
    assert len(of_row) == len(awkward_rows())
    for r in pieces.collect():
        text = words(of_row[r["row"]]["text"])
        assert r["size"] == len(text)
        assert 0 <= r["first"] and r["first"] + r["n"] <= len(text) and r["n"] > 0
        slots[r["row"]["source"]].add(r["slot"])
        for k in range(r["first"], r["first"] + r["n"]):
            by_pass[r["row"], r["pass"], k] += 1
    assert set(by_pass.values()) == {1}  # a pass takes no word twice
    docs = mixing.mixed_documents(pieces, texts).collect()
    got, want = Counter(), Counter()
    for r in docs:
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for r in per.collect():
        want[r["doc_id"]] += r["taken"]
    assert got == +want
    originals = {r[1] for r in awkward_rows()}
    assert sum(r["text"] in originals for r in docs) > 10  # whole texts stay as they are


def test_shards_hold_multinomial_counts(spark):
    rows = [(i, "w " * 64, "en", f"s{i % 2}", 0) for i in range(400)]
    _, pieces, *_ = mixing.mix(frame(spark, rows), [1, 1], 1.0, block=64, shard_slots=100)
    counts = Counter((r["shard"], r["row"]["source"]) for r in pieces.collect())
    full = [counts[k, "s0"] for k in range(4)]
    assert len(set(full)) > 1 and all(20 < c < 80 for c in full)


def test_reruns_and_partitioning_agree(spark):
    same(spark, lambda df: mixing.mix(df, [3, 1, 2], 1.5, block=9)[0])


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 128, 10**6, 3 * 10**9])
def test_multipliers_permute(n):
    from math import gcd
    for seed in range(5):
        a = mixing._coprime(n, seed)
        assert gcd(a, n) == 1 and a * n < 1 << 63
    if n <= 200:
        assert sorted(i * mixing._coprime(n, 3) % n for i in range(n)) == list(range(n))


def test_empty_table_and_clashing_names(spark):
    per, pieces, texts, plan = mixing.mix(frame(spark, []), [3, 1, 2], 1.5)
    assert per.collect() == [] and pieces.collect() == [] and plan == []
    assert mixing.mixed_documents(pieces, texts).collect() == []
    per, pieces, texts, _ = mixing.mix(with_clashes(frame(spark)), [3, 1, 2], 1.5)
    assert per.count() == len(awkward_rows()) and pieces.count() > 0
    assert mixing.mixed_documents(pieces, texts).where("lang IS NULL").count() == 0
