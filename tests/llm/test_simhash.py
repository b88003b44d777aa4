import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from labelflow.llm import simhash

from .helpers import awkward_rows, frame, same, with_clashes


def plain_fingerprint(text, shingle=3, seed=42):
    """Straight from the definition."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] \
        or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=seed).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(rows, radius=2):
    fps = [plain_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], f - (1 << 64) if f >> 63 else f, low.get(find(i)))
            for i, (r, f) in enumerate(zip(rows, fps))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aA bÉé\n\x1c \tcd", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = [m % (1 << 64) for m in simhash.covering_masks(radius)]
    rng = random.Random(radius)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & flip == 0 for m in masks)
    assert all(bin(m).count("1") >= 30 for m in masks)


def _columns(df):
    return df.select("doc_id", "fp", "component_id")


def test_groups_equal_brute_force(spark):
    got = same(spark, lambda df: _columns(simhash.near_duplicate_groups(df)))
    assert got == sorted(plain_groups(awkward_rows()), key=repr)


def _with_fingerprints(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)],
                                 "fp bigint")


@pytest.mark.parametrize("limit", [0, 3, 2000])
def test_links_complete_on_both_sides_of_the_bucket_limit(spark, limit):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:25]:  # chains and dense balls around some
        for _ in range(4):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            fps.add(f)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << b) for b in range(40)}
    got = {(a % (1 << 64), b % (1 << 64)) for a, b in
           map(tuple, simhash.links(_with_fingerprints(spark, fps), 2, limit).collect())}
    want = {(a, b) for a in fps for b in fps
            if a != b and bin(a ^ b).count("1") <= 2}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want}
    assert len(got) == len(want) // 2


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 600), (600, 700), (9000, 700)]
    got = dict(map(tuple, simhash.components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(201)}, **{k: 500 for k in (500, 600, 700, 9000)}}


def test_empty_table_and_clashing_names(spark):
    assert simhash.near_duplicate_groups(frame(spark, [])).collect() == []
    out = simhash.near_duplicate_groups(with_clashes(frame(spark)))
    assert sorted(map(tuple, _columns(out).collect()), key=repr) == \
        sorted(plain_groups(awkward_rows()), key=repr)
