from collections import Counter

from labelflow.llm import sharding

from .helpers import awkward_rows, frame, same, with_clashes


def _check(rows, n, shards):
    counts = Counter(r["shard"] for r in rows)
    assert sum(counts.values()) == n
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_rows_law_and_content(spark):
    rows = sharding.shard(frame(spark), 8, min_buckets=5).collect()
    want = awkward_rows()
    _check(rows, len(want), 8)
    assert Counter(tuple(r)[:5] for r in rows) == Counter(want)


def test_partitioning_and_reruns_do_not_matter(spark):
    same(spark, lambda df: sharding.shard(df, 4, min_buckets=7))


def test_seed_changes_the_order(spark):
    a, b = (sorted((r["shard"], r["slot"], r["doc_id"] or -1) for r in
                   sharding.shard(frame(spark), 2, seed=s).collect()) for s in (1, 2))
    assert a != b


def test_repeated_rows_are_dealt_over_all_buckets(spark):
    rows = [(1, "same", "en", "s", 0)] * 400 + [(i, str(i), "en", "s", 0) for i in range(50)]
    got = sharding.shard(frame(spark, rows), 8, min_buckets=4, hot_rows=100).collect()
    _check(got, 450, 8)
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)


def test_empty_table_and_clashing_names(spark):
    assert sharding.shard(frame(spark, []), 8).collect() == []
    out = sharding.shard(with_clashes(frame(spark)), 3)
    assert out.columns.count("shard") == 1 and out.columns.count("slot") == 1
    _check(out.collect(), len(awkward_rows()), 3)
