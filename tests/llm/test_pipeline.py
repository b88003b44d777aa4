import json
import re
from collections import Counter

import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline as cp
from labelflow.llm import queries
from labelflow.llm.queries import tokenizer_path

from .helpers import awkward_rows, frame
from .test_mixing import level_by_rounds, words
from .test_simhash import plain_groups
from .test_suffix_dedup import plain as plain_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The output of every stage on the small tables, written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs.collect())
    return out


def _rows(rows):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]


def test_quality_stage_keeps_clean_documents_unchanged(spark, stages):
    before, after = map(_rows, stages[:2])
    assert not Counter(after) - Counter(before)
    gone = {r[0] for r in before} - {r[0] for r in after}
    labels = {r["doc_id"]: r["quality"] for r in
              spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [labels[i] == (i not in gone) for i in labels]
    assert gone and sum(right) / len(right) > 0.9


def test_near_dedup_stage_equals_brute_force(stages):
    before, after = map(_rows, stages[1:3])
    keep = {c for _, _, c in plain_groups(before)}
    assert sorted(after) == sorted(r for r in before if r[0] in keep)


def test_repeats_stage_equals_brute_force(stages):
    before, after = map(_rows, stages[2:4])
    want = {r[0]: r[1].decode("utf-8", "ignore") for r in plain_repeats(before)}
    assert {r[0]: r[1] for r in after} == want
    assert all(r[4] == len(r[1]) for r in after)


def test_mixing_stage_meets_the_targets(stages):
    before, after = map(_rows, stages[3:5])
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += len(words(r[1]))
    for r in after:
        taken[r[3]] += len(words(r[1]))
    names = sorted(sizes)
    targets = level_by_rounds([sizes[s] for s in names],
                              [[3, 1, 2][i % 3] for i in range(len(names))], 1.5, 2)
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(names, targets))


def test_encoding_stage_equals_the_library(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in stages[4])
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in stages[5]) == want


def test_run_gives_the_last_stage(spark, stages):
    got = cp.run(spark, SF)
    assert Counter(json.dumps(r.asDict(), sort_keys=True) for r in got.collect()) == \
        Counter(json.dumps(r.asDict(), sort_keys=True) for r in stages[5])


@pytest.mark.parametrize("k", range(1, 5))
def test_stages_take_awkward_and_empty_tables(spark, k):
    """All but the first, which needs labels of the same documents."""
    name, stage = cp.STAGES[k]
    got = stage(spark, frame(spark), SF)
    if k < 4:
        assert got.columns == cp.DOCUMENT_COLUMNS
    rows = got.collect()
    assert rows and len(rows) <= 2 * len(awkward_rows())
    assert stage(spark, frame(spark, []), SF).collect() == []


def test_quality_stage_takes_awkward_and_empty_tables(spark):
    stage = cp.STAGES[0][1]
    assert stage(spark, frame(spark), SF).columns == cp.DOCUMENT_COLUMNS
    assert stage(spark, frame(spark, []), SF).collect() == []


def test_one_document_of_equal_rows_stays(spark):
    rows = [(1, "a b c d", "en", "s", 7)] * 3 + [(2, "a b c d", "en", "s", 7),
                                                 (None, "a b c d", "en", "s", 7)]
    got = cp.near_dedup_stage(spark, frame(spark, rows), SF).collect()
    assert [r["doc_id"] for r in got] == [1]


def test_entry_registers_every_query():
    names = entry.queries()
    assert {n for n in names if re.match(r"op\d+_", n)} == set(queries.QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
