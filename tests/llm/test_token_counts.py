import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from labelflow.llm import token_counts
from labelflow.llm.queries import tokenizer_path

from .helpers import awkward_rows, frame, same, with_clashes

PATH = tokenizer_path("byte_bpe_50k.json")
library = Library.from_file(PATH)
ours = token_counts.tokenizer(PATH)


def _want(texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


PARTS = ["'", "s", "t", "re", "ve", "ll", "l", "r", " ", "  ", "\n", "\t", "a", "B", "é", "日", "1",
         "٣", "!", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<|endoftext", "²", "🎉",
         "́", "don"]


def test_random_texts_equal_the_library():
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert list(ours.counts(texts)) == _want(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(texts):
    assert list(ours.counts(texts)) == _want(texts)


def test_every_code_point():
    texts = [f"!a{chr(c)}a1{chr(c)}1\n\n{chr(c)}!" for c in range(0, 0x30000, 3)
             if not 0xD800 <= c < 0xE000]
    assert list(ours.counts(texts)) == _want(texts)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "日本語" * 900, "-" * 777 + "x",
                                  "ab " * 30000, "", "\n" * 1000 + "'s"])
def test_long_and_uniform_texts(text):
    assert list(ours.counts([text])) == _want([text])


def test_state_maps_compose_to_the_sequential_run():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 11, 5000).astype(np.uint8)
    state, want = token_counts.START, np.zeros(5001, bool)
    for i, c in enumerate(classes.tolist()):
        state, out = token_counts._step(state, c)
        if out & token_counts.HERE:
            want[i] = True
        if out & token_counts.BEFORE:
            want[i - 1] = True
    assert (token_counts.starts(classes) == want[:5000]).all()


def test_a_small_memory_changes_nothing():
    small = token_counts.Tokenizer(PATH)
    small.counter.KEEP, small.counter.STATES = 20, 30
    texts = [r[1] or "" for r in awkward_rows()]
    assert list(small.counts(texts)) == _want(texts)


def test_operator(spark):
    rows = same(spark, lambda df: token_counts.add_token_counts(df, PATH).select("doc_id",
                                                                                 "n_tokens"))
    want = _want([r[1] or "" for r in awkward_rows()])
    assert rows == sorted(((r[0], n) for r, n in zip(awkward_rows(), want)), key=repr)
    assert token_counts.add_token_counts(frame(spark, []), PATH).collect() == []
    assert token_counts.add_token_counts(with_clashes(frame(spark)), PATH).count() == len(want)
