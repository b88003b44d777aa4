import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from labelflow.llm import sentencepiece_codec as sc
from labelflow.llm.queries import tokenizer_path

from .helpers import awkward_rows, frame, same, with_clashes

PATH = tokenizer_path("piece_bpe_32k.model")
library = sentencepiece.SentencePieceProcessor(model_file=PATH)

PARTS = [" ", "  ", "a", "b", "the", "in", "日", "本", "▁", "é", "\n", "\x00", "🎉", "<s>", "<0x41>",
         "    ", "ing", "ab", "er", "ation", ".", "..", "==", "--", "1", "\t"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 17, 16384])
def test_chunked_encoding_equals_the_library(chunk):
    codec, rng = sc.Codec(PATH, chunk=chunk), random.Random(chunk)
    kinds = [PARTS, [p for p in PARTS if " " not in p and p != "▁"], ["a", "b", "aa"],
             ["=", "-", "==", " "]]
    for _ in range(400):
        parts = rng.choice(kinds)
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids = codec.encode(text)
        assert ids == library.encode(text)
        assert codec.decode(ids) == library.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120), st.sampled_from([4, 9, 16384]))
def test_any_text(text, chunk):
    assert _codecs(chunk).encode(text) == library.encode(text)


_known: dict = {}


def _codecs(chunk):
    if chunk not in _known:
        _known[chunk] = sc.Codec(PATH, chunk=chunk)
    return _known[chunk]


@pytest.mark.parametrize("text", ["日本語" * 20000, "x" * 40000, " " * 50000, "ab " * 30000])
def test_giant_texts(text):
    codec = sc.codec(PATH)
    ids = codec.encode(text)
    assert ids == library.encode(text) and codec.decode(ids) == text


def test_operator_round_trip(spark):
    rows = same(spark, lambda df: sc.add_ids(df, PATH, decoded="back")
                .select("doc_id", "token_ids", "back"))
    want = [(r[0], library.encode(r[1] or ""), r[1] or "") for r in awkward_rows()]
    assert rows == sorted(want, key=repr)
    ids = sc.add_ids(frame(spark), PATH)
    back = sc.decode_ids(ids, PATH).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((r[0], r[2]) for r in want), key=repr)


def test_empty_table_and_clashing_names(spark):
    assert sc.add_ids(frame(spark, []), PATH).collect() == []
    assert sc.add_ids(with_clashes(frame(spark)), PATH).count() == len(awkward_rows())
