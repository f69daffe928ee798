import functools

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkfold.llm.tokens import PieceEncoder, encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = "ab'7 \n\t\r\x1c\x85\xa0 ́éÉ.!~中\U0001f600"
TEXTS = ["", " ", "\n", "a", " a", "a ", "a\nb", "a\n\nb", "a \nb", "a\n b", "a  b", "a   b", "it's The 7 77 cats\nDON'T", "<|endoftext|> x", "x" * 5000, "a\tb c", "é ́a", "\n7\n7 7"]


@functools.cache
def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def whole(name, texts):
    t = library(name)
    return [x.ids + [1] for x in t.encode_batch(texts, add_special_tokens=False)]


def ids(e, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_those_of_the_library(name):
    assert ids(encoder(name), TEXTS) == whole(name, TEXTS)
    assert ids(encoder(name), [None]) == [[1]]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD), max_size=14), min_size=1, max_size=5))
def test_random_texts(name, texts):
    assert ids(encoder(name), texts) == whole(name, texts)


def test_a_full_cache_changes_nothing():
    e = PieceEncoder(public_tokenizers.path(NAMES[0]), True, kept=3)
    for _ in range(2):
        assert ids(e, ["one two three four\nfive six"]) == whole(NAMES[0], ["one two three four\nfive six"])
