"""Ids by pieces against the library, for the tokenizer whose steps are repeated and for others."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from veldspan.llm.encode import Encoder
from veldspan.llm.queries import vocabulary

TEXTS = ["", "Hello, World's 3rd  test!\n\nnew line", "ÀÉÎ ß straße", "İstanbul ﬁne Ω x́", "<|endoftext|> tail", "don't we'LL", "a" * 5000 + " " + "9 " * 3000, "日本語 テキスト"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_ids_as_the_library(name):
    enc, library = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    assert enc.known == (name == "word_bpe_49k.json")
    for text, ids in zip(TEXTS, enc.encode([t.encode() for t in TEXTS]), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]
