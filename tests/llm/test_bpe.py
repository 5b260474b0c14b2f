"""Tokens of every code point and of very long runs, against the tokenizers library."""

import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from factloom.llm import tokens, word_bpe
from factloom.llm.queries import tokenizer_path


def encoders(name):
    path = tokenizer_path(name)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    mine = tokens.ByteBpe(path).ids if name.startswith("byte") else word_bpe.WordBpe(path).encode
    ids = lambda x: (np.frombuffer(x, "<u4") if isinstance(x, bytes) else x).tolist()
    return library, lambda texts: list(map(ids, mine(texts)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point(name):
    library, mine = encoders(name)
    texts = [f"a{chr(c)}b {chr(c)}1 '{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 61 == 0)]
    for i in range(0, len(texts), 20_000):
        some = texts[i : i + 20_000]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        bad = [t for t, a, b in zip(some, mine(some), want, strict=True) if a != b]
        assert not bad, (len(bad), [hex(ord(t[1])) for t in bad[:9]])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_runs(name):
    library, mine = encoders(name)
    rng = np.random.default_rng(2)
    texts = ["x" * n for n in (199, 200, 201, 3001)] + ["".join(rng.choice(list("abcetnxaé"), n)) for n in (201, 500, 5000)] + ["=-" * 700]
    assert mine(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    began = time.perf_counter()
    mine(["x" * 1_000_000])
    assert time.perf_counter() - began < 60
