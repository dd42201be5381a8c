"""Pieces reach the tokenizers library joined, with the ids of whole texts; wide white space found by numpy."""

import random
import re

import numpy as np
import pytest

from piisieve.llm.textops import Chunk, chunks
from piisieve.llm.tokens import PieceTokenizer, tokenizer_path, wide_places

FILES = {"word_bpe_49k.json": False, "byte_bpe_50k.json": True}
BITS = ["can't", "it's'll", "A", "Stra\u00dfe", "\u03a3\u0391\u03a3", "\u00e9te\u0301", "\u0301x", "###", "a#1b22", "12345", "\x01", "x\x01",
        "\x01\x01#", "don\x01t", "<|endoftext|>", "<|startoftext|>x", "\u00a0", "a\u00a0b", "\u3000", "x\u2003", "\u200b", "\ufeff",
        "\x1c", "\u65e5\u672c\u8a9e", "\U0001f600", "\u0085", "\x00", "\u212b", "\u0130", "\u01c5", "''", "'s", "\u1680", "\u180e", "\u2028",
        "\u00c2", "\u2090"]
GAPS = [" ", "  ", "\n", "\n\n ", "\t", " \n", "\r\n", "\x0b", "\x0c "]


def make(rng):
    text = "".join(rng.choice(GAPS) + rng.choice(BITS) + (rng.choice(BITS) if rng.random() < 0.3 else "")
                   for _ in range(rng.randrange(12)))
    return (text if rng.random() < 0.5 else text.lstrip(" \n\t\r\x0b\x0c")) + (rng.choice(GAPS) if rng.random() < 0.4 else "")


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_whole_texts(name):
    import pyarrow as pa
    rng = random.Random(3)
    texts = [make(rng) for _ in range(600)] + ["", " ", "\n", None]
    tokenizer = PieceTokenizer(tokenizer_path(name), FILES[name])
    plain = PieceTokenizer(tokenizer_path(name), FILES[name]).model
    for limit in (1 << 19, 200):
        i = 0
        for chunk in chunks(pa.array(texts, pa.string()), limit):
            ids, bounds = tokenizer.encode(chunk, 7)
            for a, b in zip(bounds[:-1], bounds[1:]):
                assert ids[a:b].tolist() == plain.encode(texts[i] or "", add_special_tokens=False).ids + [7], texts[i]
                i += 1
        assert i == len(texts)
        tokenizer.clear()


@pytest.mark.parametrize("name", FILES)
def test_few_texts_reach_the_library(name):
    tokenizer = PieceTokenizer(tokenizer_path(name), FILES[name])
    sent = []

    class Counted:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return self.model.encode_batch_fast(texts, **options)
    tokenizer.model = Counted(tokenizer.model)
    words = [f"w{i}x" for i in range(3000)]
    ids, bounds = tokenizer.encode(Chunk([" ".join(words).encode()], 0), 7)
    assert len(sent) < 10
    assert ids[:-1].tolist() == tokenizer.model.model.encode(" ".join(words), add_special_tokens=False).ids


def test_wide_white_space():
    old = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]"
                     rb"|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf|[\x1c-\x1f]")
    rng = random.Random(9)
    raw = "".join(chr(c) for c in range(0x20000) if not 0xd800 <= c < 0xe000).encode() + b"\n"
    odd = "".join(rng.choice(BITS) for _ in range(2000)).encode() + "\u2028".encode()
    for x in (raw, odd, b"plain\n", b"\xe2"):
        assert wide_places(np.frombuffer(x, np.uint8)).tolist() == [m.start() for m in old.finditer(x)]
