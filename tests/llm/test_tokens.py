"""The encoder's ids are those of the tokenizer on whole texts, and its calls stay small."""
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seqforge.llm import tokens
from seqforge.llm.common import chunks

BITS = ["a", "b", "it", "'s", "'re", " ", "  ", "\n", "\n\n", "\t", "\r\n", "-", "--", "'", "1", "22", ".", " the", "don't", "! ", " \n "]
RARE = ["é", "日", "\x0b", "\xa0", "<|endoftext|>", "<|", "\x01", " "]
FILES = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))


class Spy:
    def __init__(self, tokenizer):
        self.tokenizer, self.most = tokenizer, 0

    def encode_batch_fast(self, texts, **kw):
        self.most = max(self.most, sum(map(len, texts)))
        return self.tokenizer.encode_batch_fast(texts, **kw)


@pytest.mark.parametrize("name,spaced", FILES)
def test_ids_are_those_of_whole_texts(name, spaced):
    path, rng = public_tokenizers.path(name), random.Random(3)
    enc, whole = tokens.Encoder(path, spaced), Tokenizer.from_file(path)
    for bits in (BITS, BITS + RARE):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, ""]
        want = [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(pa.array(texts))] == want


@pytest.mark.parametrize("rare", ["", "\x0b"])
def test_texts_full_of_blank_lines_take_small_calls(rare):
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    words = [f"w{i}" for i in range(2000)] + ["the", "nation"] * 200
    texts = ["\n\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(40)) + rare for _ in range(1024)]
    enc = tokens.Encoder(path, True)
    enc.tokenizer = spy = Spy(enc.tokenizer)
    got = enc.encode(pa.array(texts))
    assert spy.most <= max(tokens.CALL, sum(map(len, set(words))) * 12)     # new pieces are few; parts go call by call
    whole = Tokenizer.from_file(path)
    for i in (0, 511, 1023):
        assert np.frombuffer(got[i], "<u4").tolist() == whole.encode(texts[i], add_special_tokens=False).ids


def test_batches_are_cut_by_bytes():
    texts = ["x" * n for n in (10, 4000, 10, 10, 9000, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [c.column("text").to_pylist() for c in chunks([batch, batch.slice(1, 3)], 1024, 4020)]
    assert got == [texts[:3], texts[3:4], texts[4:5], texts[5:], texts[1:4]]
