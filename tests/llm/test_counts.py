"""Operator 12: the compiled counts are the library's, whatever the chunks, slabs and number of kept states."""
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seqforge.llm import counts
from tests.llm.fixtures import docs, rows, table_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "it", "'s", "'re", "'ve", "'l", "'ll", "'", "'S", " ", "  ", "\n", "\n\n", "\t", "\r\n", "-", "--", "1", "22", "é", "日", "本", "\x0b",
        "\xa0", "<|endoftext|>", "<|", ".", "the", " the", "don't", "! ", " \n ", "🙂", "　", "x" * 20, "ſ", "\x00"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("chunk,slab,states", [(256, 1 << 22, 300_000), (7, 64, 300_000), (16, 37, 50)])
def test_awkward_texts(library, chunk, slab, states):
    count = counts.Transducers(PATH, states, slab, chunk)
    for seed in range(4):
        x = texts(150, seed)
        assert count(pa.array(x)).tolist() == library(x)
        assert count(pa.array([*x, *x]).slice(100, 120)).tolist() == library([*x, *x][100:220])


def test_pieces_longer_than_chunks(library):
    rng = random.Random(2)
    x = ["x" * 20000, "ab" * 15000, "".join(rng.choice("abcdefghij") for _ in range(30000)), " " * 5000, "日本" * 4000, "1234567" * 3000]
    assert counts.Transducers(PATH)(pa.array(x)).tolist() == library(x)
    assert counts.Transducers(PATH, slab=1000, chunk=32)(pa.array(x)).tolist() == library(x)


def test_maps_compose_from_the_left():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 8, (37, 8)).astype(np.uint8)
    got, now = counts.scan_maps(maps), np.arange(8)
    for k in range(37):
        now = maps[k][now]
        assert got[k].tolist() == now.tolist()


def test_states_are_dropped_without_changing_a_count(library):
    count, x = counts.Transducers(PATH, states=200), texts(400, 9)
    for i in range(0, 400, 50):
        assert count(pa.array(x[i:i + 50])).tolist() == library(x[i:i + 50])
    assert len(count.counter.entries) < 20_000


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        counts.Transducers(public_tokenizers.path("word_bpe_49k.json"))


def test_query_on_awkward_rows(spark, scratch, library):
    data = [*rows(), (300, "a <|endoftext|> b", "en", "s0"), (301, "word " * 1020 + "x y z a", "en", "s0"), (302, "word " * 1023, "en", "s0")]
    got = counts.op12_token_counts(spark, table_dir(scratch, documents=docs(spark, data))).collect()
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t, *_), n in zip(data, library([t for _, t, *_ in data]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark, scratch):
    df = counts.op12_token_counts(spark, table_dir(scratch, documents=docs(spark, [])))
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and df.count() == 0
