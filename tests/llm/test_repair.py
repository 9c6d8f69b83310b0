import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqforge.llm import repair
from seqforge.llm.tokens import Encoder
from tests.llm.fixtures import collected, docs, rows, table_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain(path, text):
    return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4")


TRICKY = ["", " ", "a", "  a  b ", "it's  they'll\n\n x", "tab\tsep\r\nline ", "naïve café  Straße", "x  y  z", "!\x1c!", "a\x1cb",
          "<|endoftext|> end<|startoftext|>", "́ combining", "ǅ Σ ς", "日本語 テスト", "1234 5,678.9", "  \n  leading", "trailing  \n ", "a​b ﻿c", "x\x85y z"]


def test_pieces_encode_like_whole_texts():
    rng = random.Random(0)
    alphabet = "ab c\n\t'.1é   "
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["It's Ok. e.g., a.b.c. (end.) x.) .y , z .", "Ünder ÉTÉ. é.a ß, 1.2 a1. b2,c", "<|ENDOFTEXT|> <|endoftext|>.", "a.\nB,\nC d.\ne", "x.<|endoftext|>"]
    for path, spaced in ((WORDS, False), (BYTES, True)):
        enc, whole = Encoder(path, spaced), Tokenizer.from_file(path)
        want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        for got in (enc.encode(pa.array([*texts, None])), [enc.encode(pa.array([t]))[0] for t in [*texts, None]]):
            for t, g, w in zip([*texts, ""], got, [*want, b""], strict=True):
                assert g == w, repr(t)


def test_memo_starts_anew(monkeypatch):
    from seqforge.llm import tokens
    monkeypatch.setattr(tokens, "MEMO", 50)
    enc, whole = Encoder(BYTES, True), Tokenizer.from_file(BYTES)
    for k in range(5):
        t = [" ".join(f"w{k}x{j}" for j in range(i, i + 30)) for i in range(3)]
        assert enc.encode(pa.array(t)) == [np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in t]


def test_shards_are_smaller_than_16_bit_ids_and_documents_read_their_own_rules():
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).combine_chunks()
    blobs = [b + np.array([1], "<u4").tobytes() for b in Encoder(WORDS, False).encode(texts)]
    blob = repair.pack(list(range(len(blobs))), blobs)
    assert len(blob) <= 0.8 * sum(map(len, blobs)) / 2
    s = repair.Shard(blob)
    for k in (0, 17, 400):
        before = s.rules_read
        assert s.document(k).tobytes() == blobs[k]
        assert s.rules_read - before <= len(blobs[k]) // 4
    assert s._whole is None and s._pool is None       # nothing else was unpacked
    assert s.expand(s.symbols).astype("<u4").tobytes() == b"".join(blobs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), min_size=1, max_size=8))
def test_round_trip_and_random_access(docs_):
    blobs = [np.array(d + [1], "<u4").tobytes() for d in docs_]
    s = repair.Shard(repair.pack(list(range(len(docs_))), blobs, min_pair=2))
    ids = np.concatenate([np.frombuffer(b, "<u4") for b in blobs])
    assert s.expand(s.symbols).tolist() == ids.tolist()
    for k, b in enumerate(blobs):
        assert s.document(k).tobytes() == b
    for a in range(0, len(ids), 3):
        for b in range(a + 1, len(ids) + 1, 4):
            assert s.span(a, b).tolist() == ids[a:b].tolist()


def test_frequent_pairs_are_replaced_until_none_is_left():
    ids = np.array(([5, 6, 7, 8] * 500) + [1], "<u4")
    symbols, _, rules, lengths = repair.compress(ids, np.array([0]))
    assert len(symbols) + 2 * len(rules) < 60 and lengths.max() >= 4
    pairs, n = np.unique(np.stack([symbols[:-1], symbols[1:]], 1), axis=0, return_counts=True)
    assert n.max() < repair.MIN_PAIR


def test_pairs_of_forty_occurrences_are_replaced_after_more_frequent_ones():
    rng = np.random.default_rng(4)
    filler = iter(rng.permutation(np.arange(100, 30_000)).tolist())
    ids = np.array([x for n, pair in ((3000, (7, 8)), (40, (9, 10))) for _ in range(n) for x in (*pair, next(filler))], "<u4")
    symbols, _, rules, _ = repair.compress(ids, np.array([0]))
    assert rules.tolist() == [[7, 8], [9, 10]] and len(symbols) == len(ids) - 3040


def test_query_equals_plain_encoding(spark, scratch):
    data = rows()
    got = collected(repair.op3_token_ids(spark, table_dir(scratch, documents=docs(spark, data))), "start", "doc_id", "n_tokens", "ids_crc32")
    assert len(got) == len(data)
    at = 0
    left = {}
    for i, t, *_ in data:
        ids = np.append(plain(WORDS, t or ""), np.uint32(1)).astype("<u4")
        left.setdefault((i, len(ids), zlib.crc32(ids.tobytes())), []).append(1)
    order = sorted(got)
    assert [r[1] for r in order] == sorted((r[1] for r in order), key=lambda i: (i is not None, i or 0))
    for start, i, n, crc in order:
        assert start == at
        left[i, n, crc].pop()
        at += n
    assert not any(left.values())


def test_many_shards_and_parts(spark):
    d = docs(spark, [(i, f"alpha beta gamma {i} " * 30, "en", "s") for i in range(200)])
    shards = repair.write(d.repartition(5), WORDS, shard=2000)
    assert shards.count() > 8 and shards.agg({"n_ids": "max"}).first()[0] <= 2000
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in repair.read(shards).collect())
    assert [g[1] for g in got] == list(range(200))
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got[:-1]]).tolist()


def test_empty_table(spark, scratch):
    assert repair.op3_token_ids(spark, table_dir(scratch, documents=docs(spark, []))).count() == 0
