"""Operator 11 against a plain recount with both libraries."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seqforge.llm import alignment
from seqforge.llm.counts import byte_letters
from tests.llm.fixtures import docs, rows, table_dir

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["日本 é 🙂🙂 x", " two  blanks\t\n\n", "<|endoftext|> is plain", "<s> </s> <unk>", "holds ▁ itself", "a" * 3000, "🙂" * 400, "\x00\x01", "ab́c", " ", "\n", "ﬁ ½ ①", "a\x01 b  c", "x " * 900, "end \x01 "]


def brute(data):
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    byte = {c: b for b, c in byte_letters().items()}
    found = []
    for doc, text, *_ in data:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(byte[c] for c in ta.id_to_token(i))) for i in ta.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()) for i in tb.encode(text or "")]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append((doc, 0, 0, [], ""))
            continue
        groups, i, j, ea, eb = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if ea <= eb:
                groups[-1][0].append(a[i][0])
                ea += len(a[i][1])
                i += 1
            else:
                groups[-1][1].append(b[j][0])
                eb += len(b[j][1])
                j += 1
            if ea == eb:
                groups.append(([], []))
        groups.pop()
        told = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        found.append((doc, len(a), len(b), groups, hashlib.sha256(told.encode()).hexdigest()))
    links = [Counter((x, y) for ga, gb in f[3] for x in ga for y in gb) for f in found]
    count = Counter(p for each in links for p in each)
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(f[0], f[1], f[2], len(f[3]), each.total(), sum(n for p, n in each.items() if count[p] == most[p[0]]),
             sum(n * count[p] for p, n in each.items()), f[4]) for f, each in zip(found, links, strict=True)]


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_query_equals_recount(spark, scratch):
    data = [*rows(), *[(400 + k, t, "en", "s0") for k, t in enumerate(ODD)], (500, ODD[0], "en", "s0")]
    got = result(alignment.op11_token_alignment(spark, table_dir(scratch, documents=docs(spark, data).repartition(3))))
    assert got == sorted(brute(data), key=repr)
    assert sum(g[1] == 0 for g in got) >= 4


def test_many_blocks(spark):
    rng = random.Random(4)
    words = ["nation", "housing", "é", "x1", "don't", "\n", "日本", "the", "a", "ountr"]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(120)]
    held = alignment.blocks(docs(spark, [(i, t, "en", "s") for i, t in data]), A, B, 2000)
    assert held.count() > 20
    assert result(alignment.document_sums(held, alignment.pair_counts(held))) == sorted(brute(data), key=repr)


@pytest.mark.parametrize("text", ODD)
def test_bytes_are_rebuilt_or_nothing(text):
    both = alignment.pair(A, B)
    columns, link = alignment.align(pa.array([text, "plain words", text], pa.large_string()), both)
    want = brute([(0, text), (1, "plain words"), (2, text)])
    assert [*columns["n_groups"]] == [w[3] for w in want] and columns["hashes"] == [w[7] for w in want]
    assert sum(link.column("n").to_pylist()) == sum(w[4] for w in want)


def test_empty_table(spark, scratch):
    df = alignment.op11_token_alignment(spark, table_dir(scratch, documents=docs(spark, [])))
    assert df.columns == NAMES and df.count() == 0


def test_cuts_come_from_one_search():
    """The cuts and places are those of an inner join, repeated keys included."""
    rng = np.random.default_rng(3)
    for repeat in (False, True):
        for n in (0, 1, 40, 300):
            a, b = (np.sort(rng.choice(400, n, repeat).astype(np.int64)) for _ in range(2))
            cuts, at_a, at_b = alignment.common_ends(a, b)
            joined = sorted(x for x in a.tolist() for y in b.tolist() if x == y)
            assert cuts.tolist() == joined
            assert at_a.tolist() == np.searchsorted(joined, a).tolist() and at_b.tolist() == np.searchsorted(joined, b).tolist()
    assert [x.tolist() for x in alignment.common_ends(np.array([1, 2]), np.zeros(0, np.int64))] == [[], [0, 0], []]
