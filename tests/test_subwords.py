"""Subword training equals a trainer that merges one pair at a time; encoding equals merging every text by itself."""
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqforge.operators import subwords, tokens

PIECE = re.compile(tokens.TOKEN_RE)


def plain_train(texts, merges, least=2):
    words = Counter(w for t in texts for w in PIECE.findall(t or ""))
    split = {w: list(w) for w in words}
    age = {s: i for i, s in enumerate(sorted({c for w in words for c in w}, key=lambda c: c.encode()))}
    out = []
    while len(out) < merges:
        count = Counter()
        for w, s in split.items():
            for a, b in zip(s, s[1:]):
                count[a, b] += words[w]
        count = {p: n for p, n in count.items() if n >= least}
        if not count:
            break
        a, b = min(count, key=lambda p: (-count[p], max(age[p[0]], age[p[1]]), age[p[0]], age[p[1]]))
        out.append((a, b, count[a, b]))
        age.setdefault(a + b, len(age))
        for w, s in split.items():
            split[w] = apply(s, a, b)
    return out


def apply(s, a, b):
    got, i = [], 0
    while i < len(s):
        if i + 1 < len(s) and (s[i], s[i + 1]) == (a, b):
            got.append(a + b)
            i += 2
        else:
            got.append(s[i])
            i += 1
    return got


def given(seed):
    rng = random.Random(seed)
    syllables = ["an", "ba", "nana", "the", "er", "ing", "aa", "aaa", "x1", "_"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", "<", ">", "!?", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    return [*texts, None, "", " \n", "aaaaaaa " * 300]


@pytest.mark.parametrize("seed", [1, 2])
def test_training_and_encoding_equal_plain_ones(spark, seed):
    texts = given(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    words = subwords.distinct_words(df)
    merges = subwords.train(words, 40)
    assert merges == plain_train(texts, 40)
    vocab = subwords.subword_vocab(words, merges)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert len(set(ids.values())) == len(ids) and min(ids.values()) == len(tokens.SPECIALS)
    got = {r["id"]: r["ids"] for r in subwords.encode_texts(df, "text", subwords.encode_words(words, merges, vocab), "id").collect()}
    for i, t in enumerate(texts):
        want = []
        for w in PIECE.findall(t or ""):
            s = list(w)
            for a, b, _ in merges:
                s = apply(s, a, b)
            want += [ids[x] for x in s]
        assert got[i] == want


def test_unknown_words_and_letters(spark):
    df = spark.createDataFrame([(1, "ab ab ab"), (2, "zz ab")], "id int, text string")
    words = subwords.distinct_words(df.where("id = 1"))
    merges = subwords.train(words, 5)
    assert merges == [("a", "b", 3)]
    vocab = subwords.subword_vocab(words, merges)
    every = subwords.distinct_words(df)
    got = {r["id"]: r["ids"] for r in subwords.encode_texts(df, "text", subwords.encode_words(every, merges, vocab), "id").collect()}
    assert got[1] == [6, 6, 6] and got[2] == [tokens.UNK_ID, tokens.UNK_ID, 6]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    words = subwords.distinct_words(df)
    assert subwords.train(words, 5) == [] and subwords.encode_texts(df, "text", subwords.encode_words(words, [], subwords.subword_vocab(words, [])), "id").isEmpty()


def test_builders_take_any_tokenizer(spark):
    """The row builders with subwords, and with a tokenizer function that does the same, give equal rows."""
    from seqforge.operators import examples
    from tests.test_sequences import _frames
    rules, seqs = _frames(spark)
    texts = examples.conversation_texts(seqs, rules)
    lines = examples.valid_lines(seqs, rules)
    single = examples.single_move_texts(lines)
    corpus = texts.select("text").unionByName(single.select(F.col("ptext").alias("text"))).unionByName(single.select(F.col("response").alias("text")))
    words = subwords.distinct_words(corpus)
    merges = subwords.train(words, 30)
    vocab = subwords.subword_vocab(words, merges)
    encoded = subwords.encode_words(words, merges, vocab)
    ids = {r["word"]: r["ids"] for r in encoded.collect()}
    plain = lambda batch: [[i for w in PIECE.findall(t) for i in ids[w]] for t in batch]
    marker = F.array(*[F.lit(i) for i in ids["uci_move"]])
    for build, rows, extra in ((examples.conversation_rows, texts, (marker, 96)), (examples.single_move_rows, single, (64,))):
        a = sorted(tuple(r) for r in build(rows, encoded, *extra, encode=subwords.encode_many).collect())
        b = sorted(tuple(r) for r in build(rows, plain, *extra, encode=tokens.encode_many_with).collect())
        assert a == b and len(a) >= 2 and all(len(r[1]) == extra[-1] for r in a)
        assert any(x != -100 for r in a for x in r[3])
