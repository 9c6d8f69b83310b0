"""T2-T8 goldens against plain-Python versions of the array rules."""
import pytest
from pyspark.sql import functions as F

from seqforge.operators import tokens as T


def py_truncate(p, r, L):
    if len(p) + len(r) > L:
        keep = L - len(r)
        if keep < 0:
            return [], r[:L]
        return p[:keep], r
    return p, r


def py_find(seq, sub):
    return [i for i in range(len(seq) - len(sub) + 1) if seq[i:i + len(sub)] == sub]


def py_spans(seq, marker):
    occ = py_find(seq, marker)
    pos = set()
    for i in range(0, len(occ) - 1, 2):
        for q in range(occ[i] - 1, occ[i + 1] + len(marker) + 1):
            if 0 <= q < len(seq):
                pos.add(q)
    return [x if i in pos else -100 for i, x in enumerate(seq)]


CASES = [([1, 2, 3], [4, 5], 5), ([1, 2, 3], [4, 5], 6), ([1, 2, 3], [4, 5], 4), ([1], [4, 5, 6, 7], 3),
         ([], [9], 2), ([1, 2], [3, 4], 2)]


def test_truncate_pad_labels(spark):
    df = spark.createDataFrame([(i, p, r) for i, (p, r, _) in enumerate(CASES)], "i int, p array<int>, r array<int>")
    for i, (p, r, L) in enumerate(CASES):
        for pad in (0, 5):   # pad different from and equal to an id in the response
            row = df.where(F.col("i") == i).select(T.truncate_reserve("p", "r", L).alias("t")).select("t.*").first()
            tp, tr = py_truncate(p, r, L)
            assert (row["prompt_ids"], row["response_ids"]) == (tp, tr)
            ids = tp + tr + [pad] * (L - len(tp) - len(tr))
            mask = [1] * (len(tp) + len(tr)) + [0] * (L - len(tp) - len(tr))
            x = spark.createDataFrame([(tp, tr)], "p array<int>, r array<int>")
            pm = T.pad_mask(F.concat("p", "r"), L, pad)
            got = x.select(pm.alias("m")).select("m.*").first()
            assert got["input_ids"] == ids and got["attention_mask"] == mask and len(ids) == L
            lab = x.select(T.label_response(pm["input_ids"], F.size("p"), F.size("r"), pad).alias("l")).first()["l"]
            want = [-100] * L
            for q in range(len(tp), len(tp) + len(tr)):
                if 0 <= q < L and ids[q] != pad:
                    want[q] = ids[q]
            assert lab == want


SEQS = [[7, 1, 7, 1, 7], [1, 2], [7], [], [7, 7, 7, 7], [3, 7, 9, 7, 2, 7], [7, 5, 5, 5, 7]]


@pytest.mark.parametrize("marker", [[7], [7, 7], [1, 7]])
def test_find_and_spans(spark, marker):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "i int, s array<int>")
    rows = {r["i"]: r for r in df.select("i", T.find_subsequence("s", marker).alias("f"),
                                         T.label_spans("s", marker).alias("l")).collect()}
    for i, s in enumerate(SEQS):
        assert rows[i]["f"] == py_find(s, marker)
        assert rows[i]["l"] == py_spans(s, marker)


def test_pack_and_placeholder(spark):
    df = spark.createDataFrame([([1, 2, 3],), (list(range(10)),)], "s array<int>")
    got = [r["p"] for r in df.select(T.pack_fixed("s", 4).alias("p")).collect()]
    assert got[0]["input_ids"] == [1, 2, 3, 0] and got[0]["attention_mask"] == [1, 1, 1, 0]
    assert got[1]["input_ids"] == [0, 1, 2, 3]
    ph = spark.range(1).select(T.placeholder(3).alias("p")).first()["p"]
    assert ph["input_ids"] == [0, 0, 0] and ph["attention_mask"] == [0, 0, 0] and ph["labels"] == [-100] * 3


def test_vocab_dense_and_encode(spark):
    texts = spark.createDataFrame([(1, "b a a <x>"), (2, "a c"), (3, "")], "k int, text string")
    v = T.build_vocab(texts)
    got = {r["token"]: r["id"] for r in v.collect()}
    assert got["a"] == 4 and sorted(got.values()) == list(range(4, 4 + len(got)))
    e = {r["k"]: r["ids"] for r in T.encode(texts, "text", v, "k").collect()}
    assert e[1][1:3] == [4, 4] and e[3] == []
    assert T.encode(spark.createDataFrame([(9, "zzz a")], "k int, text string"), "text", v, "k").first()["ids"] == [1, 4]


def test_dense_index_many_partitions(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7 % 5000).alias("v"))
    out = T.dense_index(df, [F.col("v").desc()], start=0, out="rk").collect()
    assert sorted((r["rk"], r["v"]) for r in out) == [(i, 4999 - i) for i in range(5000)]


def test_plug_in_tokenizer(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["ids"] for r in df.select("id", T.encode_with("text", lambda xs: [[len(w) for w in x.split()] for x in xs]).alias("ids")).collect()}
    assert got == {1: [2, 1], 2: [], 3: []}


def test_reward_registry_and_weights(spark):
    from seqforge.functions import rewards as R
    df = spark.createDataFrame([("<rationale>Go. </rationale><uci_move>a</uci_move>", ["a"], "a", 50, 50)],
                               "completion string, legal_moves array<string>, correct_move string, cp_pred int, cp_ref int")
    made = df.select(*[fn("completion", *cols).alias(name) for name, (cols, fn) in R.REGISTRY.items()], R.scaled(F.lit(2), 1.5, "legality")).first()
    assert made["legality"] == 1.0 and made["correctness"] == 3.0 and made["legality_x1_5"] == 3.0 and made["stockfish_eval"] == 3.0


def test_many_markers_in_one_pass(spark):
    import random
    rng = random.Random(3)
    markers = [[1], [1, 2], [2, 1, 1], [9, 9], [3]]
    seqs = [[rng.randint(1, 3) for _ in range(rng.randint(0, 40))] for _ in range(60)] + [[], [9, 9, 9]]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, s array<int>")
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in df.select("i", T.find_many("s", markers).alias("m")).collect()}
    one = {r["i"]: r for r in df.select("i", *[T.find_subsequence("s", m).alias(f"m{k}") for k, m in enumerate(markers)]).collect()}
    for i, s in enumerate(seqs):
        want = sorted((p, k) for k, m in enumerate(markers) for p in range(len(s) - len(m) + 1) if s[p:p + len(m)] == m)
        assert got[i] == [(k, p) for p, k in want]
        assert [(p, k) for k in range(len(markers)) for p in one[i][f"m{k}"]] == sorted(want, key=lambda x: (x[1], x[0]))
