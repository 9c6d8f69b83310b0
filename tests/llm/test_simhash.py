import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqforge.llm import simhash
from tests.llm.fixtures import collected, docs, rows, table_dir


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_query_equals_brute_force(spark, scratch):
    data = rows()
    got = collected(simhash.op1_simhash_dedup(spark, table_dir(scratch, documents=docs(spark, data))), "doc_id", "fingerprint", "component_id")
    prints = [brute_print(t) for _, t, _, _ in data]
    label = brute_classes(prints)
    ids = {}
    for k, (i, *_rest) in zip(label, data, strict=True):
        ids.setdefault(k, []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    want = [(i, format(p, "016x"), least[k]) for (i, *_r), p, k in zip(data, prints, label, strict=True)]
    assert got == sorted(want, key=repr)


def test_jvm_hash_is_the_standard_one(spark):
    text = "Ünï çode abc"
    h = spark.sql(f"SELECT xxhash64('{text}') AS h").first()["h"]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = np.concatenate([base] + [base ^ sum(np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64) for _ in range(k)) for k in range(1, 7)])
    n = len(fp)
    a, b = simhash.compare(fp, np.arange(n) + 1, np.full(n, n), radius)
    want = {(i, j) for i, j in combinations(range(n), 2) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_hot_key_in_tiles_keeps_every_link(spark):
    rng = random.Random(3)
    prints = list({rng.getrandbits(64) & 0xFFFF | 0xABCD << 48 for _ in range(700)})
    reps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    comp = {r["node"]: r["root"] for r in simhash.components(simhash.links(reps, 3, tile=64)).collect()}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    label = brute_classes([s % (1 << 64) for s in signed])
    assert [comp.get(s, s) for s in signed] == [signed[k] for k in label]


def test_components_of_long_chains(spark):
    n = 300
    edges = [(i + 1, i) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 50)] + [(2000, 2001), (2001, 2002), (2002, 2000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, **{1000 + i: 1000 for i in range(1, 50)}, 2001: 2000, 2002: 2000}


def test_empty_table(spark, scratch):
    out = simhash.op1_simhash_dedup(spark, table_dir(scratch, documents=docs(spark, [])))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_whole_text_counts(spark):
    text = " ".join(f"w{i}" for i in range(70000))
    assert simhash.simhash(text) == brute_print(text)
    assert F is not None
