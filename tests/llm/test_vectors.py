"""Operators 5 and 8 against brute force."""
import math

import numpy as np

from seqforge.llm import ann, topk
from seqforge.plans.check import compare, duck
from tests.llm.fixtures import table_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, row_id int, rank int, score string"


def given(n=700, d=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[50:60] = x[0]                                  # ties
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(800, None), (900, []), (1000, [0.0] * d), (1100, [math.nan] * d), (1200, [math.inf] + [1.0] * (d - 1)),
             (1300, [None] + [1.0] * (d - 1)), (None, x[3].tolist()), (1400, x[5].tolist()), (1400, x[6].tolist()), (1400, x[6].tolist()),
             (1500, [1.0, 2.0, 3.0]), (1501, [1.0, 2.0, 4.0]), (1600, [1.0])]
    return data


def frame(spark, data):
    return spark.createDataFrame([(i, v, None, None, None, None) for i, v in data], SCHEMA)


def usable(data, zeros):
    return [(k, i, [float(np.float32(c)) for c in v]) for k, (i, v) in enumerate(data)
            if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and (zeros or any(v))]


def brute(data, every, k, cost, zeros):
    rows = usable(data, zeros)
    out = []
    for qk, qi, q in rows:
        if qi % every == 0:
            found = sorted((cost(q, c), ci, ck) for ck, ci, c in rows if ck != qk and len(c) == len(q))[:k]
            out += [(qi, r + 1, ci, s) for r, (s, ci, _) in enumerate(found)]
    return sorted(out)


def distance(a, b):
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s += (x - y) * (x - y)
    return math.sqrt(s)


def minus_product(a, b):
    return -sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))


def result(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_neighbours_equal_brute_force(spark, scratch):
    got = result(ann.op5_nearest_neighbours(spark, table_dir(scratch, embeddings=frame(spark, given()).repartition(5))))
    assert got == brute(given(), 100, 10, distance, False)


def test_top_products_equal_brute_force(spark, scratch):
    got = result(topk.op8_top_inner_products(spark, table_dir(scratch, embeddings=frame(spark, given()).repartition(5))))
    assert got == [(q, r, v, -s) for q, r, v, s in brute(given(), 50, 5, minus_product, True)]


def test_sql_on_given_tables(spark):
    for name, fn, sql in (("op5", ann.op5_nearest_neighbours, ann.OP5_SQL), ("op8", topk.op8_top_inner_products, topk.OP8_SQL)):
        ok, message = compare(spark, duck(SF), SF, name, fn, sql)
        assert ok, message


def test_recall_and_pruning_on_many_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    d = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    index = ann.build_index(d)
    got = result(ann.search(index, index.where("vec_id % 200 = 0"), 10))
    x = x.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 6000, 200):
        dist = ((x - x[q]) ** 2).sum(axis=1)
        dist[q] = np.inf
        hit += len(set(np.argsort(dist)[:10].tolist()) & {r[2] for r in got if r[0] == q})
    assert hit >= 0.99 * 300


def test_queries_in_several_blocks(spark):
    data = given(300, 8, 3)
    index = ann.build_index(frame(spark, data))
    assert result(ann.search(index, index.where("vec_id % 10 = 0"), 3, query_block=7)) == brute(data, 10, 3, distance, False)


def test_large_integers_have_unlimited_precision(spark, scratch):
    data = [(i, [3e4 * (i % 7 - 3), 1.5, -2.0 * i]) for i in range(120)] + [(150, [3e38, 3e38, 3e38]), (151, [-3e38, 1.0, 0.0])]
    got = result(topk.op8_top_inner_products(spark, table_dir(scratch, embeddings=frame(spark, data))))
    clip = lambda s: min(max(s, topk.LONG[0] + 1), topk.LONG[1])
    want = brute(data, 50, 5, lambda a, b: -clip(-minus_product(a, b)), True)
    assert got == [(q, r, v, -s) for q, r, v, s in want]


def test_few_candidates_and_empty_tables(spark, scratch):
    two = table_dir(f"{scratch}/a", embeddings=frame(spark, [(100, [1.0, 0.0]), (1, [0.5, 0.5])]))
    assert result(ann.op5_nearest_neighbours(spark, two)) == [(100, 1, 1, math.sqrt(0.5))]
    assert result(topk.op8_top_inner_products(spark, two)) == [(100, 1, 1, 256 * 128)]
    none = table_dir(f"{scratch}/b", embeddings=frame(spark, []))
    assert ann.op5_nearest_neighbours(spark, none).count() == 0 and topk.op8_top_inner_products(spark, none).count() == 0


def test_adders_and_selection():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 50, (3, 200))
    maps = [[np.packbits(np.pad((v[i] >> j & 1).astype(np.uint8), (0, 56)), bitorder="little").view(np.uint64)[None, :] for j in range(6)] for i in range(3)]
    total = topk.add_slices((j, m) for row in maps for j, m in enumerate(row))
    bits = [np.unpackbits(t.view(np.uint8), axis=1, bitorder="little")[0, :200].astype(int) for t in total]
    s = sum(b << j for j, b in enumerate(bits))
    assert (s == v.sum(axis=0)).all()
    valid = np.packbits(np.pad(np.ones(200, np.uint8), (0, 56)), bitorder="little").view(np.uint64)[None, :]
    for k in (1, 5, 200):
        kth = topk.top(total, valid, np.array([k]))[0]
        assert kth == sorted(s, reverse=True)[k - 1]
        hit = np.unpackbits(topk.at_least(total, valid, [kth]).view(np.uint8), axis=1, bitorder="little")[0, :200]
        assert (hit == (s >= kth)).all()
