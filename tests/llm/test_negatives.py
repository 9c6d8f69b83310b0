"""Operator 13 against brute force and its SQL."""
import numpy as np
import pytest

from seqforge.llm import negatives
from seqforge.plans.check import compare, duck
from tests.llm.fixtures import table_dir
from tests.llm.test_vectors import given, minus_product, usable

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int, row_id int, rank int, score string, part int, block int"


def frame(spark, data):
    return spark.createDataFrame([(i, v, label, None, None, None, None, None) for i, v, label in data], SCHEMA)


def labelled(n=700, hot=0.3):
    rng = np.random.default_rng(1)
    out = []
    for k, (i, v) in enumerate(given(n)):
        v = None if v is None else [None if c is None else float(np.float32(c)) for c in v]
        out.append((i, v, None if k % 97 == 5 else 3 if rng.random() < hot else k % 10))
    return out


def brute(data):
    rows = [(k, i, v, (data[k][2] + 1) % 10 if i % 7 == 0 else data[k][2]) for k, i, v in usable([d[:2] for d in data], True) if data[k][2] is not None]
    out = []
    for ak, ai, a, al in rows:
        if ai % 50:
            continue
        scored = [(minus_product(a, c), ci, ck, cl) for ck, ci, c, cl in rows if ck != ak and len(c) == len(a)]
        for cost, pi, _, _ in sorted(s for s in scored if s[3] == al)[:5]:
            ps = -cost
            found = sorted(s for s in scored if s[3] != al and 50 * ps <= -100 * s[0] <= 95 * ps)[:3]
            out += [(ai, pi, r + 1, ni, ps, -c) for r, (c, ni, _, _) in enumerate(found)]
    return sorted(out)


def result(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def test_query_equals_brute_force(spark, scratch):
    data = labelled()
    got = result(negatives.op13_hard_negatives(spark, table_dir(scratch, embeddings=frame(spark, data).repartition(5))))
    assert got == brute(data) and len(got) > 50


def test_many_cells_and_small_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "CELLS_A_CORE", 9)
    data = labelled(400)
    got = result(negatives.op13_hard_negatives(spark, table_dir(scratch, embeddings=frame(spark, data).repartition(7))))
    assert got == brute(data)


def test_integers_of_any_size(spark, scratch):
    rng = np.random.default_rng(3)
    data = [(i, (rng.standard_normal(5) * 10.0 ** (i % 7)).astype(np.float32).tolist(), i % 3) for i in range(260)]
    got = result(negatives.op13_hard_negatives(spark, table_dir(scratch, embeddings=frame(spark, data))))
    assert got == brute(data) and got


def test_ties_go_to_the_smaller_id(spark, scratch):
    data = [(i, [1.0, 0.0], 1) for i in range(50, 58)] + [(i, [0.75, 0.5], 2) for i in range(200, 220)]
    got = result(negatives.op13_hard_negatives(spark, table_dir(scratch, embeddings=frame(spark, data))))
    assert [g[:4] for g in got if g[0] == 50] == [(50, p, r + 1, n) for p in (51, 52, 53, 54, 55) for r, n in enumerate((200, 201, 202))]


@pytest.mark.parametrize("scale", [1, 300, 2.0 ** 45, 2.0 ** 200])
def test_scores_are_exact(scale):
    rng = np.random.default_rng(0)
    x = negatives.quantised(rng.standard_normal((50, 13)) * scale)
    q = negatives.quantised(rng.standard_normal((9, 13)) * scale)
    kind = object if scale > 300 else np.int64
    got = negatives.scores(negatives.subset_sums(q.astype(kind)), negatives.bit_planes(x))
    assert (got == x.astype(object) @ q.astype(object).T).all()


def test_sql_equals_query(spark):
    ok, msg = compare(spark, duck(SF), SF, "op13_hard_negatives", negatives.op13_hard_negatives, negatives.OP13_SQL)
    assert ok, msg


def test_empty_table(spark, scratch):
    df = negatives.op13_hard_negatives(spark, table_dir(scratch, embeddings=frame(spark, [])))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and df.count() == 0
