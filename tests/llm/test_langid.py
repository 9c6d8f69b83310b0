import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from seqforge.llm import langid
from tests.llm.fixtures import docs, rows, table_dir

SOUNDS = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["kra", "sch", "ung", "eit"], "cc": ["ção", "lhe", "nho", "que"]}


def invented(n=240, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(SOUNDS)[i % 3]
        text = " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        out.append((i, text, lang, "s"))
    return out


def test_held_out_accuracy_and_columns(spark, scratch):
    data = invented()
    got = langid.op2_language_id(spark, table_dir(scratch, documents=docs(spark, data))).toPandas().set_index("doc_id")
    truth = {i: la for i, _, la, _ in data}
    assert list(got["held_out"]) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]
    out = got[got["held_out"]]
    assert len(out) > 30 and (out["lang_pred"] == [truth[i] for i in out.index]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_edge_rows(spark, scratch):
    got = langid.op2_language_id(spark, table_dir(scratch, documents=docs(spark))).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" for i in (200, 201, 202, 203)) and by_id[204]["lang_pred"] != "und"


def test_no_labels_and_empty_table(spark, scratch):
    bare = [(1, "some text", None, "s"), (2, None, None, None)]
    got = langid.op2_language_id(spark, table_dir(f"{scratch}/a", documents=docs(spark, bare))).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.op2_language_id(spark, table_dir(f"{scratch}/b", documents=docs(spark, []))).count() == 0


def test_prediction_looks_at_text_only(spark):
    data = invented(90)
    model = langid.fit(docs(spark, data))
    a = langid.predict(docs(spark, data), model).select("lang_pred", "score").collect()
    b = langid.predict(docs(spark, [(None, t, "zz", "other") for _, t, _, _ in data]), model).select("lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_document_frequencies_cover_all_rows(spark):
    d = docs(spark, invented(50)).repartition(7)
    df, n = langid.document_frequencies(d)
    want = np.zeros(langid.BUCKETS, np.int64)
    for (t,) in d.select("text").collect():
        want[langid.counts(t)[0]] += 1
    assert n == 50 and (df == want).all()


def test_penalties_give_sparse_weights_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    m = langid.Ftrl(2)
    for _ in range(400):
        y = int(rng.integers(2))
        at = np.array([y, 2 + int(rng.integers(50))])
        m.learn(at, np.array([0.8, 0.6]), y)
    w = m.weights()
    assert (w[:2].argmax(axis=1) == [0, 1]).all() and (w[60:] == 0).all()
    logits = np.array([[4.0, 0.0]] * 100)
    y = np.array([0] * 80 + [1] * 20)
    t = langid.temperature(logits, y)
    assert abs(langid.softmax(logits / t)[0, 0] - 0.8) < 0.01


def test_sample_is_bounded(spark):
    d = docs(spark, invented(600))
    model = langid.fit(d, sample_per_lang=30)
    ok = langid.predict(d.select("doc_id", "text", "lang"), model, ("doc_id", "lang")).where(F.col("lang") == F.col("lang_pred")).count()
    assert ok > 560


def test_sample_is_widened_a_row_at_a_time(spark, monkeypatch):
    """The driver holds the sample in single precision and learns from rows of its own, not views of a widened copy."""
    seen = []
    learn = langid.Ftrl.learn
    monkeypatch.setattr(langid.Ftrl, "learn", lambda self, at, x, y: (seen.append((x.dtype, x.base is None)), learn(self, at, x, y))[1])
    langid.fit(docs(spark, invented()).select("text", "lang"), epochs=1)
    assert seen and all(kind == np.float64 and own for kind, own in seen)
