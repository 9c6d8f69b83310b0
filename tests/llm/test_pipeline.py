"""Every stage of the pipeline on awkward rows, against brute force where the stage decides."""
import re
import zlib

import corpus_pipeline as pipeline
from seqforge.llm import mixing, packing, simhash
from tests.llm.fixtures import docs, rows, table_dir
from tests.llm.test_langid import invented
from tests.llm.test_packing import checked, encoded
from tests.llm.test_simhash import brute_classes, brute_print

SECRET = "password=abcdefghijklmnop"


def given():
    data = invented(120) + [(1000 + i, *r[1:]) for i, r in enumerate(rows())]
    return data + [(5000, f"ba lo mi {SECRET} tu", "aa", "s"), (None, "ba lo mi tu lo lo", "aa", "s")]


def as_rows(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=repr)


def test_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "mix_sources", "packing"]


def test_language_keeps_clean_documents(spark):
    d = docs(spark, given())
    got = pipeline.language(spark, d, "")
    assert got.columns == pipeline.COLUMNS
    kept = as_rows(got)
    texts = {t for _, t, *_ in kept}
    assert all(t in texts for _, t, *_ in invented(120)) and SECRET in " ".join(texts)
    assert all(re.search("[a-z]", t) for t in texts) and all(la is not None for _, _, la, *_ in kept)


def test_one_document_of_each_class_stays(spark):
    data = given()
    got = as_rows(pipeline.near_duplicates(spark, docs(spark, data), ""))
    label = brute_classes([brute_print(t) for _, t, *_ in data])
    classes = {}
    for k, (i, t, *_) in zip(label, data, strict=True):
        classes.setdefault(k, []).append((i is None, i or 0, t))
    assert len(got) == len(classes)
    assert sorted((i is None, i or 0) for i, *_ in got) == sorted(min(c[:2] for c in v) for v in classes.values())


def test_secrets_are_masked_and_all_documents_stay(spark):
    data = given()
    got = as_rows(pipeline.secret_scan(spark, docs(spark, data), ""))
    assert len(got) == len(data) and not any(t and SECRET in t for _, t, *_ in got)
    changed = [(a, b) for a, b in zip(sorted(data, key=repr), sorted((g[:4] for g in got), key=repr), strict=True) if a[1] != b[1]]
    assert [a[0] for a, _ in changed] == [5000] and changed[0][1][1] == "ba lo mi [SECRET] tu"


def test_mix_takes_what_the_operator_says(spark):
    data = [(i, *r[1:]) for i, r in enumerate(given())]     # unique ids
    d = docs(spark, data)
    want = {r["doc_id"]: r for r in mixing.mix(d).collect()}
    words = {}
    texts = {i: t for i, t, *_ in data}
    for i, t, _, _, n in as_rows(pipeline.mix(spark, d, "")):
        words.setdefault(i, []).append(len(t.split()))
        assert t == texts[i] or t.split() == texts[i].split()[:len(t.split())]
        assert n == len(t)
    assert {i: sorted(w) for i, w in words.items()} == {i: sorted(x for x in (r["taken0"], r["taken1"]) if x) for i, r in want.items() if r["taken"]}


def test_mix_of_repeated_rows(spark):
    data = [(1, "a b c d e f", "en", "x")] * 5 + [(2, "g h", "en", "y")]
    got = as_rows(pipeline.mix(spark, docs(spark, data), ""))
    taken = mixing.mix(docs(spark, data)).agg({"taken": "sum"}).first()[0]
    assert sum(len(t.split()) for _, t, *_ in got) == taken


def test_pack_places_every_id(spark):
    data = given()
    checked(pipeline.pack(spark, docs(spark, data), "").collect(), encoded(data))


def test_run_on_given_tables(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    got = out.collect()
    assert got and sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert all(r["length"] <= packing.SEQUENCE for r in got)


def test_run_on_awkward_and_empty_tables(spark, scratch):
    assert pipeline.run(spark, table_dir(f"{scratch}/a", documents=docs(spark, given()))).count() > 0
    assert pipeline.run(spark, table_dir(f"{scratch}/b", documents=docs(spark, []))).count() == 0
    assert zlib.crc32(b"") == 0 and simhash.SEED == 42
