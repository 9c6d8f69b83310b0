import random
import zlib

from seqforge.llm import toxicity
from tests.llm.fixtures import docs, prose, table_dir

BAD = ["grumfle", "snorkwit", "blatherskite"]


def corpus(n=900, seed=11):
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120)).split()
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ing"]))
        elif i % 7 == 0:
            words.insert(rng.randrange(len(words)), "grumfle soup")
        data.append((i, " ".join(words), "en", "s"))
        labels.append((i, 0, toxic))
    return data, labels


def run(spark, folder, data, labels):
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return toxicity.op10_toxicity(spark, table_dir(folder, documents=docs(spark, data), labels=frame)).collect()


def test_held_out_rows_obfuscation_and_exceptions(spark, scratch):
    data, labels = corpus()
    rng = random.Random(12)
    odd = {2000: "grυmflе", 2001: "5n0rkw1t", 2002: "BLATHERSK1TE", 2003: "ｇｒｕｍｆｌｅ", 2004: "sno​rkwit", 2005: "$norkwit!"}
    data += [(i, f"{prose(rng, 30)} {w} {prose(rng, 30)}", "en", "s") for i, w in odd.items()]
    data += [(3000, f"{prose(rng, 30)} Grumfle soup {prose(rng, 10)}", "en", "s"), (3001, f"{prose(rng, 30)} ungrumfled {prose(rng, 10)}", "en", "s")]
    got = {r["doc_id"]: r for r in run(spark, scratch, data, labels)}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i]["held_out"]]
    assert {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1} == set(held)
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(got[i]["predicted"] == 1 for i in odd) and not got[3000]["predicted"] and not got[3001]["predicted"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_edge_rows(spark, scratch):
    data, labels = corpus(300)
    data += [(None, "grumfle grumfle", "en", "s"), (5000, None, None, None), (5001, "", "en", "s"), (0, data[0][1], "en", "s"), (5002, "word " * 30000, "en", "s")]
    labels += [(None, 0, 1), (1, 0, None), (2, 0, 7), (0, 0, 0), (9999, 1, 1)]
    got = run(spark, scratch, data, labels)
    assert len(got) == len(data)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["predicted"] == 1 and by_id[5000]["score"] == by_id[5001]["score"] < 0.7 and by_id[5002]["predicted"] == 0


def test_no_labels_and_empty_tables(spark, scratch):
    data, labels = corpus(20)
    assert {r["score"] for r in run(spark, f"{scratch}/a", data, [])} == {0.0}
    assert run(spark, f"{scratch}/b", [], labels) == []
    only_clean = [(i, 0, 0) for i, _, _ in labels]
    assert all(r["predicted"] == 0 for r in run(spark, f"{scratch}/c", data, only_clean))


def test_folding():
    assert toxicity.fold("IDI0T") == toxicity.fold("idiot") == toxicity.fold("1d1ot") == toxicity.fold("іdiоt") == toxicity.fold("id!ot")
    assert toxicity.fold("Wow!") == "wow!" and toxicity.fold("") == ""


def test_hits_begin_words_and_heaviest_counts():
    lexicon = toxicity.Lexicon({"bad": 2.0, "badder": 5.0, "sore\n": 3.0}, {"bad day", "day sore"}, (0.0, 1.0, 1.0))
    assert lexicon.hits("bad badder unbad sore sorely") == [(0, 2.0), (4, 5.0), (17, 3.0)]
    assert lexicon.hits("a bad day sore") == [] and lexicon.hits("bad days") == [(0, 2.0)]


def test_longer_texts_need_more():
    lexicon = toxicity.Lexicon({"bad": 2.0}, set(), (-8.0, 0.0, 1.5))
    assert lexicon.score("bad text") > lexicon.score("bad text " + "word " * 500) > lexicon.score("text")


def test_rare_entries_are_weighed_behind_many_ordinary_ones(spark):
    rng = random.Random(13)
    ordinary = list({"".join(rng.choice("abcdeghnopruvwy") for _ in range(9)) for _ in range(6000)})
    data, labels = [], []
    for i in range(500):
        toxic = int(i < 40)
        words = rng.sample(ordinary, 2000 if toxic else 300)
        data.append((i, " ".join(words + ["zmqfjk"] * (i < 7)), "en", "s"))
        labels.append((i, 0, toxic))
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.learn(docs(spark, data), frame)
    taught = [i for i in range(7) if spark.sql(f"SELECT pmod(xxhash64({i}L, 11), 4) > 0 AS t").first()["t"]]
    assert len(taught) >= toxicity.LEAST_DOCS and any("zmqfjk".startswith(e.strip()) for e in got.weights)
    by_rank = {}
    for i, t, *_ in data[:40]:
        for e in toxicity.entries(toxicity.fold(t)):
            by_rank[e] = by_rank.get(e, 0) + 1
    assert sum(n > 7 for n in by_rank.values()) > 20_000
