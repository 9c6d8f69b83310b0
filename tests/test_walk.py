"""The frontier walk and the prefix trie: equal to a plain walk, one step per node, rules of any size."""
import random

import pytest
from pyspark.sql import functions as F

from seqforge.operators import sequences, walk

SCHEMA = "seq_id int, start_state int, actions array<string>"


def plain(start, actions, table):
    states = [start]
    for a in actions or []:
        if (states[-1], a) not in table:
            break
        states.append(table[states[-1], a])
    return states


def given(seed, n=120):
    rng = random.Random(seed)
    table = {(s, a): rng.randrange(9) for s in range(9) for a in "abcde" if rng.random() < 0.8}
    seqs = [(i, rng.randrange(2), [rng.choice("abcde") for _ in range(rng.randrange(9))]) for i in range(n)]
    seqs += [(1000, 0, None), (1001, 0, []), (1002, None, ["a"]), (1003, 0, ["a", None, "b"]), (1004, 0, ["zz"]), (1005, 0, ["a", "b"]), (1006, 0, ["a", "b"])]
    return table, seqs


def frames(spark, table, seqs):
    return (spark.createDataFrame([(s, a, n) for (s, a), n in table.items()], "state int, action string, next_state int"),
            spark.createDataFrame(seqs, SCHEMA).repartition(3))


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_equals_plain_walk(spark, seed):
    table, seqs = given(seed)
    rules, df = frames(spark, table, seqs)
    got = {}
    for r in sorted(walk.walk(df, rules).collect()):
        got.setdefault(r["seq_id"], []).append(r["state"])
    assert got == {i: plain(s, a, table) for i, s, a in seqs}


@pytest.mark.parametrize("with_states", [True, False])
def test_all_three_ways_agree(spark, monkeypatch, with_states):
    table, seqs = given(3)
    seqs = [s for s in seqs if s[2] is not None and s[1] is not None and None not in s[2]]
    rules, df = frames(spark, table, seqs)
    out = []
    for small, narrow in ((2048, 64), (0, 64), (0, 0)):
        monkeypatch.setattr(sequences, "SMALL", small)
        monkeypatch.setattr(sequences, "NARROW", narrow)
        out.append(sorted(map(tuple, sequences.valid_prefix_fold(df, rules, with_states).collect())))
    assert out[0] == out[1] == out[2]
    assert [(r[0], r[4], r[5]) for r in out[2]] == sorted(
        (i, len(p) - 1, p if with_states else p[-1]) for i, s, a in seqs for p in [plain(s, a, table)])


def test_one_step_per_node(spark):
    """The trie has a node for each distinct beginning, and the walk gives each reached one a single state."""
    table, seqs = given(4)
    rules, df = frames(spark, table, seqs)
    prefixed = walk.with_prefixes(df)
    roots, edges = walk.trie(prefixed)
    usable = [(s, tuple(a[:k])) for i, s, a in seqs if a for k in range(1, len(a) + 1) if a[k - 1] is not None]
    distinct = {(s, p) for s, p in usable}
    assert edges.count() == len(distinct) < len(usable)
    reached = walk.frontier_walk(roots, edges, rules).where("level > 0")
    want = {(s, p) for s, p in distinct if None not in p and len(plain(s, p, table)) == len(p) + 1}
    assert reached.count() == reached.select("node").distinct().count() == len(want)


def test_memo_equals_plain_walk(spark):
    table, seqs = given(5)
    rules, df = frames(spark, table, seqs)
    got = {r["seq_id"]: r["state"] for r in sequences.prefix_states(df, rules, ("seq_id",), "actions").collect()}
    want = {i: (p[-1] if len(p) == len(a or []) + 1 else None) for i, s, a in seqs for p in [plain(s, a, table)]}
    assert got == want


def test_duplicate_rules_raise(spark):
    table, seqs = given(6, 10)
    rules, df = frames(spark, table, seqs)
    with pytest.raises(Exception, match="duplicate rule"):
        walk.walk(df, rules.unionByName(rules)).collect()


def test_a_million_rules_of_one_action(spark):
    n = 1_000_000
    rules = spark.range(n).select(F.col("id").cast("int").alias("state"), F.lit("m").alias("action"), ((F.col("id") * 7 + 1) % n).cast("int").alias("next_state"))
    seqs = spark.range(20_000).select(F.col("id").cast("int").alias("seq_id"), (F.col("id") % 5000).cast("int").alias("start_state"),
                                      F.array_repeat(F.lit("m"), 4).alias("actions"))
    got = sequences.valid_prefix_fold(seqs, rules, with_states=False)

    def ahead(s):
        for _ in range(4):
            s = (s * 7 + 1) % n
        return s

    assert got.where("valid_len <> 4").isEmpty()
    assert {(r["start_state"], r["last_state"]) for r in got.select("start_state", "last_state").distinct().collect()} == {(s, ahead(s)) for s in range(5000)}


def test_empty_tables(spark):
    rules, df = frames(spark, {(0, "a"): 1}, [])
    assert walk.walk(df, rules).isEmpty()
    none, some = rules.where("false"), spark.createDataFrame([(1, 0, ["a"])], SCHEMA)
    assert [tuple(r) for r in walk.walk(some, none).collect()] == [(1, 0, 0)]
    assert sequences.valid_prefix_fold(some, none).first()["valid_len"] == 0
