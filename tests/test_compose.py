"""Composed transition functions equal a plain walk, whatever the chunks; a hot sequence spreads over many tasks."""
import random

import pytest
from pyspark.sql import functions as F

from seqforge.operators import compose
from tests.test_walk import plain

TABLE = {(s, a): (s * 3 + ord(a)) % 5 for s in range(5) for a in "abc" if (s + ord(a)) % 11}


def frames(spark, lines, table=TABLE):
    rules = spark.createDataFrame([(s, a, n) for (s, a), n in table.items()], "state int, action string, next_state int")
    starts = spark.createDataFrame([(k, s) for k, (s, _) in lines.items()], "seq_id int, start_state int")
    rows = [(k, i, a) for k, (_, line) in lines.items() for i, a in enumerate(line)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "seq_id int, pos int, action string").repartition(4), starts, rules


def given():
    rng = random.Random(7)
    lines = {k: (rng.randrange(5), [rng.choice("ab") for _ in range(rng.randrange(60))]) for k in range(30)}
    lines |= {100: (0, ["a"] * 900), 101: (0, []), 102: (None, ["a"]), 103: (0, ["a", None, "a"]), 104: (3, ["zz"]), 105: (0, ["a"] * 300 + ["zz"] + ["a"] * 200)}
    return lines


@pytest.mark.parametrize("chunk,fan", [(512, 64), (7, 3)])
def test_prefixes_and_states(spark, chunk, fan):
    lines = given()
    steps, starts, rules = frames(spark, lines)
    got = {r["seq_id"]: (r["n_steps"], r["valid_len"], r["last_state"]) for r in compose.composed_prefix(steps, starts, rules, chunk=chunk, fan=fan).collect()}
    want = {k: plain(s, line, TABLE) for k, (s, line) in lines.items()}
    assert got == {k: (len(lines[k][1]), len(w) - 1, w[-1]) for k, w in want.items()}
    found = {}
    for r in sorted(compose.composed_states(steps, starts, rules, chunk=chunk, fan=fan).collect()):
        found.setdefault(r["seq_id"], []).append((r["pos"], r["state"]))
    assert found == {k: [*enumerate(w)][1:] for k, w in want.items() if len(w) > 1}


def test_a_hot_sequence_is_cut_into_many_parts(spark):
    steps = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 500).cast("int").alias("seq_id"),
                                       F.col("id").alias("pos"), F.lit("a").alias("action"))
    starts = steps.select("seq_id").distinct().withColumn("start_state", F.lit(0))
    rules = spark.createDataFrame([(0, "a", 1), (1, "a", 0)], "state int, action string, next_state int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # as with more data than one task's share
    try:
        chunks = compose.chunked(steps, ["seq_id"], ["pos"], "action", 512)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = chunks.where("seq_id = 0").select(F.countDistinct("part"), F.max(F.size("actions"))).first()
    assert hot[0] >= 4 and hot[1] <= 512
    r = compose.composed_prefix(steps, starts, rules).where("seq_id = 0").first()
    assert r["valid_len"] == r["n_steps"] > 40_000 and r["last_state"] == r["n_steps"] % 2


def test_many_states_are_refused(spark):
    steps, starts, _ = frames(spark, {1: (0, ["a"])})
    rules = spark.range(200).select(F.col("id").cast("int").alias("state"), F.lit("a").alias("action"), F.lit(0).alias("next_state"))
    with pytest.raises(ValueError):
        compose.composed_prefix(steps, starts, rules)


def test_empty_tables(spark):
    steps, starts, rules = frames(spark, {1: (0, ["a"])})
    assert compose.composed_prefix(steps.where("false"), starts, rules).first().asDict() == {"seq_id": 1, "n_steps": 0, "valid_len": 0, "last_state": 0}
    assert compose.composed_prefix(steps, starts.where("false"), rules).isEmpty()
    assert compose.composed_prefix(steps, starts, rules.where("false")).first()["valid_len"] == 0
    assert compose.composed_states(steps, starts, rules.where("false")).isEmpty()
