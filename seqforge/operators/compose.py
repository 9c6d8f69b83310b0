"""Prefixes of unbounded sequences by composing transition functions (E5(c), A7).

A sequence may be longer than a row or a task can hold (one user with a third of all events), so it is never collected.
Its steps (key, order, action) are range-partitioned once and cut into chunks of up to ``CHUNK`` steps. A chunk is a function:
for every state that can enter it, the state that leaves it and its first step that is not allowed. Functions compose,
so the state before a chunk is the composition of all chunks before it: chunks are composed ``FAN`` at a time, level by level,
until a sequence is one function; on the way back each level's entry states give those of the level below.

Which states can enter is told by the rules: every state that they name, plus the sequences' start states. Their number
must be small (at most ``STATES``), as every chunk's function lists them; for more states there is
:mod:`seqforge.operators.walk`, which follows the one state that a sequence is in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.session import stored

CHUNK, FAN, STATES = 512, 64, 64


def chunked(steps: DataFrame, key: Sequence[str], order: Sequence[str], action: str, chunk: int = CHUNK) -> DataFrame:
    """(key, part, piece, actions): a sequence's chunks in the order (part, piece); written. ``order`` must be total within a
    sequence, or its ties interchangeable. A part is a range of (key, order), so a long sequence has many; only the
    steps of one sequence in one range are ever sorted together."""
    dealt = (steps.select(*key, *order, F.col(action).alias("action")).repartitionByRange(*key, *order)
             .withColumn("part", F.spark_partition_id()))
    dealt = stored(dealt, "steps")
    inside = Window.partitionBy(*key, "part").orderBy(*order)
    placed = dealt.withColumn("i", F.row_number().over(inside) - 1).withColumn("piece", F.floor(F.col("i") / chunk).cast("int"))
    # collect_list skips nulls: the action is wrapped, so that a null one keeps its place.
    g = placed.groupBy(*key, "part", "piece").agg(F.sort_array(F.collect_list(F.struct("i", F.struct("action").alias("x")))).alias("s"))
    return g.select(*key, "part", "piece", F.transform("s", lambda x: x["x"]["action"]).alias("actions"))


def run(actions: Column, state: Column, trans: Column) -> Column:
    """struct<state, n>: ``state`` after the allowed actions, and how many they are."""
    def step(acc: Column, a: Column) -> Column:
        nxt = F.try_element_at(F.try_element_at(trans, a), acc["state"])
        go = acc["go"] & nxt.isNotNull()
        return F.struct(F.when(go, nxt).otherwise(acc["state"]).alias("state"), (acc["n"] + F.when(go, 1).otherwise(0)).alias("n"), go.alias("go"))

    return F.aggregate(actions, F.struct(state.alias("state"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("go")), step,
                       lambda acc: F.struct(acc["state"].alias("state"), acc["n"].alias("n")))


def functions(chunks: DataFrame, rules: DataFrame, states: list) -> DataFrame:
    """The chunks as functions: ``size`` steps, and ``f``, a map from every state to struct<state, n>; n < size where it ends."""
    from seqforge.operators.sequences import with_all_transitions
    kind = rules.schema["state"].dataType
    every = F.array(*[F.lit(s).cast(kind) for s in states])
    f = F.map_from_entries(F.transform(every, lambda s: F.struct(s.alias("key"), run(F.col("actions"), s, F.col("trans")).alias("value"))))
    return with_all_transitions(chunks, rules).select(*chunks.columns, F.size("actions").cast("bigint").alias("size"), f.alias("f")).drop("actions")


def after(f: Column, size: Column, state: Column, n: Column, alive: Column) -> Column:
    """struct<state, n, alive>: a function applied to where the functions before it led."""
    out = F.element_at(f, state)
    return F.struct(F.when(alive, out["state"]).otherwise(state).alias("state"), F.when(alive, n + out["n"]).otherwise(n).alias("n"),
                    (alive & (out["n"] == size)).alias("alive"))


def _fold(items: Column, state: Column) -> Column:
    """struct<state, n, alive>: functions applied one after the other."""
    start = F.struct(state.alias("state"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("alive"))
    return F.aggregate(items, start, lambda acc, x: after(x["f"], x["size"], acc["state"], acc["n"], acc["alive"]))


def composed(level: DataFrame, key: Sequence[str], states: list, kind, fan: int = FAN) -> DataFrame:
    """Of functions (key, place, size, f) the compositions of ``fan`` neighbours: (key, place // fan, size, f, members)."""
    g = (level.groupBy(*key, F.floor(F.col("place") / fan).cast("bigint").alias("place"))
         .agg(F.sort_array(F.collect_list(F.struct("place", "size", F.map_entries("f").alias("e")))).alias("m")))
    g = g.select(*key, "place", F.transform("m", lambda x: F.struct(x["place"].alias("place"), x["size"].alias("size"), F.map_from_entries(x["e"]).alias("f"))).alias("members"))
    every = F.array(*[F.lit(s).cast(kind) for s in states])
    f = F.transform(every, lambda s: F.struct(s.alias("key"), _fold(F.col("members"), s).alias("o")))
    f = F.map_from_entries(F.transform(f, lambda x: F.struct(x["key"], F.struct(x["o"]["state"].alias("state"), x["o"]["n"].alias("n")).alias("value"))))
    return g.select(*key, "place", F.aggregate("members", F.lit(0).cast("bigint"), lambda a, x: a + x["size"]).alias("size"), f.alias("f"), "members")


def _states(rules: DataFrame, starts: DataFrame) -> list:
    found = (rules.select("state").unionByName(rules.select(F.col("next_state").alias("state"))).unionByName(starts.select(F.col("start_state").alias("state")))
             .where("state IS NOT NULL").distinct().limit(STATES + 1).collect())
    if len(found) > STATES:
        raise ValueError(f"more than {STATES} states: use walk.walk")
    return sorted(r[0] for r in found)


def composed_prefix(steps: DataFrame, starts: DataFrame, rules: DataFrame, key: Sequence[str] = ("seq_id",), order: Sequence[str] = ("pos",),
                    action: str = "action", entries: bool = False, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, n_steps, valid_len, last_state) of sequences of any length. ``steps``: (key, order, action); ``starts``: (key,
    start_state) with unique keys; a step without a start takes no part, a start without a step has a prefix of 0.

    With ``entries``, instead the chunks (key, part, piece, actions, pos, state, alive): the steps before each, the state that enters it,
    and whether the prefix reaches it."""
    starts = starts.select(*key, "start_state")
    states, kind = _states(rules, starts), rules.schema["state"].dataType
    chunks = stored(chunked(steps, key, order, action, chunk), "chunks")
    # A chunk's place in its sequence: parts are few per sequence, pieces few per part.
    per_part = chunks.groupBy(*key, "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select(*key, "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    level = stored(functions(chunks, rules, states).join(first, [*key, "part"]).withColumn("place", F.col("first") + F.col("piece")).drop("first"), "functions")
    levels = [level]
    while True:
        up = stored(composed(levels[-1].select(*key, "place", "size", "f"), key, states, kind, fan), "composed")
        levels.append(up)
        if up.where("place > 0").isEmpty():
            break
    # Back down: what enters a composition enters its first member; every member's exit enters the next.
    now = levels[-1].join(starts, list(key)).select(*key, "place", "members", "f", "size", F.lit(0).cast("bigint").alias("pos"), F.col("start_state").alias("state"), F.lit(True).alias("alive"))
    if not entries:
        end = after(F.col("f"), F.col("size"), F.col("state"), F.col("pos"), F.col("alive") & F.col("state").isNotNull())
        got = now.select(*key, F.col("size").alias("n_steps"), end.alias("e"))
        return starts.join(got, list(key), "left").select(
            *key, F.coalesce("n_steps", F.lit(0)).cast("bigint").alias("n_steps"), F.coalesce("e.n", F.lit(0)).cast("bigint").alias("valid_len"),
            F.when(F.col("e").isNull(), F.col("start_state")).otherwise(F.col("e.state")).alias("last_state"))
    for below in reversed(levels[:-1]):
        now = _entries(now, key)
        now = below.join(now, [*key, "place"])
    return now.join(chunks, [*key, "part", "piece"]).select(*key, "part", "piece", "actions", "pos", "state", "alive")


def _entries(now: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, place, pos, state, alive) of the members of compositions whose own entry is known."""
    kind = now.schema["state"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<place:bigint,pos:bigint,state:{kind},alive:boolean>>").alias("out"),
                     F.col("pos").alias("pos"), F.col("state").alias("state"), (F.col("alive") & F.col("state").isNotNull()).alias("alive"))

    def step(acc: Column, x: Column) -> Column:
        o = F.element_at(x["f"], acc["state"])
        here = F.struct(x["place"].alias("place"), acc["pos"].alias("pos"), acc["state"].alias("state"), acc["alive"].alias("alive"))
        return F.struct(F.concat(acc["out"], F.array(here)).alias("out"), (acc["pos"] + x["size"]).alias("pos"),
                        F.when(acc["alive"], o["state"]).otherwise(acc["state"]).alias("state"), (acc["alive"] & (o["n"] == x["size"])).alias("alive"))

    return now.select(*key, F.explode(F.aggregate("members", start, step, lambda a: a["out"])).alias("m")).select(*key, "m.*")


def composed_states(steps: DataFrame, starts: DataFrame, rules: DataFrame, key: Sequence[str] = ("seq_id",), order: Sequence[str] = ("pos",),
                    action: str = "action", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """E6 in long form: (key, pos, state) after every allowed step of sequences of any length (pos from 1)."""
    from seqforge.operators.sequences import fold_states, with_all_transitions
    at = composed_prefix(steps, starts, rules, key, order, action, True, chunk, fan).where("alive")
    f = with_all_transitions(at, rules).select(*key, "pos", fold_states(F.col("actions"), F.col("state"), F.col("trans")).alias("f"))
    return (f.select(*key, F.col("pos").alias("p"), F.posexplode("f.states").alias("i", "state")).where("i > 0")
            .select(*key, (F.col("p") + F.col("i")).alias("pos"), "state"))
