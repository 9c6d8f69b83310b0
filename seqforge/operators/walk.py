"""Frontier walk over the trie of prefixes (E5(b), E10): valid prefixes and states for rules of any size.

A prefix is its start state and the actions so far. Equal prefixes of different sequences are one node, so a step is
looked up once for all sequences that share it. Nodes are named by a digest of the parent's name and the action:
all levels of the trie come from one pass over the sequences and one shuffle.

The walk goes level by level. Only nodes that were reached are carried on: (node, state) meets the level's edges on
the parent, then the rules. The rules are partitioned by (state, action) once and stay so; a level brings its distinct
(state, action) pairs to them, so a pair that many nodes ask for is asked once, and what comes back meets the
nodes in a join that Spark splits where a pair is hot. A level is one job, whose result is written;
nothing is collected per sequence, state or action. Supersteps cost a job each, so rules that fit a map are folded
instead (:func:`seqforge.operators.sequences.valid_prefix_fold` chooses by the measured size of the rules).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.session import stored


SENT = 100_000   # nodes of a frontier (16 bytes and a state each) that are sent to every task


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def prefix_nodes(actions: Column, start: Column) -> Column:
    """The names of the nodes on a sequence's way: of its start, then of every prefix."""
    root = _digest(F.to_json(F.struct(start.alias("s"))).cast("binary"))
    name = lambda acc, a: F.concat(acc, F.array(_digest(F.concat(
        F.element_at(acc, -1), F.coalesce(F.concat(F.lit("1"), a.cast("string")), F.lit("0")).cast("binary")))))
    return F.aggregate(F.coalesce(actions, F.array().cast("array<string>")), F.array(root), name)


def with_prefixes(seqs: DataFrame, key: Sequence[str] = ("seq_id",), actions: str = "actions") -> DataFrame:
    """(key, start_state, actions, nodes) of the sequences, written."""
    return stored(seqs.select(*key, "start_state", F.col(actions).alias("actions"),
                              prefix_nodes(F.col(actions), F.col("start_state")).alias("nodes")), "prefixes")


def trie(prefixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots (node, state), edges (level, parent, node, action)) of the sequences' prefixes, each once; the edges
    are written in order of their level, so that one level is read without the others."""
    roots = prefixed.select(F.element_at("nodes", 1).alias("node"), F.col("start_state").alias("state")).groupBy("node").agg(F.first("state").alias("state"))
    step = F.transform("actions", lambda a, i: F.struct((i + 1).alias("level"), F.element_at("nodes", i + 1).alias("parent"),
                                                        F.element_at("nodes", i + 2).alias("node"), a.alias("action")))
    edges = prefixed.select(F.explode(step).alias("e")).select("e.*").where(F.col("action").isNotNull()).distinct()
    return roots, stored(edges.repartitionByRange("level", "parent").sortWithinPartitions("level", "parent"), "trie")


def _once(rules: DataFrame) -> DataFrame:
    """The rules by (state, action), partitioned so; a pair that occurs twice raises."""
    n = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    twice = F.raise_error(F.concat(F.lit("duplicate rule for state and action "), F.to_json(F.struct("state", "action"))))
    return (rules.select("state", "action", "next_state").repartition(n, "state", "action").groupBy("state", "action")
            .agg(F.count("*").alias("_n"), F.first("next_state").alias("next_state"))
            .select("state", "action", F.when(F.col("_n") > 1, twice).otherwise(F.col("next_state")).alias("next_state")))


def asked(frontier: DataFrame, edges: DataFrame, nodes: int) -> DataFrame:
    """(node, state, action): the ``edges`` (parent, node, action) out of ``frontier`` (node, state), which has so many
    ``nodes``: a small one goes to the edges, for a large one both sides meet by hash."""
    at = frontier.select(F.col("node").alias("parent"), "state")
    return edges.join(F.broadcast(at) if nodes <= SENT else at, "parent").select("node", "state", "action")


def allowed(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, state) after those ``steps`` (node, state, action) that the rules allow; each distinct pair is asked once."""
    hits = steps.select("state", "action").distinct().join(rules, ["state", "action"])
    return steps.join(hits, ["state", "action"]).select("node", F.col("next_state").alias("state"))


def frontier_walk(roots: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(level, node, state) of every node that is reached; the roots are level 0. One job for a level, until
    none is reached; a level's result is written before the next one reads it, so no plan grows."""
    held = _once(rules).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        deepest = edges.agg(F.max("level")).first()[0] or 0
        levels = [stored(roots.select(F.lit(0).alias("level"), "node", "state"), "walk")]
        for k in range(1, deepest + 1):
            if not (nodes := levels[-1].count()):        # told by the written files
                break
            steps = asked(levels[-1], edges.where(F.col("level") == k), nodes)
            levels.append(stored(allowed(steps, held).select(F.lit(k).alias("level"), "node", "state"), "walk"))
        return reduce(DataFrame.unionByName, levels)
    finally:
        held.unpersist()


def reached_plies(prefixed: DataFrame, reached: DataFrame, key: Sequence[str] = ("seq_id",)) -> DataFrame:
    """(key, pos, state) of every ply that a sequence reaches (pos 0 = start), in long form."""
    start = prefixed.select(*key, F.lit(0).alias("pos"), F.col("start_state").alias("state"))
    later = prefixed.select(*key, F.posexplode("nodes").alias("pos", "node")).where(F.col("pos") > 0)
    return start.unionByName(later.join(reached.select("node", "state"), "node").select(*key, "pos", "state"))


def walk(seqs: DataFrame, rules: DataFrame, key: Sequence[str] = ("seq_id",), actions: str = "actions") -> DataFrame:
    """E5(b): (key, pos, state) of every ply that the sequences (key, start_state, actions) reach. ``key`` must be
    unique; a (state, action) that occurs twice in ``rules`` raises; a null action or state is never allowed."""
    prefixed = with_prefixes(seqs, key, actions)
    roots, edges = trie(prefixed)
    return reached_plies(prefixed, frontier_walk(roots, edges, rules), key)


def state_memo(seqs: DataFrame, rules: DataFrame, key: Sequence[str], prefix: str = "prefix") -> DataFrame:
    """(key, state) after the whole ``prefix`` of every row (NULL where a step of it is not allowed), each
    distinct prefix and each shared beginning walked once."""
    prefixed = with_prefixes(seqs, key, prefix)
    roots, edges = trie(prefixed)
    reached = frontier_walk(roots, edges, rules).select("node", "state")
    return prefixed.select(*key, F.element_at("nodes", -1).alias("node")).join(reached, "node", "left").select(*key, "state")
