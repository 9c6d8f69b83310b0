"""Explode and ordered-sequence operators.

Domain rules (which step is allowed in which state) are a table ``rules(state, action, next_state)``
that gets joined, never a per-row library. A sequence is one row with its actions in order:

* ``valid_prefix`` (observable state = previous action): the steps as (previous action, action) pairs,
  one left join and a ``min``;
* ``valid_prefix_fold`` (hidden state, rules of any size): by the measured size of the rules, one map of all of them
  (a scalar subquery, no join), a map of the sequence's own actions (one join on the action), or the frontier walk
  of ``walk.py``. The maps are folded over a sequence's array of actions; the walk needs no map and no array of states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions.text import col_of, hash32, let, ws_split
from seqforge.operators import walk
from seqforge.session import stored


# ---- E1/E2: explodes -------------------------------------------------------------------------

def token_explode(df: DataFrame, col: str, out: str = "token", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per whitespace token of ``col``."""
    return df.select(*keep, F.explode(ws_split(col)).alias(out))


def explode_evals(records: DataFrame, keep: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """E2, level 1: one row per eval with depth, knodes and its number of pvs."""
    return (records.select(*keep, F.posexplode("evals").alias("eval_idx", "ev"))
            .select(*keep, "eval_idx", F.col("ev.depth").alias("depth"), F.col("ev.knodes").alias("knodes"),
                    F.size("ev.pvs").alias("n_pvs"), F.col("ev.pvs").alias("pvs")))


def explode_pvs(records: DataFrame, keep: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """E2, level 2: one row per pv with cp, mate and line."""
    ev = explode_evals(records, keep)
    return (ev.select(*keep, "eval_idx", F.posexplode("pvs").alias("pv_idx", "pv"))
            .select(*keep, "eval_idx", "pv_idx", F.col("pv.cp").alias("cp"), F.col("pv.mate").alias("mate"),
                    F.col("pv.line").alias("line")))


# ---- P5/P6: nested pick and minimum length -----------------------------------------------------

def best_line_all(records: DataFrame) -> DataFrame:
    """P5 without the drop: first eval's first pv line (NULL when the path is missing)."""
    ev0 = F.get(F.col("evals"), 0)
    pv0 = F.get(ev0["pvs"], 0)
    return records.select("rec_id", "fen", pv0["line"].alias("line"), ev0["depth"].alias("depth"),
                          F.coalesce(ev0["knodes"], F.lit(0).cast("bigint")).alias("knodes"))


def best_line(records: DataFrame) -> DataFrame:
    """P5: first eval's first pv line; a missing path drops the row. Also depth and knodes (0 if absent)."""
    return best_line_all(records).where(F.col("line").isNotNull())


def min_len(df: DataFrame, n: int = 2, col: str = "line") -> DataFrame:
    """At least ``n`` whitespace tokens."""
    return df.where(F.size(ws_split(col)) >= n)


# ---- E3/E4: per-ply expansion -------------------------------------------------------------------

def ply_expand(puzzles: DataFrame, solver_offset: int = 0, states: str | None = None,
               cands: str | DataFrame | None = None) -> DataFrame:
    """One row per ply where the solving side moves (plies offset, offset+2, ...).

    move_number = idx+1, total_moves = n, solution = moves[idx:], side_to_move from the position text. With the array
    ``states`` of the states before each move, fen is that state's text and legal_moves its candidates, from ``cands``: a
    column as of :func:`with_candidates`, or the table of :func:`candidate_actions`, joined with the plies, so that no
    puzzle ever holds the candidates of all its states. Everything of a ply is put into its element before the explode,
    so a ply carries its own state and candidates, not the puzzle's arrays."""
    side0 = F.get(F.split(F.col("fen"), " "), 1)
    from seqforge.operators.project import side_label
    joins = isinstance(cands, DataFrame)
    given = {"moves": F.col("moves")} | ({"states": F.col(states)} if states else {}) | ({"cands": F.col(cands)} if states and not joins else {})

    def plies(v: Column) -> Column:
        n = F.size(v["moves"])
        idx = F.when(n > solver_offset, F.sequence(F.lit(solver_offset), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))

        def one(i: Column) -> Column:
            own = [i.alias("idx"), F.element_at(v["moves"], i + 1).alias("move"), F.slice(v["moves"], i + 1, n - i).alias("solution")]
            if states:
                state = F.element_at(v["states"], i + 1)
                own += [state.cast("string").alias("fen"),
                        state.alias("state") if joins else candidates_of(state, v["cands"]).alias("legal_moves")]
            return F.struct(*own)

        return F.transform(idx, one)

    kept = ["puzzle_id", "rating", "themes", "game_url", "opening_tags"]
    out = puzzles.select(*kept, *([] if states else ["fen"]), side0.alias("_side"), F.size("moves").alias("total_moves"),
                         F.explode(let(F.struct(*[c.alias(k) for k, c in given.items()]), plies)).alias("p"))
    legal = F.col("p.legal_moves")
    if joins:
        out = out.join(cands.select(F.col("state").alias("_state"), "candidates"), F.col("p.state") == F.col("_state"), "left")
        legal = F.coalesce("candidates", F.array().cast("array<string>")).alias("legal_moves")
    return out.select("puzzle_id", *([F.col("p.fen"), legal] if states else ["fen"]), *kept[1:], "p.move",
                      side_label(F.col("_side"), F.col("p.idx")).alias("side_to_move"), (F.col("p.idx") + 1).alias("move_number"),
                      "total_moves", "p.solution", "p.idx")


def all_or_nothing(checked: DataFrame, actions: str = "actions") -> tuple[DataFrame, DataFrame]:
    """Whole sequences whose every step is valid, and the failed ones. ``checked`` is the sequences
    with their ``valid_len`` (from :func:`valid_prefix_fold`)."""
    ok = F.col("valid_len") == F.size(actions)
    return checked.where(ok), checked.where(~ok)


# ---- E5/E6: longest valid prefix and state replay ----------------------------------------------

def step_pairs(seqs: DataFrame, start: str = "") -> DataFrame:
    """(seq_id, pos from 1, prev, action): each step with the action before it (``start`` at the first)."""
    prev = F.concat(F.array(F.lit(start)), F.slice("actions", F.lit(1), F.greatest(F.size("actions") - 1, F.lit(0))))
    steps = F.arrays_zip(prev.alias("prev"), F.col("actions").alias("action"))
    return (seqs.where(F.size("actions") > 0).select("seq_id", F.posexplode(steps).alias("i", "s"))
            .select("seq_id", (F.col("i") + 1).alias("pos"), "s.prev", "s.action"))


def valid_prefix(seqs: DataFrame, pairs: DataFrame, start: str = "") -> DataFrame:
    """E5(a): observable state. A step at ``pos`` is allowed when (previous action, action) is in
    ``pairs(prev, action)``; the prefix ends before the first step that is not.

    Returns (seq_id, n_steps, valid_len) of the sequences that have a step; the result is a partial
    aggregate per sequence. The pair relation is small (AQE broadcasts it when it is).
    """
    allowed = pairs.select("prev", "action", F.lit(True).alias("ok")).dropDuplicates(["prev", "action"])
    j = step_pairs(seqs, start).join(allowed, ["prev", "action"], "left")
    agg = j.groupBy("seq_id").agg(F.count("*").alias("n_steps"),
                                  F.min(F.when(F.col("ok").isNull(), F.col("pos"))).alias("first_bad"))
    return agg.select("seq_id", F.col("n_steps").cast("int"),
                      F.coalesce(F.col("first_bad") - 1, F.col("n_steps")).cast("int").alias("valid_len"))


SMALL = 2048     # rules that may be one map, given to every row
NARROW = 64      # states of one action that may be a map in a sequence's row
STRETCH = 64     # steps whose states are kept together while a sequence is folded


def rule_sizes(rules: DataFrame) -> tuple[int, int]:
    """(all rules, most rules of one action), from one pass."""
    per = rules.groupBy("action").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    return int(per[0]), int(per[1])


def _per_action(rules: DataFrame) -> DataFrame:
    return rules.groupBy("action").agg(F.map_from_entries(F.collect_list(F.struct("state", "next_state"))).alias("m"))


def with_all_transitions(seqs: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``trans``, all rules as one map action -> (state -> next state), for at most ``SMALL`` rules: computed once."""
    return seqs.withColumn("trans", _per_action(rules).agg(F.map_from_entries(F.collect_list(F.struct("action", "m")))).scalar())


def with_transitions(seqs: DataFrame, rules: DataFrame, key: Sequence[str] = ("seq_id",),
                     actions: str = "actions") -> DataFrame:
    """Adds ``trans``, the rules of the sequence's own actions as a map action -> (state -> next state);
    NULL when it has none; for rules with at most ``NARROW`` states an action. ``key`` must be unique.
    A (state, action) that occurs twice in ``rules`` raises, as a map cannot hold it twice, so no row is ever doubled.

    The rules are grouped per action once and joined with each sequence's distinct actions; nothing is
    collected or broadcast, however many actions there are."""
    own = seqs.select(*key, F.explode(F.array_distinct(actions)).alias("action"))
    maps = (own.join(_per_action(rules), "action").groupBy(*key)
            .agg(F.map_from_entries(F.collect_list(F.struct("action", "m"))).alias("trans")))
    return seqs.join(maps, list(key), "left")


def with_candidates(df: DataFrame, rules: DataFrame, key: Sequence[str] = ("seq_id",), states: str = "states") -> DataFrame:
    """Adds ``cands``, the sorted allowed actions (E9) of the states the sequence visits, as a map
    state text -> actions. ``key`` must be unique."""
    seen = df.select(*key, F.explode(F.array_distinct(states)).alias("state"))
    maps = (seen.join(candidate_actions(rules), "state").groupBy(*key)
            .agg(F.map_from_entries(F.collect_list(F.struct(F.col("state").cast("string"), "candidates"))).alias("cands")))
    return df.join(maps, list(key), "left")


def with_all_candidates(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``cands`` of all states as one map, for at most ``SMALL`` rules: computed once, no join."""
    one = candidate_actions(rules).agg(F.map_from_entries(F.collect_list(F.struct(F.col("state").cast("string"), "candidates"))))
    return df.withColumn("cands", one.scalar())


def replayed(seqs: DataFrame, rules: DataFrame, key: Sequence[str] = ("seq_id",), actions: str = "actions",
             cands: bool = True) -> DataFrame:
    """:func:`valid_prefix_fold` with ``states``, and, if wanted, the candidates of the states visited as ``cands``. The rules
    are written once and measured once."""
    rules = stored(rules.select("state", "action", "next_state"), "rules")
    sizes = rule_sizes(rules)
    checked = valid_prefix_fold(seqs, rules, True, key, actions, sizes)
    if not cands:
        return checked
    return with_all_candidates(checked, rules) if sizes[0] <= SMALL else with_candidates(checked, rules, key)


def candidates_of(state: Column, cands: Column | None = None) -> Column:
    """The ``cands`` entry of a state; [] when it has none."""
    return F.coalesce(F.try_element_at(F.col("cands") if cands is None else cands, state.cast("string")), F.array().cast("array<string>"))


def fold_states(actions: Column, start: Column, trans: Column, with_states: bool = True) -> Column:
    """E5(c)/E6: struct<valid_len, states[]> where states[k] is the state before step k (and
    states[valid_len] the state after the valid prefix). Two map lookups per step, no string keys.

    ``with_states=False`` keeps only the count. With states, a step appends to the states of its own stretch of ``STRETCH``
    steps, and a stretch to the list of stretches, so a step copies at most a stretch, not all states so far."""
    def step_of(acc: Column, a: Column):
        m = F.try_element_at(trans, a)
        go = acc["alive"] & F.coalesce(F.map_contains_key(m, acc["s"]), F.lit(False))
        nxt = F.when(go, F.try_element_at(m, acc["s"])).otherwise(acc["s"])
        return go, nxt

    if not with_states:
        init = F.struct(start.alias("s"), F.lit(True).alias("alive"), F.lit(0).alias("n"))

        def step(acc: Column, a: Column) -> Column:
            go, nxt = step_of(acc, a)
            return F.struct(nxt.alias("s"), go.alias("alive"), F.when(go, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

        return F.aggregate(actions, init, step, lambda acc: F.struct(acc["n"].alias("valid_len"),
                                                                      acc["s"].alias("last_state")))

    def stretch(acc: Column, part: Column) -> Column:
        """One stretch: its states, then its end."""
        begin = F.struct(acc["s"].alias("s"), acc["alive"].alias("alive"), acc["n"].alias("n"), F.slice(F.array(acc["s"]), 1, 0).alias("states"))

        def step_states(inner: Column, a: Column) -> Column:
            go, nxt = step_of(inner, a)
            return F.struct(nxt.alias("s"), go.alias("alive"), F.when(go, inner["n"] + 1).otherwise(inner["n"]).alias("n"),
                            F.when(go, F.concat(inner["states"], F.array(nxt))).otherwise(inner["states"]).alias("states"))

        return F.aggregate(part, begin, step_states, lambda x: F.struct(
            x["s"].alias("s"), x["alive"].alias("alive"), x["n"].alias("n"), F.concat(acc["parts"], F.array(x["states"])).alias("parts")))

    init = F.struct(start.alias("s"), F.lit(True).alias("alive"), F.lit(0).alias("n"), F.array(F.array(start)).alias("parts"))
    n = F.size(actions)
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(STRETCH)), lambda i: F.slice(actions, i, STRETCH)))
    return F.when(n > 0, F.aggregate(parts, init, stretch, lambda acc: F.struct(acc["n"].alias("valid_len"), F.flatten(acc["parts"]).alias("states")))
                  ).otherwise(F.struct(F.lit(0).alias("valid_len"), F.array(start).alias("states")))


def valid_prefix_fold(seqs: DataFrame, rules: DataFrame, with_states: bool = True,
                      key: Sequence[str] = ("seq_id",), actions: str = "actions", sizes: tuple[int, int] | None = None) -> DataFrame:
    """E5(c): the sequences' columns, n_steps, valid_len and states[] (or last_state), for rules of any size (``sizes``, if
    known, as of :func:`rule_sizes`)."""
    total, widest = sizes or rule_sizes(rules)
    if total > SMALL and widest > NARROW:
        return from_walk(seqs, walk.walk(seqs, rules, key, actions), with_states, key, actions)
    j = with_all_transitions(seqs, rules) if total <= SMALL else with_transitions(seqs, rules, key, actions)
    f = fold_states(F.col(actions), F.col("start_state"), F.col("trans"), with_states)
    last = "states" if with_states else "last_state"
    return (j.select(*seqs.columns, F.size(actions).alias("n_steps"), f.alias("_f"))
            .select(*seqs.columns, "n_steps", F.col("_f.valid_len").alias("valid_len"), F.col(f"_f.{last}").alias(last)))


def from_walk(seqs: DataFrame, reached: DataFrame, with_states: bool = True, key: Sequence[str] = ("seq_id",),
              actions: str = "actions") -> DataFrame:
    """The columns of :func:`valid_prefix_fold` from the plies (key, pos, state) that the sequences reach."""
    per = (F.transform(F.sort_array(F.collect_list(F.struct("pos", "state"))), lambda x: x["state"]).alias("states") if with_states
           else F.max_by("state", "pos").alias("last_state"))
    g = reached.groupBy(*key).agg(F.max("pos").alias("valid_len"), per)
    return seqs.join(g, list(key)).select(*seqs.columns, F.size(actions).alias("n_steps"), "valid_len", "states" if with_states else "last_state")


def state_at(states: Column, k: Column | int) -> Column:
    """State after the first k steps (NULL beyond the valid prefix)."""
    kk = F.lit(k) if isinstance(k, int) else k
    return F.try_element_at(states, kk + 1)


# ---- E7/E8: split point and continuation -------------------------------------------------------

def split_point(id_col: Column | str, n: Column, seed: int = 42, epoch: int = 0) -> Column:
    """Reproducible uniform index in [0, n-1]; ``epoch`` gives a fresh draw per pass."""
    return F.when(n > 0, F.pmod(hash32(f"{seed}:{epoch}", col_of(id_col)), n.cast("bigint")).cast("int"))


def continuation(tokens: Column, idx: Column, k: int = 6) -> Column:
    """struct<target, window>: target = tokens[idx]; window = tokens[idx:idx+k] (k<=0: [target])."""
    target = F.element_at(tokens, idx + 1)
    window = F.array(target) if k <= 0 else F.slice(tokens, idx + 1, k)
    return F.struct(target.alias("target"), window.alias("window"))


def all_splits(df: DataFrame, tokens_col: str, keep: tuple[str, ...]) -> DataFrame:
    """E7 'all splits' mode: one row per index."""
    return df.select(*keep, tokens_col, F.posexplode(tokens_col).alias("split_idx", "target"))


# ---- E9/E10: candidates and prefix memo ---------------------------------------------------------

def candidate_actions(rules: DataFrame) -> DataFrame:
    """State -> sorted distinct allowed actions. Grouped per state with partial aggregation."""
    return rules.groupBy("state").agg(F.sort_array(F.collect_set("action")).alias("candidates"))


def prefix_states(df: DataFrame, rules: DataFrame, key: Sequence[str] = ("seq_id",), prefix: str = "prefix") -> DataFrame:
    """E10 for prefixes: (key, state) after each row's whole ``prefix``, every shared beginning stepped through once."""
    return walk.state_memo(df, rules, key, prefix)


def dedup_compute(df: DataFrame, keys: list[str], compute) -> DataFrame:
    """Compute once per distinct key tuple, then join the result back (the memo as a plan)."""
    distinct = df.select(*keys).distinct()
    return df.join(compute(distinct), keys, "left")
