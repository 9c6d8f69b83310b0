"""Queries over action sequences (events -> user-week sequences, rules from the action vocabulary)
and over lines (documents): valid prefixes, state replay, candidates, splits, samples, G5."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.functions.text import joined
from seqforge.operators import chat, compose, profile, sampling, sequences, walk
from seqforge.plans import fixtures as fx
from seqforge.plans.catalog import register
from seqforge.plans.fixtures_sql import h32, lit, with_views

# ---- E5/E6/E4/E9/E10/A7 over V-SEQ -----------------------------------------------------------

_VP_SQL = """
SELECT s.seq_id, CAST(count(*) AS INTEGER) AS n_steps,
       CAST(coalesce(min(CASE WHEN p.action IS NULL THEN s.pos END) - 1, count(*)) AS INTEGER) AS valid_len
FROM (SELECT seq_id, pos, action,
             coalesce(lag(action) OVER (PARTITION BY seq_id ORDER BY pos), '') AS prev FROM v_seq_long) s
LEFT JOIN v_pairs p ON p.prev = s.prev AND p.action = s.action
GROUP BY s.seq_id
"""


@register("valid_prefix", with_views(_VP_SQL, "v_seq_long", "v_pairs"))
def q_valid_prefix(spark, sf):
    return sequences.valid_prefix(fx.v_seq(spark, sf), fx.v_pairs(spark, sf))


# Recursive walk in SQL: the oracle of the hidden-state queries.
_WALK = """
SELECT seq_id, 0 AS pos, start_state AS state FROM v_seq
UNION ALL
SELECT w.seq_id, w.pos + 1, r.next_state
FROM walk w JOIN v_seq_long l ON l.seq_id = w.seq_id AND l.pos = w.pos + 1
JOIN v_rules r ON r.state = w.state AND r.action = l.action
"""
_WALK_RESULT_SQL = """
SELECT s.seq_id, CAST(len(s.actions) AS INTEGER) AS n_steps, CAST(max(w.pos) AS INTEGER) AS valid_len,
       string_agg(CAST(w.state AS VARCHAR), ' ' ORDER BY w.pos) AS states
FROM v_seq s JOIN walk w ON w.seq_id = s.seq_id
GROUP BY s.seq_id, s.actions
"""


def _walk_sql(sql: str) -> str:
    return with_views(sql, "v_seq", "v_seq_long", "v_rules", extra={"walk": _WALK}, recursive=True)


@register("valid_prefix_fold", _walk_sql(_WALK_RESULT_SQL))
def q_valid_prefix_fold(spark, sf):
    f = sequences.valid_prefix_fold(fx.v_seq(spark, sf), fx.v_rules(spark, sf))
    return f.select("seq_id", "n_steps", "valid_len", joined("states").alias("states"))


@register("valid_prefix_walk", _walk_sql(_WALK_RESULT_SQL))
def q_valid_prefix_walk(spark, sf):
    """E5(b): the frontier walk over the trie of prefixes; its plies in long form, regrouped."""
    seqs = fx.v_seq(spark, sf)
    f = sequences.from_walk(seqs, walk.walk(seqs, fx.v_rules(spark, sf)))
    return f.select("seq_id", "n_steps", "valid_len", joined("states").alias("states"))


@register("state_at_k", _walk_sql("""
SELECT s.seq_id, CAST(len(s.actions) // 2 AS INTEGER) AS k, w.state
FROM v_seq s LEFT JOIN walk w ON w.seq_id = s.seq_id AND w.pos = len(s.actions) // 2
"""))
def q_state_at_k(spark, sf):
    f = sequences.valid_prefix_fold(fx.v_seq(spark, sf), fx.v_rules(spark, sf))
    k = F.floor(F.col("n_steps") / 2).cast("int")
    return f.select("seq_id", k.alias("k"), sequences.state_at(F.col("states"), k).alias("state"))


@register("dedup_compute", _walk_sql("""
SELECT s.seq_id, CAST(len(s.actions) // 2 AS INTEGER) AS k, w.state
FROM v_seq s LEFT JOIN walk w ON w.seq_id = s.seq_id AND w.pos = len(s.actions) // 2
"""))
def q_dedup_compute(spark, sf):
    """The state after the first half of each sequence, each shared beginning walked once."""
    seqs = fx.v_seq(spark, sf)
    k = F.floor(F.size("actions") / 2).cast("int")
    pre = seqs.select("seq_id", "start_state", k.alias("k"), F.slice("actions", F.lit(1), k).alias("prefix"))
    return sequences.prefix_states(pre, fx.v_rules(spark, sf), ("seq_id", "k"))


@register("candidate_actions", with_views(
    "SELECT state, array_to_string(list_sort(list_distinct(list(action))), ' ') AS candidates FROM v_rules "
    "GROUP BY state", "v_rules"))
def q_candidate_actions(spark, sf):
    c = sequences.candidate_actions(fx.v_rules(spark, sf))
    return c.select("state", joined("candidates").alias("candidates"))


@register("all_or_nothing", _walk_sql("""
SELECT s.seq_id, CASE WHEN max(w.pos) = len(s.actions) THEN 'ok' ELSE 'failed' END AS status
FROM v_seq s JOIN walk w ON w.seq_id = s.seq_id GROUP BY s.seq_id, s.actions
"""))
def q_all_or_nothing(spark, sf):
    checked = sequences.valid_prefix_fold(fx.v_seq(spark, sf), fx.v_rules(spark, sf), with_states=False)
    ok, failed = sequences.all_or_nothing(checked)
    return (ok.select("seq_id", F.lit("ok").alias("status"))
            .unionByName(failed.select("seq_id", F.lit("failed").alias("status"))))


@register("extract_report", _walk_sql("""
SELECT count(*) AS total, count_if(ok) AS successful, count_if(NOT ok) AS failed,
       CAST(coalesce(sum(CASE WHEN ok THEN (n + 1) // 2 ELSE 0 END), 0) AS BIGINT) AS total_positions,
       round(count_if(ok) * 100.0 / count(*), 1) AS success_pct,
       round(CAST(coalesce(sum(CASE WHEN ok THEN (n + 1) // 2 ELSE 0 END), 0) AS BIGINT) / greatest(count_if(ok), 1), 1)
         AS positions_per_success
FROM (SELECT s.seq_id, len(s.actions) AS n, max(w.pos) = len(s.actions) AS ok
      FROM v_seq s JOIN walk w ON w.seq_id = s.seq_id GROUP BY s.seq_id, s.actions)
"""))
def q_extract_report(spark, sf):
    """A7 over E4: a sequence yields one position per own ply (plies 0, 2, 4, ...)."""
    checked = sequences.valid_prefix_fold(fx.v_seq(spark, sf), fx.v_rules(spark, sf), with_states=False)
    return profile.extract_report(checked, F.floor((F.size("actions") + 1) / 2))


# ---- E5(c)/E6/A7 over whole user histories, of any length -----------------------------------------

_USER_WALK = """
SELECT DISTINCT seq_id, CAST(0 AS BIGINT) AS pos, 0 AS state FROM v_user_steps
UNION ALL
SELECT w.seq_id, w.pos + 1, r.next_state
FROM walk w JOIN v_user_steps l ON l.seq_id = w.seq_id AND l.pos = w.pos + 1
JOIN v_rules r ON r.state = w.state AND r.action = l.action
"""


def _user_sql(sql: str) -> str:
    return with_views(sql, "v_user_steps", "v_rules", extra={"walk": _USER_WALK}, recursive=True)


_USER_SQL = """
SELECT s.seq_id, s.n_steps, w.pos AS valid_len, w.state AS last_state
FROM (SELECT seq_id, count(*) AS n_steps FROM v_user_steps GROUP BY seq_id) s
JOIN (SELECT seq_id, max(pos) AS pos, arg_max(state, pos) AS state FROM walk GROUP BY seq_id) w ON w.seq_id = s.seq_id
"""


def _user_prefix(spark, sf):
    steps, starts = fx.v_user_steps(spark, sf)
    return compose.composed_prefix(steps, starts, fx.v_rules(spark, sf), order=("ts", "event_id"))


@register("user_prefix", _user_sql(_USER_SQL))
def q_user_prefix(spark, sf):
    """E5(c) by composed transition functions: no sequence is collected."""
    return _user_prefix(spark, sf)


@register("user_states", _user_sql("SELECT seq_id, pos, state FROM walk WHERE pos > 0"))
def q_user_states(spark, sf):
    """E6 in long form: the state after every step of the prefix."""
    steps, starts = fx.v_user_steps(spark, sf)
    return compose.composed_states(steps, starts, fx.v_rules(spark, sf), order=("ts", "event_id"))


@register("user_report", _user_sql(f"""
SELECT count(*) AS total, count_if(ok) AS successful, count_if(NOT ok) AS failed,
       CAST(coalesce(sum(CASE WHEN ok THEN (n_steps + 1) // 2 ELSE 0 END), 0) AS BIGINT) AS total_positions,
       round(count_if(ok) * 100.0 / count(*), 1) AS success_pct,
       round(CAST(coalesce(sum(CASE WHEN ok THEN (n_steps + 1) // 2 ELSE 0 END), 0) AS BIGINT) / greatest(count_if(ok), 1), 1) AS positions_per_success
FROM (SELECT n_steps, valid_len = n_steps AS ok FROM ({_USER_SQL}))
"""))
def q_user_report(spark, sf):
    """A7 over sequences of any length."""
    return profile.extract_report(_user_prefix(spark, sf), F.floor((F.col("n_steps") + 1) / 2), F.col("n_steps"))


# ---- G5: game conversations ----------------------------------------------------------------

def game_rows_sql() -> str:
    """Per-ply rows of the game conversations (oracle side): the system text, and for each reached
    ply its user text, the action and whether it is an assistant ply before the prefix end."""
    coin = f"({h32('role42', 's.seq_id')} % 2 = 0)"
    sys_tpl = fixed.GAME_SYSTEM
    a0 = sys_tpl.split("{assistant}")[0]
    a1 = sys_tpl.split("{assistant}")[1].split("{user}")[0]
    a2 = sys_tpl.split("{user}")[1].split("{fen}")[0]
    a3 = sys_tpl.split("{fen}")[1]
    return f"""
  SELECT s.seq_id, CAST(len(s.actions) AS INTEGER) AS num_moves, w.pos AS k, s.actions[w.pos + 1] AS action,
         {lit(a0)} || CASE WHEN {coin} THEN 'White' ELSE 'Black' END || {lit(a1)}
           || CASE WHEN {coin} THEN 'Black' ELSE 'White' END || {lit(a2)} || CAST(s.start_state AS VARCHAR) || {lit(a3)}
           AS system_text,
         CASE WHEN w.pos > 0 THEN '<uci_move>' || s.actions[w.pos] || '</uci_move>' || chr(10) || chr(10) ELSE '' END
           || 'Position: ' || CAST(w.state AS VARCHAR) || chr(10) || 'Legal moves: '
           || coalesce((SELECT array_to_string(list_sort(list_distinct(list(r.action))), ' ') FROM v_rules r
                        WHERE r.state = w.state), '') AS user_text,
         w.pos < v.valid_len AND w.pos % 2 = (CASE WHEN {coin} = (s.start_side = 'w') THEN 0 ELSE 1 END) AS mine
  FROM v_seq s JOIN walk w ON w.seq_id = s.seq_id
  JOIN (SELECT seq_id, max(pos) AS valid_len FROM walk GROUP BY seq_id) v ON v.seq_id = s.seq_id
  WHERE len(s.actions) >= 2
"""


def _game_sql() -> str:
    return _walk_sql(f"""
SELECT seq_id, num_moves,
       'system: ' || system_text
       || coalesce(string_agg(CASE WHEN mine THEN chr(10) || chr(10) || 'user: ' || user_text
                                   || chr(10) || chr(10) || 'assistant: <uci_move>' || action
                                   || '</uci_move>' END, '' ORDER BY k), '') AS messages_text
FROM ({game_rows_sql()})
GROUP BY seq_id, num_moves, system_text
HAVING count_if(mine) > 0
""")


@register("build_conversation", _game_sql())
def q_build_conversation(spark, sf):
    from seqforge.operators.examples import game_conversations
    g = game_conversations(fx.v_seq(spark, sf), fx.v_rules(spark, sf))
    return g.select("seq_id", F.col("num_moves").cast("int"), chat.messages_text("messages").alias("messages_text"))


# ---- E7/E8/F3 over V-LINES ------------------------------------------------------------------

def _lines_split(spark, sf, seed=42, epoch=0):
    lines = fx.v_lines(spark, sf)
    t = F.split("line", " ")
    return lines.select("seq_id", "fen", "depth", t.alias("tokens"),
                        sequences.split_point("seq_id", F.size(t), seed, epoch).alias("split_idx"))


@register("split_point", with_views(
    f"SELECT seq_id, CAST(len(t) AS INTEGER) AS n, CAST({h32('42:0', 'seq_id')} % len(t) AS INTEGER) AS split_idx "
    f"FROM (SELECT seq_id, string_split(line, ' ') AS t FROM v_lines)", "v_lines"))
def q_split_point(spark, sf):
    s = _lines_split(spark, sf)
    return s.select("seq_id", F.size("tokens").cast("int").alias("n"), "split_idx")


@register("all_splits", with_views(
    "SELECT seq_id, CAST(i AS INTEGER) AS split_idx, t[i + 1] AS target "
    "FROM (SELECT seq_id, t, unnest(range(len(t))) AS i FROM (SELECT seq_id, string_split(line, ' ') AS t FROM v_lines))",
    "v_lines"))
def q_all_splits(spark, sf):
    lines = fx.v_lines(spark, sf).select("seq_id", F.split("line", " ").alias("tokens"))
    return sequences.all_splits(lines, "tokens", ("seq_id",)).select("seq_id", F.col("split_idx").cast("int"),
                                                                     "target")


_CONT_SQL = f"""
SELECT seq_id, fen, t, i, t[i + 1] AS target, list_slice(t, i + 1, i + 6) AS win
FROM (SELECT seq_id, fen, t, CAST({h32('42:0', 'seq_id')} % len(t) AS INTEGER) AS i
      FROM (SELECT seq_id, fen, string_split(line, ' ') AS t FROM v_lines))
"""


@register("continuation", with_views(
    f"SELECT seq_id, target, array_to_string(win, ' ') AS window FROM ({_CONT_SQL})", "v_lines"))
def q_continuation(spark, sf):
    s = _lines_split(spark, sf)
    c = sequences.continuation(F.col("tokens"), F.col("split_idx"), 6)
    return s.select("seq_id", c["target"].alias("target"), F.array_join(c["window"], " ").alias("window"))


@register("role_assign", with_views(
    f"SELECT seq_id, CAST({h32('role42', 'seq_id')} % 2 AS INTEGER) AS assistant_side FROM v_lines", "v_lines"))
def q_role_assign(spark, sf):
    return fx.v_lines(spark, sf).select("seq_id", sampling.fair_coin("seq_id", 42).alias("assistant_side"))


# ---- F1/F2/F4 over documents ------------------------------------------------------------------

@register("sample_n", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)) LIMIT 100")
def q_sample_n(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.sample_n(d, 100, "doc_id", 42)


@register("sample_n_large", "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)) "
                            "LIMIT (SELECT CAST(ceil(count(*) * 0.6) AS BIGINT) FROM documents)")
def q_sample_n_large(spark, sf):
    """F1 at 60 % of the table."""
    d = fx.table(spark, sf, "documents").select("doc_id", "lang")
    n = int(math.ceil(d.count() * 0.6))
    return sampling.sample_n(d, n, "doc_id", 7)


@register("split_exact", """
SELECT doc_id, CASE WHEN rn <= (SELECT CAST(ceil(0.01 * count(*)) AS BIGINT) FROM documents) THEN 'test' ELSE 'train' END
       AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn FROM documents)
""")
def q_split_exact(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    train, test = sampling.split_exact(d, 0.01, "doc_id", 42)
    return train.select("doc_id", F.lit("train").alias("split")).unionByName(
        test.select("doc_id", F.lit("test").alias("split")))


@register("split_hash", f"""
SELECT doc_id, CASE WHEN {h32('42', 'doc_id')} / 4294967296.0 < 0.01 THEN 'test' ELSE 'train' END AS split
FROM documents
""")
def q_split_hash(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    train, test = sampling.split_hash(d, 0.01, "doc_id", 42)
    return train.select("doc_id", F.lit("train").alias("split")).unionByName(
        test.select("doc_id", F.lit("test").alias("split")))


@register("pick_k", with_views(
    "SELECT completion_id, completion FROM v_comp ORDER BY md5('42:' || CAST(completion_id AS VARCHAR)) LIMIT 3",
    "v_comp"))
def q_pick_k(spark, sf):
    c = fx.v_comp(spark, sf).select("completion_id", "completion")
    return sampling.pick_k(c, 3, "completion_id", 42)
