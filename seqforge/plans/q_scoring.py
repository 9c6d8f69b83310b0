"""Queries over completions (V-COMP) and the value table (V-VAL): parsing and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.functions import rewards as R
from seqforge.functions.tags import extract_move, extract_rationale, parse_joint
from seqforge.functions.text import joined
from seqforge.operators import scoring
from seqforge.plans import fixtures as fx
from seqforge.plans.catalog import register
from seqforge.plans.fixtures_sql import with_views

# DuckDB forms of the parsing rules (RE2 has the same lazy/leftmost-first semantics for these).
RAT_RE = r"(?s)<rationale>\s*(.+?)\s*</rationale>"
MOVE_RE = r"(?s)<uci_move>\s*(.+?)\s*</uci_move>"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def extract_sql(col: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '{pattern}') THEN {strip_sql(f'regexp_extract({col}, {chr(39)}{pattern}{chr(39)}, 1)')} END"


def D(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


RAT_SQL = extract_sql("completion", RAT_RE)
MOVE_SQL = extract_sql("completion", MOVE_RE)
WS_COUNT = r"len(list_filter(regexp_split_to_array(completion, '\s+'), lambda x: x <> ''))"

# Per-completion parsed columns, shared by the reward oracles.
PARSED = f"""
SELECT *, {RAT_SQL} AS rat, {MOVE_SQL} AS mv FROM v_comp
"""
SENT = r"len(list_filter(string_split(rat, '.'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> ''))"
R_COMBINED = f"CASE WHEN rat IS NOT NULL AND mv IS NOT NULL THEN {D(2.0)} ELSE {D(-1.0)} END"
R_PENALTY = f"{D(-0.002)} * {WS_COUNT}"
R_CONCISE = (f"CASE WHEN rat IS NULL THEN {D(-0.5)} WHEN {SENT} = 1 AND length(rat) < 150 THEN {D(1.0)} "
             f"WHEN {SENT} <= 2 AND length(rat) < 200 THEN {D(0.5)} ELSE {D(-0.5)} END")
R_LEGAL = (f"CASE WHEN mv IS NULL OR legal_moves IS NULL THEN {D(-1.0)} "
           f"WHEN coalesce(list_contains(legal_moves, mv), false) THEN {D(1.0)} ELSE {D(-2.0)} END")
R_CORRECT = f"CASE WHEN mv IS NOT NULL AND mv = correct_move THEN {D(3.0)} ELSE {D(-0.5)} END"

FOLD = "CASE WHEN cp IS NOT NULL THEN CAST(cp AS BIGINT) WHEN mate > 0 THEN 10000 - mate WHEN mate IS NOT NULL THEN -10000 - mate END"

def curve_sql(p: str, c: str) -> str:
    loss = f"CAST({c} - {p} AS DOUBLE)"
    return f"""
CASE WHEN {p} IS NULL OR {c} IS NULL THEN {D(-1.0)}
     WHEN abs({c}) >= 9000 THEN (CASE WHEN abs({p}) >= 9000 THEN {D(3.0)}
                                      WHEN {p} * {c} > 0 AND abs({p}) > 200 THEN {D(1.5)} ELSE {D(-1.0)} END)
     WHEN {c} - {p} <= 0 THEN {D(3.0)}
     WHEN {c} - {p} < 25 THEN {D(2.5)}
     WHEN {c} - {p} < 75 THEN {D(2.0)} - ({loss} - 25) / 50 * {D(0.5)}
     WHEN {c} - {p} < 150 THEN {D(1.5)} - ({loss} - 75) / 75 * {D(1.0)}
     WHEN {c} - {p} < 300 THEN {D(0.5)} - ({loss} - 150) / 150 * {D(1.0)}
     ELSE greatest({D(-2.0)}, {D(-0.5)} - ({loss} - 300) / 400) END
"""


QUALITY_SQL = f"""
SELECT x.*, CASE WHEN mv IS NULL THEN {D(-3.0)}
                 WHEN NOT coalesce(list_contains(legal_moves, mv), false) THEN {D(-4.0)}
                 ELSE ({curve_sql('vp.v', 'vc.v')}) END AS r_quality
FROM ({PARSED}) x
LEFT JOIN (SELECT state, action, {FOLD} AS v FROM v_val WHERE depth = 3) vp ON vp.state = x.fen AND vp.action = x.mv
LEFT JOIN (SELECT state, action, {FOLD} AS v FROM v_val WHERE depth = 3) vc ON vc.state = x.fen AND vc.action = x.correct_move
"""


def _comp(spark, sf):
    return fx.v_comp(spark, sf)


@register("extract_rationale", with_views(f"SELECT completion_id, rat AS rationale FROM ({PARSED})", "v_comp"))
def q_extract_rationale(spark, sf):
    return _comp(spark, sf).select("completion_id", extract_rationale("completion").alias("rationale"))


@register("extract_move", with_views(f"SELECT completion_id, mv AS move FROM ({PARSED})", "v_comp"))
def q_extract_move(spark, sf):
    return _comp(spark, sf).select("completion_id", extract_move("completion").alias("move"))


# The strict form without a lookahead: cut at the closing tag; the first piece with an opening tag whose next
# piece begins with the move tag pair gives the text after its last opening tag. Else the loose form.
LOOSE_RE = r"(?s)<rationale>\s*(.+?)\s*</rationale>.*?<uci_move>\s*(.+?)\s*</uci_move>"
NEXT_RE = r"^\s*<uci_move>([^<]+)</uci_move>"
JOINT_SQL = f"""
SELECT completion_id,
       CASE WHEN k IS NOT NULL THEN {strip_sql("list_extract(string_split(t[k], '<rationale>'), -1)")}
            WHEN loose THEN {strip_sql(f"regexp_extract(completion, '{LOOSE_RE}', 1)")} END AS rationale,
       CASE WHEN k IS NOT NULL THEN {strip_sql(f"regexp_extract(t[k + 1], '{NEXT_RE}', 1)")}
            WHEN loose THEN {strip_sql(f"regexp_extract(completion, '{LOOSE_RE}', 2)")} END AS move,
       k IS NOT NULL OR loose AS has_format
FROM (SELECT completion_id, completion, t, regexp_matches(completion, '{LOOSE_RE}') AS loose,
             list_extract(list_filter(range(1, len(t)), lambda i: contains(t[i], '<rationale>') AND regexp_matches(t[i + 1], '{NEXT_RE}')), 1) AS k
      FROM (SELECT *, string_split(completion, '</rationale>') AS t FROM v_comp))
"""


@register("parse_joint", with_views(JOINT_SQL, "v_comp"))
def q_parse_joint(spark, sf):
    """X3."""
    p = parse_joint("completion")
    return _comp(spark, sf).select("completion_id", p["rationale"].alias("rationale"), p["move"].alias("move"),
                                   p["has_format"].alias("has_format"))


@register("r_format", with_views(f"SELECT completion_id, CASE WHEN has_format THEN {D(1.0)} ELSE {D(0.0)} END AS reward FROM ({JOINT_SQL})",
                                 "v_comp"))
def q_r_format(spark, sf):
    return _comp(spark, sf).select("completion_id", R.r_format("completion").alias("reward"))


def _reward_query(name: str, sql_expr: str, builder):
    @register(name, with_views(f"SELECT completion_id, {sql_expr} AS reward FROM ({PARSED})", "v_comp"))
    def q(spark, sf):
        c = _comp(spark, sf)
        return c.select("completion_id", builder(c).alias("reward"))
    return q


_reward_query("r_combined_format", R_COMBINED, lambda c: R.r_combined_format("completion"))
_reward_query("r_rationale_present", f"CASE WHEN rat IS NOT NULL THEN {D(1.0)} ELSE {D(0.0)} END",
              lambda c: R.r_rationale_present("completion"))
_reward_query("r_move_present", f"CASE WHEN mv IS NOT NULL THEN {D(1.0)} ELSE {D(0.0)} END",
              lambda c: R.r_move_present("completion"))
_reward_query("r_token_penalty", R_PENALTY, lambda c: R.r_token_penalty("completion"))
_reward_query("r_conciseness", R_CONCISE, lambda c: R.r_conciseness("completion"))
_reward_query("r_legality", R_LEGAL, lambda c: R.r_legality("completion", "legal_moves"))
_reward_query("r_correct", R_CORRECT, lambda c: R.r_correct("completion", "correct_move"))


@register("fold_mate", with_views(f"SELECT state, action, {FOLD} AS value FROM v_val", "v_val"))
def q_fold_mate(spark, sf):
    v = fx.v_val(spark, sf)
    return v.select("state", "action", R.fold_mate("cp", "mate").alias("value"))


@register("lookup_values", with_views(f"""
SELECT x.completion_id, vp.v AS cp_pred, vc.v AS cp_ref
FROM ({PARSED}) x
LEFT JOIN (SELECT state, action, {FOLD} AS v FROM v_val WHERE depth = 3) vp ON vp.state = x.fen AND vp.action = x.mv
LEFT JOIN (SELECT state, action, {FOLD} AS v FROM v_val WHERE depth = 3) vc ON vc.state = x.fen AND vc.action = x.correct_move
""", "v_comp", "v_val"))
def q_lookup_values(spark, sf):
    c = _comp(spark, sf).withColumn("move", extract_move("completion"))
    return scoring.lookup_values(c, fx.v_val(spark, sf)).select("completion_id", "cp_pred", "cp_ref")


@register("r_quality", with_views(f"SELECT completion_id, r_quality FROM ({QUALITY_SQL})", "v_comp", "v_val"))
def q_r_quality(spark, sf):
    q = scoring.quality_reward(_comp(spark, sf), fx.v_val(spark, sf))
    return q.select("completion_id", "r_quality")


def _weighted_sql() -> str:
    cols = {"combined_format": R_COMBINED, "token_penalty": R_PENALTY, "rationale_length": R_CONCISE,
            "legality": R_LEGAL, "stockfish_eval": "r_quality"}
    sel = ", ".join(f"CAST({cols[n]} AS DOUBLE) * {D(w)} AS {R.column_name(n, w)}" for n, w in fixed.REWARD_MIX)
    return f"SELECT completion_id, prompt_id, {sel} FROM ({QUALITY_SQL})"


_TOTAL = " + ".join(R.column_name(n, w) for n, w in fixed.REWARD_MIX)


def _scored(spark, sf):
    q = scoring.quality_reward(_comp(spark, sf), fx.v_val(spark, sf))
    return scoring.total_reward(scoring.scaled_rewards(q))


@register("scaled_rewards", with_views(_weighted_sql(), "v_comp", "v_val"))
def q_scaled_rewards(spark, sf):
    s = _scored(spark, sf)
    return s.select("completion_id", "prompt_id", *[R.column_name(n, w) for n, w in fixed.REWARD_MIX])


@register("total_reward", with_views(f"SELECT completion_id, {_TOTAL} AS total_reward FROM ({_weighted_sql()})",
                                     "v_comp", "v_val"))
def q_total_reward(spark, sf):
    return _scored(spark, sf).select("completion_id", "total_reward")


@register("group_advantage", with_views(f"""
SELECT completion_id, prompt_id,
       round(CASE WHEN sd IS NULL OR isnan(sd) THEN 0.0 ELSE (t - mu) / (sd + {D(fixed.ADVANTAGE_EPS)}) END, 6) + {D(0.0)} AS advantage
FROM (SELECT completion_id, prompt_id, t, avg(t) OVER (PARTITION BY prompt_id) AS mu,
             stddev_samp(t) OVER (PARTITION BY prompt_id) AS sd
      FROM (SELECT completion_id, prompt_id, {_TOTAL} AS t FROM ({_weighted_sql()})))
""", "v_comp", "v_val"))
def q_group_advantage(spark, sf):
    g = scoring.group_advantage(_scored(spark, sf))
    return g.select("completion_id", "prompt_id", F.round("advantage", 6).alias("advantage"))


@register("reward_report", with_views(
    "SELECT metric, round(avg(reward), 9) AS mean_reward, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{R.metric_name(n, w)}' AS metric, {R.column_name(n, w)} AS reward FROM ({_weighted_sql()})"
                         for n, w in fixed.REWARD_MIX)
    + ") GROUP BY metric", "v_comp", "v_val"))
def q_reward_report(spark, sf):
    r = scoring.reward_report(_scored(spark, sf).drop("completion"))
    return r.select("metric", F.round("mean_reward", 9).alias("mean_reward"), "n")


@register("align_columns", with_views(
    "SELECT completion_id, completion, correct_move, array_to_string(legal_moves, ' ') AS legal_moves, fen FROM v_comp",
    "v_comp"))
def q_align_columns(spark, sf):
    c = _comp(spark, sf)
    comps = c.select("completion_id", "completion")
    cols = c.select("completion_id", "correct_move", "legal_moves", "fen")
    a = scoring.align_columns(comps, cols)
    return a.select("completion_id", "completion", "correct_move", joined("legal_moves").alias("legal_moves"), "fen")


@register("validation_report", with_views(
    "SELECT count(*) AS n, count_if(coalesce(list_contains(legal_moves, mv), false)) AS n_move_legal, "
    f"count_if(rat IS NOT NULL) AS n_has_rationale, count_if(mv IS NOT NULL) AS n_has_move FROM ({PARSED})", "v_comp"))
def q_validation_report(spark, sf):
    return scoring.validation_report(_comp(spark, sf))
