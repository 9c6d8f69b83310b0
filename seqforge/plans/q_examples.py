"""End-to-end example queries (lifecycles L2, L3) over action sequences and the rules table.

The oracles follow the order of steps of the task: valid prefix first, sequences with fewer than two valid
steps dropped, then the split point in what is left.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.functions.text import joined
from seqforge.operators import examples, tokens
from seqforge.plans import fixtures as fx
from seqforge.plans.catalog import register
from seqforge.plans.fixtures_sql import h32, lit
from seqforge.plans.fixtures_sql import with_views
from seqforge.plans.q_sequences import _WALK, _walk_sql, game_rows_sql
from seqforge.plans.q_text import _encode_sql, _marker_ids, render_sql, vocab_sql
from seqforge.session import stored

CM_S, CM_E = fixed.CHATML_START, fixed.CHATML_END
SFT_L = 512
CONV_L = 128      # shorter than most conversations, so that rows are truncated

_VALID = """
SELECT s.seq_id, s.start_side, list_slice(s.actions, 1, v.valid_len) AS actions, v.valid_len
FROM v_seq s JOIN (SELECT seq_id, max(pos) AS valid_len FROM walk GROUP BY seq_id) v ON v.seq_id = s.seq_id
WHERE v.valid_len >= 2
"""

# Position at the split point: (seq_id, i, actions, state, cands, side).
_POS_SQL = f"""
SELECT sp.seq_id, sp.i, sp.actions, w.state, coalesce(c.c, []::VARCHAR[]) AS cands,
       CASE WHEN (sp.start_side = 'w') <> (sp.i % 2 = 1) THEN 'White' ELSE 'Black' END AS side
FROM (SELECT *, CAST({h32('42:0', 'seq_id')} % valid_len AS INTEGER) AS i FROM ({_VALID})) sp
JOIN walk w ON w.seq_id = sp.seq_id AND w.pos = sp.i
LEFT JOIN (SELECT state, list_sort(list_distinct(list(action))) AS c FROM v_rules GROUP BY state) c ON c.state = w.state
"""


def _lines(spark, sf):
    return examples.valid_lines(fx.v_seq(spark, sf), fx.v_rules(spark, sf))


@register("line_split", _walk_sql(f"""
SELECT * FROM (WITH s AS (SELECT seq_id, row_number() OVER (ORDER BY md5('42:' || CAST(seq_id AS VARCHAR))) AS rn FROM ({_VALID})),
n AS (SELECT least(count(*), 300) AS n FROM s)
SELECT seq_id, CASE WHEN rn <= ceil(n * 0.01::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM s, n WHERE rn <= n)
"""))
def q_line_split(spark, sf):
    """L2/L3: sample and train/test split of the valid lines."""
    train, test = examples.sample_and_split(_lines(spark, sf).select("seq_id"), 300, 0.01)
    return train.select("seq_id", F.lit("train").alias("split")).unionByName(test.select("seq_id", F.lit("test").alias("split")))


def _chat_user_sql(content: str, gen: bool = True) -> str:
    head = lit(f"{CM_S}system\n{fixed.DEFAULT_SYSTEM}{CM_E}\n{CM_S}user\n")
    tail = lit(f"{CM_E}\n" + (f"{CM_S}assistant\n" if gen else ""))
    return f"{head} || {content} || {tail}"


def _prompt_sql(template: str) -> str:
    return render_sql(template, FEN="CAST(state AS VARCHAR)", side_to_move="side",
                      legal_moves_uci="array_to_string(cands, ' ')")


@register("grpo_prompts", _walk_sql(f"""
SELECT seq_id, {_chat_user_sql(_prompt_sql(fixed.PROMPT_BEST_MOVE))} AS prompt, actions[i + 1] AS correct_move,
       array_to_string(cands, ' ') AS legal_moves, CAST(state AS VARCHAR) AS fen
FROM ({_POS_SQL})
"""))
def q_grpo_prompts(spark, sf):
    r = examples.prompt_rows(_lines(spark, sf))
    return r.select("seq_id", "prompt", "correct_move", joined("legal_moves").alias("legal_moves"), "fen")


def _ids(col: str) -> str:
    return f"array_to_string({col}, ',')"


def _single_sql() -> str:
    L, pad = SFT_L, tokens.PAD_ID
    src = (f"SELECT seq_id, {_chat_user_sql(_prompt_sql(fixed.PROMPT_PV_LINE))} AS ptext, "
           f"'<rationale>' || array_to_string(list_slice(actions, i + 1, i + 6), ' ') || '</rationale><uci_move>' "
           f"|| actions[i + 1] || '</uci_move>' AS response FROM ({_POS_SQL})")
    body = f"""
SELECT seq_id, {_ids('ids')} AS input_ids, {_ids('mask')} AS attention_mask,
       {_ids(f"list_transform(ids, lambda x, j: CASE WHEN j - 1 >= len(p) AND j - 1 < len(p) + len(r) AND x <> {pad} THEN x ELSE -100 END)")} AS labels
FROM (
  SELECT seq_id, p, r,
         list_concat(list_concat(p, r), list_transform(range(greatest({L} - len(p) - len(r), 0)), lambda x: {pad})) AS ids,
         list_concat(list_transform(range(len(p) + len(r)), lambda x: 1),
                     list_transform(range(greatest({L} - len(p) - len(r), 0)), lambda x: 0)) AS mask
  FROM (
    SELECT seq_id,
           CASE WHEN len(p0) + len(r0) <= {L} THEN p0 WHEN {L} - len(r0) < 0 THEN []::INTEGER[]
                ELSE list_slice(p0, 1, {L} - len(r0)) END AS p,
           CASE WHEN len(p0) + len(r0) > {L} AND {L} - len(r0) < 0 THEN list_slice(r0, 1, {L}) ELSE r0 END AS r
    FROM (SELECT a.seq_id, a.ids AS p0, list_concat(b.ids, [{tokens.EOS_ID}]) AS r0
          FROM ({_encode_sql('SELECT * FROM src', 'seq_id', 'ptext')}) a
          JOIN ({_encode_sql('SELECT * FROM src', 'seq_id', 'response')}) b ON a.seq_id = b.seq_id)))
"""
    words = vocab_sql("SELECT ptext AS text FROM src UNION ALL SELECT response FROM src")
    return with_views(body, "v_seq", "v_seq_long", "v_rules",
                      extra={"walk": _WALK, "src": src, "vocab": words}, recursive=True)


@register("sft_single_rows", _single_sql())
def q_sft_single_rows(spark, sf):
    ex = stored(examples.single_move_texts(_lines(spark, sf)), "single-move")
    vocab = tokens.build_vocab(ex.select(F.col("ptext").alias("text")).unionByName(ex.select(F.col("response").alias("text"))))
    r = examples.single_move_rows(ex, vocab, SFT_L)
    return r.select("seq_id", joined("input_ids", ",").alias("input_ids"),
                    joined("attention_mask", ",").alias("attention_mask"), joined("labels", ",").alias("labels"))


def _conversation_sql() -> str:
    L, pad = CONV_L, tokens.PAD_ID
    text = f"""
SELECT seq_id,
       {lit(CM_S + 'system' + chr(10))} || system_text || {lit(CM_E + chr(10))}
       || coalesce(string_agg(CASE WHEN mine THEN {lit(CM_S + 'user' + chr(10))} || user_text || {lit(CM_E + chr(10) + CM_S + 'assistant' + chr(10) + '<uci_move>')}
                                   || action || {lit('</uci_move>' + CM_E + chr(10))} END, '' ORDER BY k), '') AS text
FROM ({game_rows_sql()})
GROUP BY seq_id, system_text
HAVING count_if(mine) > 0
"""
    body = f"""
SELECT s.seq_id,
       CASE WHEN e.ids IS NULL THEN {_ids(f'list_transform(range({L}), lambda x: {pad})')} ELSE {_ids('e.ids')} END AS input_ids,
       CASE WHEN e.ids IS NULL THEN 0 ELSE e.n END AS n_attended,
       CASE WHEN e.ids IS NULL THEN {_ids(f'list_transform(range({L}), lambda x: -100)')} ELSE {_ids('e.labels')} END AS labels
FROM v_seq s LEFT JOIN (
  SELECT seq_id, x AS ids, n,
         list_transform(x, lambda v, j: CASE WHEN len(list_filter(spans, lambda sp: j - 1 >= sp[1] AND j - 1 < sp[2])) > 0
                                             THEN v ELSE -100 END) AS labels
  FROM (
    SELECT seq_id, x, n, list_transform(range(len(occ) // 2), lambda q: [occ[2 * q + 1] - 1, occ[2 * q + 2] + 2]) AS spans
    FROM (SELECT seq_id, x, n, list_filter(range(len(x)), lambda j: x[j + 1] = mk.uci) AS occ
          FROM (SELECT seq_id, list_concat(list_slice(ids, 1, {L}), list_transform(range(greatest({L} - len(ids), 0)), lambda q: {pad})) AS x,
                       least(len(ids), {L}) AS n
                FROM ({_encode_sql('SELECT * FROM conv', 'seq_id', 'text')})),
               (SELECT id AS uci FROM vocab WHERE token = 'uci_move') mk))) e ON e.seq_id = s.seq_id
"""
    return with_views(body, "v_seq", "v_seq_long", "v_rules",
                      extra={"walk": _WALK, "conv": text, "vocab": vocab_sql("SELECT text FROM conv")}, recursive=True)


@register("sft_conversation_rows", _conversation_sql())
def q_sft_conversation_rows(spark, sf):
    texts = stored(examples.conversation_texts(fx.v_seq(spark, sf), fx.v_rules(spark, sf)), "conversations")
    vocab = tokens.build_vocab(texts.where("ok").select("text"))
    marker = _marker_ids(vocab, ["uci_move"]).scalar()
    r = examples.conversation_rows(texts, vocab, marker, CONV_L)
    return r.select("seq_id", joined("input_ids", ",").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_attended"),
                    joined("labels", ",").alias("labels"))
