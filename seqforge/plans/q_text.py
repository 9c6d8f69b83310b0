"""Queries over conversations (chat renders), lines (prompts) and token arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.functions.text import hash32, joined, let
from seqforge.operators import chat, prompts, sequences, subwords, tokens
from seqforge.operators.project import side_label
from seqforge.plans import fixtures as fx
from seqforge.plans.catalog import register
from seqforge.plans.fixtures_sql import h32, lit, with_views
from seqforge.plans.q_scoring import MOVE_SQL
from seqforge.session import stored

NL = "chr(10)"

# ---- chat renders over the conversations table ----------------------------------------------

# Per-turn base rows: first role/text of the conversation and the loop index after a leading system turn.
_BASE = """
SELECT conv_id, turn, role, text, first_role, first_text,
       NOT (first_role = 'system' AND rn = 1) AS is_loop,
       rn - 1 - (CASE WHEN first_role = 'system' THEN 1 ELSE 0 END) AS idx
FROM (SELECT conv_id, turn, role, text,
             first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first_role,
             first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS first_text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
      FROM conversations)
"""
KNOWN = "('system', 'user', 'assistant')"


def _agg(piece: str) -> str:
    return f"coalesce(string_agg({piece}, '' ORDER BY turn), '')"


def chatml_sql(gen: bool) -> str:
    hdr = lit(f"{fixed.CHATML_START}system\n{fixed.DEFAULT_SYSTEM}{fixed.CHATML_END}\n")
    piece = (f"CASE WHEN role IN {KNOWN} THEN '{fixed.CHATML_START}' || role || {NL} || text || "
             f"'{fixed.CHATML_END}' || {NL} ELSE '' END")
    g = lit(f"{fixed.CHATML_START}assistant\n") if gen else "''"
    return f"CASE WHEN min(first_role) = 'system' THEN '' ELSE {hdr} END || {_agg(piece)} || {g}"


def gemma_sql(gen: bool) -> str:
    prefix = f"CASE WHEN first_role = 'system' THEN first_text || {NL} ELSE {lit(fixed.DEFAULT_SYSTEM + chr(10))} END"
    role = "CASE WHEN role = 'assistant' THEN 'model' ELSE role END"
    strip = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
    piece = (f"CASE WHEN is_loop THEN '{fixed.GEMMA_START}' || {role} || {NL} || "
             f"(CASE WHEN idx = 0 THEN {prefix} ELSE '' END) || {strip} || '{fixed.GEMMA_END}' || {NL} END")
    g = lit(f"{fixed.GEMMA_START}model\n") if gen else "''"
    ok = "bool_and(CASE WHEN is_loop THEN (role = 'user') = (idx % 2 = 0) ELSE true END)"
    return f"CASE WHEN {ok} THEN '{fixed.GEMMA_BOS}' || {_agg(piece)} || {g} END"


def llama_sql(gen: bool) -> str:
    h0, h1 = fixed.LLAMA_HEADER_START, fixed.LLAMA_HEADER_END
    sys_text = "max(CASE WHEN NOT is_loop THEN text END)"
    sys_block = (f"CASE WHEN coalesce({sys_text}, '') <> '' THEN {lit(h0 + 'system' + h1 + chr(10) * 2)} || {sys_text} "
                 f"|| '{fixed.LLAMA_EOT}' ELSE '' END")
    piece = f"CASE WHEN is_loop THEN '{h0}' || role || '{h1}' || {NL} || {NL} || text || '{fixed.LLAMA_EOT}' END"
    g = lit(f"{h0}assistant{h1}\n\n") if gen else "''"
    return f"'{fixed.LLAMA_BOS}' || {sys_block} || {_agg(piece)} || {g}"


def granite_sql(gen: bool) -> str:
    s, e, t = fixed.GRANITE_ROLE_START, fixed.GRANITE_ROLE_END, fixed.GRANITE_END
    piece = f"CASE WHEN role IN {KNOWN} THEN '{s}' || role || '{e}' || text || '{t}' || {NL} ELSE '' END"
    g = lit(f"{s}assistant{e}") if gen else "''"
    return f"{_agg(piece)} || {g}"


def generic_sql(gen: bool, bos: str = "", eos: str = "") -> str:
    piece = f"{lit(bos)} || role || ': ' || text || {lit(eos)} || {NL}"
    g = lit(f"{bos}assistant: ") if gen else "''"
    return f"{_agg(piece)} || {g}"


def _render_sql(expr: str) -> str:
    return f"SELECT conv_id, {expr} AS text FROM ({_BASE}) GROUP BY conv_id"


def _msgs(spark, sf):
    return chat.collect_messages(fx.table(spark, sf, "conversations"))


# Conversations that lost a turn here and there, so that some do not alternate.
_GAPS = f"{h32('gap', 'conv_id * 1000 + turn')} % 9 <> 0"


def _gap_msgs(spark, sf):
    kept = hash32("gap", F.col("conv_id") * 1000 + F.col("turn")) % 9 != 0
    return chat.collect_messages(fx.table(spark, sf, "conversations").where(kept))


def _with_gaps(sql: str) -> str:
    return sql.replace("FROM conversations", f"FROM (SELECT * FROM conversations WHERE {_GAPS})")


def _render_query(name: str, sql: str, fn, gaps: bool = False):
    @register(name, _with_gaps(sql) if gaps else sql)
    def q(spark, sf):
        m = _gap_msgs(spark, sf) if gaps else _msgs(spark, sf)
        return m.select("conv_id", fn(F.col("messages")).alias("text"))
    return q


_render_query("chat_chatml", _render_sql(chatml_sql(False)), lambda m: chat.render_chatml(m))
_render_query("chat_genprompt", _render_sql(chatml_sql(True)), lambda m: chat.render_chatml(m, True))
_render_query("chat_turns", _render_sql(gemma_sql(False)), lambda m: chat.render_gemma(m), gaps=True)
_render_query("chat_turns_genprompt", _render_sql(gemma_sql(True)), lambda m: chat.render_gemma(m, True))
_render_query("chat_header", _render_sql(llama_sql(False)), lambda m: chat.render_llama(m))
_render_query("chat_header_genprompt", _render_sql(llama_sql(True)), lambda m: chat.render_llama(m, True))
_render_query("chat_role", _render_sql(granite_sql(False)), lambda m: chat.render_granite(m))
_render_query("chat_role_genprompt", _render_sql(granite_sql(True)), lambda m: chat.render_granite(m, True))
_render_query("chat_generic", _render_sql(generic_sql(False, "<s>", "</s>")),
              lambda m: chat.render_generic(m, False, "<s>", "</s>"))
_render_query("chat_generic_genprompt", _render_sql(generic_sql(True)), lambda m: chat.render_generic(m, True))


@register("messages_text", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text "
                           "FROM conversations GROUP BY conv_id")
def q_messages_text(spark, sf):
    return _msgs(spark, sf).select("conv_id", chat.messages_text("messages").alias("text"))


@register("alternation_violations",
          _with_gaps(f"SELECT conv_id, turn FROM ({_BASE}) WHERE is_loop AND (role = 'user') <> (idx % 2 = 0)"))
def q_alternation_violations(spark, sf):
    return chat.alternation_violations(_gap_msgs(spark, sf))


# FIXED VALUES: model descriptors assigned to conversations for the template-choice query
# (name, special tokens, model type or None): one per family by name and token, one by name only, one by
# token only, one mistral, one unknown, two whose type differs from the name.
MODELS = [
    ("Qwen/Qwen2.5-0.5B-Instruct", ["<|im_start|>", "<|im_end|>"], None),
    ("google/gemma-2-2b-it", ["<bos>", "<start_of_turn>"], None),
    ("meta-llama/Llama-3.2-1B-Instruct", ["<|begin_of_text|>", "<|start_header_id|>"], None),
    ("ibm-granite/granite-3.1-2b-instruct", ["<|start_of_role|>"], None),
    ("acme/qwen-distilled", [], None),
    ("acme/chat-small", ["<|im_start|>"], None),
    ("mistralai/Mistral-7B-Instruct-v0.3", ["<s>", "</s>"], None),
    ("acme/base-model", ["<s>", "</s>"], None),
    ("acme/llama-copy", [], "Gemma"),
    ("acme/qwen-next", [], "qwen2"),
]


def _family_py(name: str, toks: list[str], kind: str | None) -> str:
    n = name.lower()
    by_name = kind.lower() if kind else next((f for f in fixed.FAMILY_NAME_ORDER if f in n), None)
    for fam, marker, hit in fixed.FAMILY_TOKEN_CHECKS:
        if marker in toks or by_name == hit:
            return fam
    return "generic"


def _template_choice_sql() -> str:
    pick = f"{h32('model', 'conv_id')} % {len(MODELS)}"
    name_case = "CASE " + " ".join(f"WHEN {pick} = {i} THEN {lit(m)}" for i, (m, _, _) in enumerate(MODELS)) + " END"
    fam_case = "CASE " + " ".join(f"WHEN {pick} = {i} THEN '{_family_py(m, t, k)}'" for i, (m, t, k) in enumerate(MODELS)) + " END"
    render = (f"CASE fam WHEN 'chatml' THEN {chatml_sql(False)} WHEN 'gemma' THEN {gemma_sql(False)} "
              f"WHEN 'llama' THEN {llama_sql(False)} WHEN 'granite' THEN {granite_sql(False)} "
              f"ELSE {generic_sql(False)} END")
    return (f"SELECT conv_id, model, fam AS family, {render} AS text FROM "
            f"(SELECT *, {name_case} AS model, {fam_case} AS fam FROM ({_BASE})) GROUP BY conv_id, model, fam")


@register("template_choice", _template_choice_sql())
def q_template_choice(spark, sf):
    """Each conversation is assigned one of the model descriptors; the family is chosen from
    the name and marker tokens, and the conversation is rendered with it (per-row template)."""
    m = _msgs(spark, sf)
    idx = (F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("model:"), F.col("conv_id").cast("string"))), 1, 8), 16, 10)
                  .cast("bigint"), F.lit(len(MODELS))) + 1).cast("int")
    names = F.array(*[F.lit(n) for n, _, _ in MODELS])
    toks = F.array(*[F.array(*[F.lit(t) for t in ts]).cast("array<string>") for _, ts, _ in MODELS])
    kinds = F.array(*[F.lit(k).cast("string") for _, _, k in MODELS])
    m = m.select("conv_id", "messages", F.element_at(names, idx).alias("model"),
                 F.element_at(toks, idx).alias("special_tokens"), F.element_at(kinds, idx).alias("model_type"))
    fam = chat.template_family("model", "special_tokens", model_type=F.col("model_type"))
    return m.select("conv_id", "model", fam.alias("family"),
                    chat.render_family(fam, "messages").alias("text"))


# ---- prompts over lines (G1-G4, G16, P7) ----------------------------------------------------

def _line_prompt_rows(spark, sf):
    lines = fx.v_lines(spark, sf)

    def parts(t):   # the split text is bound once
        i = sequences.split_point("seq_id", F.size(t), 42, 0)
        c = sequences.continuation(t, i, 6)
        return F.struct(i.alias("i"), c["target"].alias("target"), c["window"].alias("window"))

    p = lines.select("seq_id", "fen", let(F.split("line", " "), parts).alias("p"))
    side = side_label(F.get(F.split("fen", " "), 1), F.col("p.i"))
    return p.select("seq_id", "fen", side.alias("side"), "p.target", "p.window",
                    F.array_sort(F.array_distinct("p.window")).alias("candidates"))


_LP_SQL = f"""
SELECT seq_id, fen, target, win, list_sort(list_distinct(win)) AS cands,
       CASE WHEN (split_part(fen, ' ', 2) = 'w') <> (i % 2 = 1) THEN 'White' ELSE 'Black' END AS side
FROM (SELECT seq_id, fen, t, i, t[i + 1] AS target, list_slice(t, i + 1, i + 6) AS win
      FROM (SELECT seq_id, fen, t, CAST({h32('42:0', 'seq_id')} % len(t) AS INTEGER) AS i
            FROM (SELECT seq_id, fen, string_split(line, ' ') AS t FROM v_lines)))
"""


def render_sql(template: str, **slots: str) -> str:
    out = []
    for literal, field in prompts.template_pieces(template):
        if literal:
            out.append(lit(literal))
        if field is not None:
            out.append(slots[field])
    return " || ".join(out)


def _prompt_sql(template: str) -> str:
    return render_sql(template, FEN="fen", side_to_move="side", legal_moves_uci="array_to_string(cands, ' ')")


@register("render_prompt", with_views(f"SELECT seq_id, {_prompt_sql(fixed.PROMPT_BEST_MOVE)} AS prompt FROM ({_LP_SQL})",
                                      "v_lines"))
def q_render_prompt(spark, sf):
    r = _line_prompt_rows(spark, sf)
    return r.select("seq_id", prompts.render_prompt("fen", "side", "candidates").alias("prompt"))


@register("render_prompt_variant", with_views(
    f"SELECT seq_id, {_prompt_sql(fixed.PROMPT_PV_LINE)} AS prompt FROM ({_LP_SQL})", "v_lines"))
def q_render_prompt_variant(spark, sf):
    r = _line_prompt_rows(spark, sf)
    return r.select("seq_id", prompts.render_prompt_variant("fen", "side", "candidates").alias("prompt"))


@register("render_response", with_views(
    f"SELECT seq_id, '<rationale>' || array_to_string(win, ' ') || '</rationale><uci_move>' || target || '</uci_move>' "
    f"AS response FROM ({_LP_SQL})", "v_lines"))
def q_render_response(spark, sf):
    r = _line_prompt_rows(spark, sf)
    return r.select("seq_id", prompts.render_response("window", "target").alias("response"))


_CHAT_SINGLE = (lit(f"{fixed.CHATML_START}system\n{fixed.DEFAULT_SYSTEM}{fixed.CHATML_END}\n{fixed.CHATML_START}user\n")
                + f" || {_prompt_sql(fixed.PROMPT_BEST_MOVE)} || "
                + lit(f"{fixed.CHATML_END}\n{fixed.CHATML_START}assistant\n"))


@register("chat_single", with_views(f"SELECT seq_id, {_CHAT_SINGLE} AS prompt FROM ({_LP_SQL})", "v_lines"))
def q_chat_single(spark, sf):
    r = _line_prompt_rows(spark, sf)
    p = prompts.render_prompt("fen", "side", "candidates")
    return r.select("seq_id", chat.render_chatml(prompts.user_message(p), True).alias("prompt"))


@register("drop_null_prompt", with_views(
    f"SELECT seq_id FROM ({_LP_SQL}) WHERE {_prompt_sql(fixed.PROMPT_BEST_MOVE)} IS NOT NULL AND target IS NOT NULL "
    f"AND {h32('np', 'seq_id')} % 9 <> 0", "v_lines"))
def q_drop_null_prompt(spark, sf):
    """P7 where some positions are missing (every ninth or so), so their render fails."""
    r = _line_prompt_rows(spark, sf)
    fen = F.when(hash32("np", F.col("seq_id")) % 9 != 0, F.col("fen"))
    p = F.when(F.col("target").isNotNull(), prompts.render_prompt(fen, "side", "candidates"))
    return prompts.drop_null_prompt(r.select("seq_id", p.alias("prompt"))).select("seq_id")


@register("plain_example", with_views(
    f"SELECT seq_id, {render_sql(fixed.PLAIN_EXAMPLE, fen='fen', side='side', moves=chr(32).join(['array_to_string(cands,', chr(39) + chr(32) + chr(39) + ')']))} "
    f"AS example FROM ({_LP_SQL})", "v_lines"))
def q_plain_example(spark, sf):
    r = _line_prompt_rows(spark, sf)
    return r.select("seq_id", prompts.plain_example("fen", "side", "candidates").alias("example"))


# ---- tokens (T1-T8) ---------------------------------------------------------------------------

TOK_RE_SQL = "[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]".replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def _corpus(spark, sf):
    d = fx.table(spark, sf, "documents").select("text")
    c = fx.v_comp(spark, sf).select(F.col("completion").alias("text"))
    return d.unionByName(c)


def _vocab(spark, sf):
    """The corpus vocabulary, written once for the query: it is read several times."""
    return stored(tokens.build_vocab(_corpus(spark, sf)), "vocabulary")


def vocab_sql(texts: str) -> str:
    return f"""
SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 3 AS INTEGER) AS id
FROM (SELECT token, count(*) AS cnt FROM (
        SELECT unnest(regexp_extract_all(text, '{TOK_RE_SQL}')) AS token FROM ({texts}))
      GROUP BY token)
"""


_VOCAB_SQL = vocab_sql("SELECT text FROM documents UNION ALL SELECT completion AS text FROM v_comp")


@register("build_vocab", with_views(_VOCAB_SQL, "v_comp"))
def q_build_vocab(spark, sf):
    return tokens.build_vocab(_corpus(spark, sf))


def _encode_sql(src: str, key: str, text: str) -> str:
    """(key, ids[]) via unnest with position + join to the vocabulary, ordered back."""
    return f"""
SELECT s.{key}, coalesce(e.ids, []::INTEGER[]) AS ids FROM ({src}) s LEFT JOIN (
  SELECT {key}, list(coalesce(v.id, 1) ORDER BY p.pos) AS ids
  FROM (SELECT {key}, unnest(t) AS token, unnest(range(len(t))) AS pos
        FROM (SELECT {key}, regexp_extract_all({text}, '{TOK_RE_SQL}') AS t FROM ({src}))) p
  LEFT JOIN vocab v ON v.token = p.token GROUP BY {key}) e ON e.{key} = s.{key}
"""


def _ids_text(col: str) -> str:
    return f"array_to_string({col}, ',')"


@register("encode", with_views(
    f"SELECT pair_id, {_ids_text('ids')} AS ids FROM ({_encode_sql('SELECT * FROM v_tok_pairs', 'pair_id', 'prompt')})",
    "v_comp", "v_tok_pairs", extra={"vocab": _VOCAB_SQL}))
def q_encode(spark, sf):
    vocab = _vocab(spark, sf)
    e = tokens.encode(fx.v_tok_pairs(spark, sf), "prompt", vocab, "pair_id")
    return e.select("pair_id", joined("ids", ",").alias("ids"))


def _sft_single(spark, sf, max_length: int, pad_id: int):
    """Single-turn SFT rows: ChatML(user prompt, generation prompt) ids + response ids + EOS."""
    pairs = fx.v_tok_pairs(spark, sf)
    vocab = _vocab(spark, sf)
    chat_prompt = chat.render_chatml(prompts.user_message(F.col("prompt")), True)
    ex = pairs.select("pair_id", chat_prompt.alias("ptext"), "response")
    enc = tokens.encode_many(ex, "pair_id", {"p_ids": "ptext", "r_ids": "response"}, vocab)
    j = enc.select("pair_id", "p_ids", F.concat("r_ids", F.array(F.lit(tokens.EOS_ID))).alias("r_ids"))
    t = tokens.truncate_reserve("p_ids", "r_ids", max_length)
    j = j.select("pair_id", t["prompt_ids"].alias("p"), t["response_ids"].alias("r"))
    pm = tokens.pad_mask(F.concat("p", "r"), max_length, pad_id)
    j = j.select("pair_id", "p", "r", pm["input_ids"].alias("input_ids"), pm["attention_mask"].alias("attention_mask"))
    return j.withColumn("labels", tokens.label_response("input_ids", F.size("p"), F.size("r"), pad_id))


def _sft_single_sql(max_length: int, pad_id: int) -> str:
    L = max_length
    ptext = lit(f"{fixed.CHATML_START}system\n{fixed.DEFAULT_SYSTEM}{fixed.CHATML_END}\n{fixed.CHATML_START}user\n") + \
        " || prompt || " + lit(f"{fixed.CHATML_END}\n{fixed.CHATML_START}assistant\n")
    src_p = f"SELECT pair_id, {ptext} AS ptext FROM v_tok_pairs"
    return f"""
SELECT pair_id, p, r, ids AS input_ids_l, mask AS attention_mask_l,
       list_transform(ids, lambda x, i: CASE WHEN i - 1 >= len(p) AND i - 1 < len(p) + len(r) AND x <> {pad_id}
                                             THEN x ELSE -100 END) AS labels_l
FROM (
  SELECT pair_id, p, r, list_concat(list_concat(p, r), list_transform(range(greatest({L} - len(p) - len(r), 0)), lambda x: {pad_id})) AS ids,
         list_concat(list_transform(range(len(p) + len(r)), lambda x: 1),
                     list_transform(range(greatest({L} - len(p) - len(r), 0)), lambda x: 0)) AS mask
  FROM (
    SELECT pair_id,
           CASE WHEN len(p0) + len(r0) <= {L} THEN p0 WHEN {L} - len(r0) < 0 THEN []::INTEGER[]
                ELSE list_slice(p0, 1, {L} - len(r0)) END AS p,
           CASE WHEN len(p0) + len(r0) > {L} AND {L} - len(r0) < 0 THEN list_slice(r0, 1, {L}) ELSE r0 END AS r
    FROM (SELECT a.pair_id, a.ids AS p0, list_concat(b.ids, [{tokens.EOS_ID}]) AS r0
          FROM ({_encode_sql(src_p, 'pair_id', 'ptext')}) a
          JOIN ({_encode_sql('SELECT * FROM v_tok_pairs', 'pair_id', 'response')}) b ON a.pair_id = b.pair_id)))
"""


def _sft_query(name: str, max_length: int, pad_id: int):
    sql = with_views(
        f"SELECT pair_id, {_ids_text('p')} AS prompt_ids, {_ids_text('r')} AS response_ids, "
        f"{_ids_text('input_ids_l')} AS input_ids, {_ids_text('attention_mask_l')} AS attention_mask, "
        f"{_ids_text('labels_l')} AS labels FROM ({_sft_single_sql(max_length, pad_id)})",
        "v_comp", "v_tok_pairs", extra={"vocab": _VOCAB_SQL})

    @register(name, sql)
    def q(spark, sf):
        s = _sft_single(spark, sf, max_length, pad_id)
        return s.select("pair_id", joined("p", ",").alias("prompt_ids"), joined("r", ",").alias("response_ids"),
                        joined("input_ids", ",").alias("input_ids"), joined("attention_mask", ",").alias("attention_mask"),
                        joined("labels", ",").alias("labels"))
    return q


_sft_query("truncate_reserve", 32, tokens.PAD_ID)      # T2 (with T3, T4): pad != EOS
_sft_query("pad_mask", 512, tokens.PAD_ID)             # T3: mostly padding at L=512
_sft_query("label_response", 16, tokens.EOS_ID)        # T4: pad == EOS, so EOS is not learned


def _comp_ids(spark, sf):
    vocab = _vocab(spark, sf)
    return vocab, tokens.encode(fx.v_comp(spark, sf), "completion", vocab, "completion_id")


_COMP_ENC = _encode_sql("SELECT * FROM v_comp", "completion_id", "completion")


def _marker_sql(pieces_: list[str]) -> str:
    return "[" + ", ".join(f"(SELECT id FROM vocab WHERE token = '{p}')" for p in pieces_) + "]"


@register("find_subsequence", with_views(f"""
SELECT completion_id, array_to_string(list_filter(
         CASE WHEN len(ids) >= 3 THEN range(len(ids) - 2) ELSE []::BIGINT[] END,
         lambda i: list_slice(ids, i + 1, i + 3) = mk.marker), ',') AS positions
FROM ({_COMP_ENC}), (SELECT {_marker_sql(['<', '/', 'uci_move'])} AS marker) mk
""", "v_comp", extra={"vocab": _VOCAB_SQL}))
def q_find_subsequence(spark, sf):
    """T5: every start of the 3-piece marker '</uci_move' in the encoded completions."""
    vocab, enc = _comp_ids(spark, sf)
    marker = _marker_ids(vocab, ["<", "/", "uci_move"])
    j = enc.withColumn("marker", marker.scalar())   # one value, looked up once
    return j.select("completion_id", joined(tokens.find_subsequence("ids", F.col("marker")), ",").alias("positions"))


def _marker_ids(vocab, pieces_: list[str]):
    """One-row DataFrame with the marker's ids in order (looked up in the vocabulary)."""
    rows = vocab.where(F.col("token").isin(pieces_)).select("token", "id")
    m = rows.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("m"))
    return m.select(F.array(*[F.element_at("m", F.lit(p)) for p in pieces_]).alias("marker"))


def _spans_sql(L: int | None) -> str:
    ids = f"list_slice(ids, 1, {L})" if L else "ids"
    return f"""
SELECT completion_id, x AS ids, occ,
       list_transform(range(len(occ) // 2), lambda k: [occ[2 * k + 1] - 1, occ[2 * k + 2] + 2]) AS spans
FROM (SELECT completion_id, x, list_filter(range(len(x)), lambda i: x[i + 1] = mk.uci) AS occ
      FROM (SELECT completion_id, {ids} AS x FROM ({_COMP_ENC})), (SELECT id AS uci FROM vocab WHERE token = 'uci_move') mk)
"""


@register("label_spans", with_views(f"""
SELECT completion_id, array_to_string(list_transform(ids, lambda v, i:
         CASE WHEN len(list_filter(spans, lambda s: i - 1 >= s[1] AND i - 1 < s[2])) > 0 THEN v ELSE -100 END), ',') AS labels
FROM ({_spans_sql(None)})
""", "v_comp", extra={"vocab": _VOCAB_SQL}))
def q_label_spans(spark, sf):
    """Labels on the move-tag spans of encoded completions (marker 'uci_move')."""
    vocab, enc = _comp_ids(spark, sf)
    m = enc.withColumn("marker", _marker_ids(vocab, ["uci_move"]).scalar())   # one value, looked up once
    return m.select("completion_id", joined(tokens.label_spans("ids", F.col("marker")), ",").alias("labels"))


@register("pack_fixed", with_views(f"""
SELECT completion_id,
       array_to_string(list_concat(list_slice(ids, 1, 64), list_transform(range(greatest(64 - len(ids), 0)), lambda x: 0)), ',') AS input_ids,
       CAST(least(len(ids), 64) AS INTEGER) AS n_attended
FROM ({_COMP_ENC})
""", "v_comp", extra={"vocab": _VOCAB_SQL}))
def q_pack_fixed(spark, sf):
    """Truncate then pad to L=64."""
    _, enc = _comp_ids(spark, sf)
    p = tokens.pack_fixed("ids", 64)
    return enc.select("completion_id", joined(p["input_ids"], ",").alias("input_ids"),
                      F.aggregate(p["attention_mask"], F.lit(0), lambda a, x: a + x).alias("n_attended"))


@register("placeholder_rows", with_views(f"""
SELECT completion_id,
       CASE WHEN mv IS NULL THEN array_to_string(list_transform(range(16), lambda x: 0), ',')
            ELSE array_to_string(list_concat(list_slice(ids, 1, 16), list_transform(range(greatest(16 - len(ids), 0)), lambda x: 0)), ',')
       END AS input_ids,
       CASE WHEN mv IS NULL THEN 0 ELSE CAST(least(len(ids), 16) AS INTEGER) END AS n_attended
FROM ({_COMP_ENC}) e JOIN (SELECT completion_id, {MOVE_SQL} AS mv FROM v_comp) c USING (completion_id)
""", "v_comp", extra={"vocab": _VOCAB_SQL}))
def q_placeholder_rows(spark, sf):
    """A completion without a move tag (failed example) becomes the all-pad row; count kept."""
    from seqforge.functions.tags import extract_move
    _, enc = _comp_ids(spark, sf)
    failed = fx.v_comp(spark, sf).select("completion_id", extract_move("completion").isNull().alias("failed"))
    j = enc.join(failed, "completion_id")
    p = tokens.pack_fixed("ids", 16)
    ph = tokens.placeholder(16)
    ids = F.when(F.col("failed"), ph["input_ids"]).otherwise(p["input_ids"])
    mask = F.when(F.col("failed"), ph["attention_mask"]).otherwise(p["attention_mask"])
    return j.select("completion_id", joined(ids, ",").alias("input_ids"),
                    F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_attended"))


# ---- T1 with subwords ---------------------------------------------------------------------------

SUBWORD_MERGES = 12


def _subword_ctes() -> dict[str, str]:
    """Training one merge at a time: the words, pairs, best pair and symbols' ages of every step."""
    inner = "string_split(substr(sym, 2, len(sym) - 2), '><')"
    out = {"w0": f"""SELECT word, count(*) AS cnt, '<' || array_to_string(string_split(word, ''), '><') || '>' AS sym
                     FROM (SELECT unnest(regexp_extract_all(prompt, '{TOK_RE_SQL}')) AS word FROM v_tok_pairs) GROUP BY word""",
           "a0": "SELECT s, row_number() OVER (ORDER BY s) AS age FROM (SELECT DISTINCT unnest(string_split(word, '')) AS s FROM w0)"}
    for i in range(SUBWORD_MERGES):
        out[f"p{i}"] = f"""SELECT a, b, CAST(sum(cnt) AS BIGINT) AS n FROM (
            SELECT cnt, unnest(s[1:len(s) - 1]) AS a, unnest(s[2:]) AS b FROM (SELECT cnt, {inner} AS s FROM w{i} WHERE len(sym) > 3)) GROUP BY a, b"""
        out[f"b{i}"] = f"""SELECT p.a, p.b, p.n FROM p{i} p JOIN a{i} x ON x.s = p.a JOIN a{i} y ON y.s = p.b WHERE p.n >= 2
            ORDER BY p.n DESC, greatest(x.age, y.age), x.age, y.age LIMIT 1"""
        out[f"w{i + 1}"] = f"SELECT word, cnt, replace(sym, '<' || a || '><' || b || '>', '<' || a || b || '>') AS sym FROM w{i}, b{i}"
        out[f"a{i + 1}"] = f"SELECT * FROM a{i} UNION ALL SELECT a || b, (SELECT max(age) + 1 FROM a{i}) FROM b{i} WHERE a || b NOT IN (SELECT s FROM a{i})"
    return out


def _subwords(spark, sf):
    pairs = fx.v_tok_pairs(spark, sf).select("pair_id", "prompt")
    words = subwords.distinct_words(pairs, "prompt")
    return pairs, words, subwords.train(words, SUBWORD_MERGES)


@register("subword_merges", with_views(" UNION ALL ".join(
    f"SELECT {i + 1} AS rank, a AS left_symbol, b AS right_symbol, n AS cnt FROM b{i}" for i in range(SUBWORD_MERGES)), "v_tok_pairs", extra=_subword_ctes()))
def q_subword_merges(spark, sf):
    """The first merges of pair-merge training on the prompts' distinct words."""
    _, _, merges = _subwords(spark, sf)
    return spark.createDataFrame([(i + 1, a, b, n) for i, (a, b, n) in enumerate(merges)], "rank int, left_symbol string, right_symbol string, cnt bigint")


@register("subword_encode", with_views(f"""
SELECT t.pair_id, coalesce(string_agg(CAST(v.age + 3 AS VARCHAR), ',' ORDER BY t.i, e.j), '') AS ids
FROM (SELECT pair_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT pair_id, regexp_extract_all(prompt, '{TOK_RE_SQL}') AS l FROM v_tok_pairs)) t
JOIN (SELECT word, unnest(s) AS token, generate_subscripts(s, 1) AS j FROM (
        SELECT word, CASE WHEN len(sym) = 3 THEN [word] ELSE string_split(substr(sym, 2, len(sym) - 2), '><') END AS s FROM w{SUBWORD_MERGES})) e ON e.word = t.word
JOIN a{SUBWORD_MERGES} v ON v.s = e.token
GROUP BY t.pair_id
""", "v_tok_pairs", extra=_subword_ctes()))
def q_subword_encode(spark, sf):
    """The prompts as subword ids, each distinct word encoded once."""
    pairs, words, merges = _subwords(spark, sf)
    encoded = subwords.encode_words(words, merges, subwords.subword_vocab(words, merges))
    e = subwords.encode_texts(pairs, "prompt", encoded, "pair_id")
    return e.select("pair_id", joined("ids", ",").alias("ids"))
