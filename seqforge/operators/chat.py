"""Conversations and chat-template renders.

A conversation is ``array<struct<role, content>>`` in turn order. Long-form tables
``(conv_id, turn, role, text)`` are collected once per conversation (bounded by its length: a
conversation is one model context) and every render is then a pure array expression: one
``transform`` + ``array_join``, no window, no second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.functions.text import col_of, let, ustrip

KNOWN_ROLES = ("system", "user", "assistant")


def collect_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                     content: str = "text") -> DataFrame:
    """(conv, messages) with messages sorted by turn; each element keeps its turn."""
    m = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    return df.groupBy(conv).agg(F.sort_array(F.collect_list(m)).alias("messages"))


def _first_is_system(msgs: Column) -> Column:
    return F.coalesce(F.get(msgs, 0)["role"] == "system", F.lit(False))


def _join(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def _gen(flag: bool, text: str) -> Column:
    return F.lit(text if flag else "")


def render_chatml(messages: Column | str, add_generation_prompt: bool = False,
                  default_system: str = fixed.DEFAULT_SYSTEM) -> Column:
    """Supplied leading system text else the default; later system turns kept; user, system and
    assistant turns emitted as ``<|im_start|>{role}\\n{content}<|im_end|>\\n``, other roles dropped.
    A leading system turn renders exactly like the header, so it is emitted by the same piece."""
    msgs = col_of(messages)
    header = F.when(_first_is_system(msgs), F.lit("")).otherwise(
        F.lit(f"{fixed.CHATML_START}system\n{default_system}{fixed.CHATML_END}\n"))
    pieces = F.transform(msgs, lambda m: F.when(
        m["role"].isin(*KNOWN_ROLES),
        F.concat(F.lit(fixed.CHATML_START), m["role"], F.lit("\n"), m["content"], F.lit(f"{fixed.CHATML_END}\n")))
        .otherwise(F.lit("")))
    return F.concat(header, _join(pieces), _gen(add_generation_prompt, f"{fixed.CHATML_START}assistant\n"))


def _loop_messages(msgs: Column) -> Column:
    """The messages after a leading system turn."""
    return F.when(_first_is_system(msgs), F.slice(msgs, 2, F.greatest(F.size(msgs) - 1, F.lit(0)))).otherwise(msgs)


def alternation_ok(messages: Column | str) -> Column:
    """G13 predicate: after a leading system turn, even positions are 'user' and odd ones are not."""
    loop = _loop_messages(col_of(messages))
    return F.forall(F.transform(loop, lambda m, i: (m["role"] == "user") == (i % 2 == 0)), lambda ok: ok)


def alternation_violations(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turn) of every turn that breaks user/assistant alternation."""
    loop = _loop_messages(F.col("messages"))
    flagged = F.filter(F.transform(loop, lambda m, i: F.struct(
        m["turn"].alias("turn"), ((m["role"] == "user") == (i % 2 == 0)).alias("ok"))), lambda x: ~x["ok"])
    return conversations.select(conv, F.explode(flagged).alias("v")).select(conv, F.col("v.turn").alias("turn"))


def render_gemma(messages: Column | str, add_generation_prompt: bool = False, bos: str = fixed.GEMMA_BOS,
                 default_system: str = fixed.DEFAULT_SYSTEM) -> Column:
    """BOS; the system text (or the default) prefixes the first remaining message; assistant is
    'model'; content stripped. NULL when roles do not alternate (G13 lists those)."""
    msgs = col_of(messages)
    prefix = F.when(_first_is_system(msgs), F.concat(F.get(msgs, 0)["content"], F.lit("\n"))).otherwise(
        F.lit(default_system + "\n"))
    loop = _loop_messages(msgs)
    pieces = F.transform(loop, lambda m, i: F.concat(
        F.lit(fixed.GEMMA_START), F.when(m["role"] == "assistant", F.lit("model")).otherwise(m["role"]), F.lit("\n"),
        F.when(i == 0, prefix).otherwise(F.lit("")), ustrip(m["content"]), F.lit(f"{fixed.GEMMA_END}\n")))
    text = F.concat(F.lit(bos), _join(pieces), _gen(add_generation_prompt, f"{fixed.GEMMA_START}model\n"))
    return F.when(alternation_ok(msgs), text)


def render_llama(messages: Column | str, add_generation_prompt: bool = False, bos: str = fixed.LLAMA_BOS) -> Column:
    """BOS; a leading system turn becomes the system block only when its text is non-empty."""
    msgs = col_of(messages)
    first_sys = _first_is_system(msgs)
    sys_text = F.when(first_sys, F.get(msgs, 0)["content"]).otherwise(F.lit(""))
    h0, h1 = fixed.LLAMA_HEADER_START, fixed.LLAMA_HEADER_END
    sys_block = F.when(F.coalesce(sys_text, F.lit("")) != "",
                       F.concat(F.lit(f"{h0}system{h1}\n\n"), sys_text, F.lit(fixed.LLAMA_EOT))).otherwise(F.lit(""))
    pieces = F.transform(_loop_messages(msgs), lambda m: F.concat(
        F.lit(h0), m["role"], F.lit(f"{h1}\n\n"), m["content"], F.lit(fixed.LLAMA_EOT)))
    return F.concat(F.lit(bos), sys_block, _join(pieces), _gen(add_generation_prompt, f"{h0}assistant{h1}\n\n"))


def render_granite(messages: Column | str, add_generation_prompt: bool = False) -> Column:
    """A role block per system/user/assistant turn, other roles dropped, no BOS."""
    s, e, t = fixed.GRANITE_ROLE_START, fixed.GRANITE_ROLE_END, fixed.GRANITE_END
    pieces = F.transform(col_of(messages), lambda m: F.when(
        m["role"].isin(*KNOWN_ROLES), F.concat(F.lit(s), m["role"], F.lit(e), m["content"], F.lit(f"{t}\n")))
        .otherwise(F.lit("")))
    return F.concat(_join(pieces), _gen(add_generation_prompt, f"{s}assistant{e}"))


def render_generic(messages: Column | str, add_generation_prompt: bool = False, bos: str = "",
                   eos: str = "") -> Column:
    """``{bos}{role}: {content}{eos}\\n`` per turn."""
    pieces = F.transform(col_of(messages), lambda m: F.concat(
        F.lit(bos), m["role"], F.lit(": "), m["content"], F.lit(f"{eos}\n")))
    return F.concat(_join(pieces), _gen(add_generation_prompt, f"{bos}assistant: "))


def messages_text(messages: Column | str) -> Column:
    """``role: content`` joined by a blank line."""
    return F.array_join(F.transform(col_of(messages), lambda m: F.concat(m["role"], F.lit(": "), m["content"])),
                        "\n\n")


def template_family(model_name: Column | str, special_tokens: Column | str,
                    current_template: Column | None = None, model_type: Column | None = None) -> Column:
    """G15: 'keep' when a template is already set; else the family from marker tokens or the model's type;
    where no type is given, the name tells it (first name hit in the fixed order); 'generic' otherwise
    ('mistral' and unknown types end generic)."""
    name, toks = F.lower(col_of(model_name)), col_of(special_tokens)
    by_name = F.lit(None).cast("string")
    for fam in reversed(fixed.FAMILY_NAME_ORDER):
        by_name = F.when(name.contains(fam), F.lit(fam)).otherwise(by_name)
    if model_type is not None:
        by_name = F.coalesce(F.lower(model_type), by_name)
    out = F.lit("generic")
    for fam, marker, name_hit in reversed(fixed.FAMILY_TOKEN_CHECKS):
        has = F.coalesce(F.array_contains(toks, marker), F.lit(False)) | F.coalesce(by_name == name_hit, F.lit(False))
        out = F.when(has, F.lit(fam)).otherwise(out)
    if current_template is not None:
        out = F.when(current_template.isNotNull(), F.lit("keep")).otherwise(out)
    return out


def render_family(family: Column | str, messages: Column | str, add_generation_prompt: bool = False,
                  bos: Column | str | None = None, eos: Column | str | None = None) -> Column:
    """Render with the template of each row's family (one job renders per-model variants)."""
    fam, msgs = col_of(family), col_of(messages)
    generic = render_generic(msgs, add_generation_prompt)
    if bos is not None or eos is not None:
        b = col_of(bos) if bos is not None else F.lit("")
        e = col_of(eos) if eos is not None else F.lit("")
        pieces = F.transform(msgs, lambda m: F.concat(b, m["role"], F.lit(": "), m["content"], e, F.lit("\n")))
        generic = F.concat(_join(pieces), F.concat(b, F.lit("assistant: ")) if add_generation_prompt else F.lit(""))
    return (F.when(fam == "chatml", render_chatml(msgs, add_generation_prompt))
            .when(fam == "gemma", render_gemma(msgs, add_generation_prompt))
            .when(fam == "llama", render_llama(msgs, add_generation_prompt))
            .when(fam == "granite", render_granite(msgs, add_generation_prompt))
            .otherwise(generic))


# ---- G5: sequence -> multi-turn game conversation ----------------------------------------------

def game_conversation(actions: Column, states: Column, valid_len: Column, assistant_white: Column,
                      candidates_of, start_text: Column, start_white: Column | None = None) -> Column:
    """Messages of one sequence, or NULL when it has no assistant turn.

    ``states[k]`` is the state before step k; ``candidates_of(state)`` gives the sorted candidate
    array; steps stop at ``valid_len``. The side that starts (White unless ``start_white`` says
    otherwise) moves at even plies. The assistant answers at its plies with ``<uci_move>..</uci_move>``; the opponent's step is shown at the head of the next
    user message.
    """
    starts = assistant_white if start_white is None else assistant_white == start_white
    a_par = F.when(starts, F.lit(0)).otherwise(F.lit(1))
    system = F.struct(F.lit("system").alias("role"), F.concat(
        F.lit(fixed.GAME_SYSTEM.split("{assistant}")[0]),
        F.when(assistant_white, F.lit("White")).otherwise(F.lit("Black")),
        F.lit(fixed.GAME_SYSTEM.split("{assistant}")[1].split("{user}")[0]),
        F.when(assistant_white, F.lit("Black")).otherwise(F.lit("White")),
        F.lit(fixed.GAME_SYSTEM.split("{user}")[1].split("{fen}")[0]),
        start_text,
        F.lit(fixed.GAME_SYSTEM.split("{fen}")[1])).alias("content"))
    def body(v: Column) -> Column:
        acts, sts = v["actions"], v["states"]
        n = F.least(v["valid_len"], F.size(acts))
        mine = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                        lambda k: (k < n) & (F.pmod(k, F.lit(2)) == a_par))

        def pair(k: Column) -> Column:
            st = F.element_at(sts, k + 1)
            pos = F.concat(F.lit("Position: "), st.cast("string"), F.lit("\nLegal moves: "),
                           F.array_join(candidates_of(st), " "))
            opp = F.when(k > 0, F.concat(F.lit(fixed.MOVE_OPEN), F.element_at(acts, k), F.lit(fixed.MOVE_CLOSE + "\n\n")))
            user = F.struct(F.lit("user").alias("role"), F.concat(F.coalesce(opp, F.lit("")), pos).alias("content"))
            asst = F.struct(F.lit("assistant").alias("role"),
                            F.concat(F.lit(fixed.MOVE_OPEN), F.element_at(acts, k + 1), F.lit(fixed.MOVE_CLOSE))
                            .alias("content"))
            return F.array(user, asst)

        turns = F.flatten(F.transform(mine, pair))
        return F.when((F.size(acts) >= 2) & (F.size(mine) > 0), F.concat(F.array(system), turns))

    # The state replay is bound once; the per-ply lambdas read it without recomputing it.
    return let(F.struct(actions.alias("actions"), states.alias("states"), valid_len.alias("valid_len")), body)
