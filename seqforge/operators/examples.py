"""End-to-end example builders (the reference's lifecycles L1, L2 and L3) composed from the operators.

* :func:`check_puzzles` and :func:`puzzle_examples` (L1): puzzles whose every move is allowed become one
  nested example per ply of the solving side, with the position and its candidates at that ply; a puzzle
  with a move that is not allowed is discarded whole and counted (:func:`puzzle_report`).
* :func:`prompt_rows` (L3): a reproducible split point in the valid prefix, the state reached there, the
  candidate list, the move prompt wrapped as a one-message chat with the generation prompt.
* :func:`single_move_rows` (L2, single move): continuation prompt + tagged PV response, encoded,
  truncated with the response reserved, padded, response-only labels.
* :func:`conversation_rows` (L2, conversation): game conversation, chat render, encoding,
  labels on the move-tag spans, truncate-then-pad; sequences without a conversation become
  placeholder rows so the row count is kept.

The order of steps for L2 and L3: the sequence is cut to its valid prefix, short ones (under two steps) are
dropped, :func:`sample_and_split` draws the sample and its train and test rows, then each row is built.

Sequences carry (seq_id, start_state, start_side 'w'/'b', actions[]); rules are
``rules(state, action, next_state)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.operators import chat, project, prompts, sampling, sequences, tokens


# ---- L1: puzzles -------------------------------------------------------------------------------

def check_puzzles(puzzles: DataFrame, rules: DataFrame, cands: bool = True) -> DataFrame:
    """The puzzles (puzzle_id, start_state, moves, ...) with n_steps, valid_len, states, cands (if wanted) and ``ok``:
    every move is allowed (E4)."""
    return sequences.replayed(puzzles, rules, ("puzzle_id",), "moves", cands).withColumn("ok", F.col("valid_len") == F.col("n_steps"))


def puzzle_examples(checked: DataFrame, solver_offset: int = 0, rules: DataFrame | None = None) -> DataFrame:
    """Nested examples (input, output, metadata) of the puzzles that are ``ok``. With ``rules``, each ply's candidates are
    joined from them and ``checked`` needs no ``cands``: the way for many rules, as a puzzle's row stays small."""
    cands = "cands" if rules is None else sequences.candidate_actions(rules)
    return project.position_examples(sequences.ply_expand(checked.where("ok"), solver_offset, "states", cands))


def puzzle_report(checked: DataFrame, min_rating: int | None = None, max_rating: int | None = None) -> DataFrame:
    """One row of counters from one pass over all puzzles, error rows (``parse_error``) included: errors,
    skipped (outside the ratings, if given), total, successful, failed, total_positions."""
    bad = F.coalesce(F.col("parse_error"), F.lit(False))
    out = F.lit(False) if min_rating is None else ~F.col("rating").between(min_rating, max_rating)
    used = ~bad & ~F.coalesce(out, F.lit(False))
    good = used & F.col("ok")
    return checked.agg(
        F.count_if(bad).alias("errors"), F.count_if(~bad & ~used).alias("skipped"), F.count_if(used).alias("total"),
        F.count_if(good).alias("successful"), F.count_if(used & ~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(good, F.floor((F.size("moves") + 1) / 2))), F.lit(0)).cast("bigint").alias("total_positions"))


# ---- L2, L3: sequences -------------------------------------------------------------------------

def valid_lines(seqs: DataFrame, rules: DataFrame, least: int = 2) -> DataFrame:
    """The sequences cut to their valid prefix, with states and cands; those with fewer than ``least``
    valid steps are dropped."""
    c = sequences.replayed(seqs, rules).where(F.col("valid_len") >= least)
    return c.withColumn("actions", F.slice("actions", F.lit(1), F.col("valid_len")))


def sample_and_split(rows: DataFrame, n: int | None, test_fraction: float, id_col: str = "seq_id",
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): a sample of ``n`` rows (all if None or fewer), then an exact split of it."""
    drawn = rows if n is None else sampling.sample_n(rows, n, id_col, seed)
    return sampling.split_exact(drawn, test_fraction, id_col, seed)


def _position(lines: DataFrame, seed: int, epoch: int) -> DataFrame:
    """The state at a split point within the valid prefix, with its side, candidates and next move."""
    df = lines.withColumn("split_idx", sequences.split_point("seq_id", F.size("actions"), seed, epoch))
    st = sequences.state_at(F.col("states"), F.col("split_idx"))
    side = project.side_label(F.col("start_side"), F.col("split_idx"))
    return df.select("*", st.cast("string").alias("fen"), side.alias("side"),
                     sequences.candidates_of(st).alias("legal_moves"),
                     F.element_at("actions", F.col("split_idx") + 1).alias("correct_move"))


def prompt_rows(lines: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """L3, from :func:`valid_lines`: (seq_id, prompt, correct_move, legal_moves, fen)."""
    p = _position(lines, seed, epoch)
    text = prompts.render_prompt("fen", "side", "legal_moves")
    prompt = chat.render_chatml(prompts.user_message(text), True)
    return prompts.drop_null_prompt(p.select("seq_id", prompt.alias("prompt"), "correct_move", "legal_moves", "fen"))


def single_move_texts(lines: DataFrame, line_k: int = 6, seed: int = 42, epoch: int = 0) -> DataFrame:
    """L2 single move, from :func:`valid_lines`: (seq_id, ptext, response)."""
    p = _position(lines, seed, epoch)
    c = sequences.continuation(F.col("actions"), F.col("split_idx"), line_k)
    text = prompts.render_prompt_variant("fen", "side", "legal_moves")
    return p.select("seq_id", chat.render_chatml(prompts.user_message(text), True).alias("ptext"),
                    prompts.render_response(c["window"], c["target"]).alias("response"))


def single_move_rows(examples: DataFrame, vocab, max_length: int = 512, pad_id: int = tokens.PAD_ID,
                     encode=tokens.encode_many, eos_id: int = tokens.EOS_ID) -> DataFrame:
    """L2 single move, from :func:`single_move_texts`: (seq_id, input_ids, attention_mask, labels) of width
    ``max_length``. ``encode`` (df, key, {out: text column}, vocab) gives the ids: of the corpus vocabulary, of subwords
    (``subwords.encode_many``, vocab: the encoded words) or of a model's tokenizer (``tokens.encode_many_with``, vocab: its function)."""
    enc = encode(examples, "seq_id", {"p_ids": "ptext", "r_ids": "response"}, vocab)
    j = enc.select("seq_id", "p_ids", F.concat("r_ids", F.array(F.lit(eos_id))).alias("r_ids"))
    t = tokens.truncate_reserve("p_ids", "r_ids", max_length)
    j = j.select("seq_id", t["prompt_ids"].alias("p"), t["response_ids"].alias("r"))
    pm = tokens.pad_mask(F.concat("p", "r"), max_length, pad_id)
    j = j.select("seq_id", "p", "r", pm["input_ids"].alias("input_ids"), pm["attention_mask"].alias("attention_mask"))
    return j.select("seq_id", "input_ids", "attention_mask",
                    tokens.label_response("input_ids", F.size("p"), F.size("r"), pad_id).alias("labels"))


def all_conversations(seqs: DataFrame, rules: DataFrame, seed: int = 42) -> DataFrame:
    """(seq_id, messages or NULL, num_moves) for every sequence."""
    j = sequences.replayed(seqs, rules)
    white = sampling.fair_coin("seq_id", seed) == 0
    msgs = chat.game_conversation(F.col("actions"), F.col("states"), F.col("valid_len"), white, sequences.candidates_of,
                                  F.col("start_state").cast("string"), F.col("start_side") == "w")
    return j.select("seq_id", msgs.alias("messages"), F.size("actions").alias("num_moves"))


def game_conversations(seqs: DataFrame, rules: DataFrame, seed: int = 42) -> DataFrame:
    """G5 over sequences: (seq_id, messages, num_moves); sequences without an assistant turn dropped."""
    return all_conversations(seqs, rules, seed).where(F.col("messages").isNotNull())


def conversation_texts(seqs: DataFrame, rules: DataFrame, seed: int = 42) -> DataFrame:
    """(seq_id, ok, text) for every sequence: the rendered conversation, or ok = false and no text."""
    return all_conversations(seqs, rules, seed).select(
        "seq_id", F.col("messages").isNotNull().alias("ok"),
        F.when(F.col("messages").isNotNull(), chat.render_chatml("messages")).alias("text"))


def conversation_rows(texts: DataFrame, vocab, marker: Column, max_length: int = 1024,
                      pad_id: int = tokens.PAD_ID, encode=None) -> DataFrame:
    """L2 conversation, from :func:`conversation_texts`: every sequence gives one row; failed ones are
    placeholder rows.

    ``encode`` as in :func:`single_move_rows` (the corpus vocabulary, if not given). ``marker`` is the id array of the move-tag name (e.g. the vocabulary ids of 'uci_move'). One pass:
    the 'has a conversation' flag rides along the encoding instead of a join back to the sequences.
    """
    if encode is None:
        enc = tokens.encode(texts, "text", vocab, "seq_id", keep=("ok",))
    else:      # a rendered conversation is never empty, a failed one has no text
        enc = encode(texts, "seq_id", {"ids": "text"}, vocab).withColumn("ok", F.size("ids") > 0)
    packed = enc.select("seq_id", "ok", F.slice("ids", 1, max_length).alias("ids")).withColumn("marker", marker)
    pm = tokens.pad_mask("ids", max_length, pad_id)
    ph = tokens.placeholder(max_length, pad_id)
    ok = F.col("ok")
    return packed.select("seq_id",
                         F.when(ok, pm["input_ids"]).otherwise(ph["input_ids"]).alias("input_ids"),
                         F.when(ok, pm["attention_mask"]).otherwise(ph["attention_mask"]).alias("attention_mask"),
                         F.when(ok, tokens.label_spans(pm["input_ids"], F.col("marker"))).otherwise(ph["labels"])
                         .alias("labels"))
