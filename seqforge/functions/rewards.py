"""Reward columns (W1-W8, W10-W13) as Column expressions: no UDF, double arithmetic in the
reference's operation order so that results are bit-equal.

A reward is a function ``(completion, **aligned columns) -> Column``; ``REGISTRY`` names them with
the columns they need (U1). ``scaled`` is the weighting wrapper (U2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqforge.functions.fixed import MATE_SCORE, MATE_THRESHOLD, TOKEN_PENALTY
from seqforge.functions.tags import extract_move, extract_rationale, parse_joint
from seqforge.functions.text import col_of, ustrip, ws_count


def _d(x: float) -> Column:
    return F.lit(float(x))


def r_format(completion: Column | str, **_) -> Column:
    """1.0 when the joint parse finds the tag pair, else 0.0."""
    return F.when(parse_joint(completion)["has_format"], _d(1.0)).otherwise(_d(0.0))


def r_combined_format(completion: Column | str, **_) -> Column:
    """+2.0 when rationale and move are both found independently, else -1.0."""
    ok = extract_rationale(completion).isNotNull() & extract_move(completion).isNotNull()
    return F.when(ok, _d(2.0)).otherwise(_d(-1.0))


def r_rationale_present(completion: Column | str, **_) -> Column:
    """W3."""
    return F.when(extract_rationale(completion).isNotNull(), _d(1.0)).otherwise(_d(0.0))


def r_move_present(completion: Column | str, **_) -> Column:
    """W4."""
    return F.when(extract_move(completion).isNotNull(), _d(1.0)).otherwise(_d(0.0))


def r_token_penalty(completion: Column | str, **_) -> Column:
    """-0.002 per whitespace token of the whole completion."""
    return _d(TOKEN_PENALTY) * ws_count(completion)


def sentence_count(text: Column | str) -> Column:
    """Non-blank pieces of ``text.split('.')``."""
    return F.size(F.filter(F.split(col_of(text), r"\.", -1), lambda s: ustrip(s) != ""))


def r_conciseness(completion: Column | str, **_) -> Column:
    """One sentence under 150 chars 1.0; at most two (zero included) under 200 0.5; else -0.5."""
    r = extract_rationale(completion)
    s, n = sentence_count(r), F.length(r)
    return (F.when(r.isNull(), _d(-0.5))
            .when((s == 1) & (n < 150), _d(1.0))
            .when((s <= 2) & (n < 200), _d(0.5))
            .otherwise(_d(-0.5)))


def r_legality(completion: Column | str, legal_moves: Column | str, **_) -> Column:
    """Move among the candidates 1.0, not among them -2.0, no move (or no list) -1.0."""
    m, legal = extract_move(completion), col_of(legal_moves)
    return (F.when(m.isNull() | legal.isNull(), _d(-1.0))
            .when(F.coalesce(F.array_contains(legal, m), F.lit(False)), _d(1.0))
            .otherwise(_d(-2.0)))


def r_correct(completion: Column | str, correct_move: Column | str, **_) -> Column:
    """Exact match 3.0, else (also missing) -0.5."""
    m = extract_move(completion)
    return F.when(m.isNotNull() & (m == col_of(correct_move)), _d(3.0)).otherwise(_d(-0.5))


def fold_mate(cp: Column | str, mate: Column | str) -> Column:
    """One centipawn scale; mate in m -> 10000-m (m>0) or -10000-m (m<=0), side-to-move relative."""
    cp, mate = col_of(cp), col_of(mate)
    return F.when(cp.isNotNull(), cp.cast("bigint")).when(
        mate > 0, F.lit(MATE_SCORE) - mate.cast("bigint")).when(
        mate.isNotNull(), F.lit(-MATE_SCORE) - mate.cast("bigint"))


def quality_curve(cp_pred: Column | str, cp_ref: Column | str) -> Column:
    """W11 core: reward from the predicted and reference values (both on the folded scale).

    NULL in either value (missing lookup) -> -1.0, like the reference's caught lookup errors.
    """
    p, c = col_of(cp_pred).cast("bigint"), col_of(cp_ref).cast("bigint")
    loss = c - p
    lossd = loss.cast("double")
    mate_branch = (F.when(F.abs(p) >= MATE_THRESHOLD, _d(3.0))
                   .when(((p * c) > 0) & (F.abs(p) > 200), _d(1.5))
                   .otherwise(_d(-1.0)))
    cp_branch = (F.when(loss <= 0, _d(3.0))
                 .when(loss < 25, _d(2.5))
                 .when(loss < 75, _d(2.0) - (lossd - 25) / 50 * 0.5)
                 .when(loss < 150, _d(1.5) - (lossd - 75) / 75 * 1.0)
                 .when(loss < 300, _d(0.5) - (lossd - 150) / 150 * 1.0)
                 .otherwise(F.greatest(_d(-2.0), _d(-0.5) - (lossd - 300) / 400)))
    return (F.when(p.isNull() | c.isNull(), _d(-1.0))
            .when(F.abs(c) >= MATE_THRESHOLD, mate_branch)
            .otherwise(cp_branch))


def quality_gate(completion: Column | str, legal_moves: Column | str) -> Column:
    """W11 short-circuit before any lookup: no move -3.0, not a candidate -4.0, else NULL (look up)."""
    m = extract_move(completion)
    return (F.when(m.isNull(), _d(-3.0))
            .when(~F.coalesce(F.array_contains(col_of(legal_moves), m), F.lit(False)), _d(-4.0)))


def r_quality(completion: Column | str, legal_moves: Column | str, cp_pred: Column | str, cp_ref: Column | str, **_) -> Column:
    """W11 as one expression, where the looked-up values are columns."""
    return F.coalesce(quality_gate(completion, legal_moves), quality_curve(cp_pred, cp_ref))


def metric_name(name: str, weight: float) -> str:
    """The logged metric name of a weighted reward, e.g. ``stockfish_eval_x3``."""
    return f"{name}_x{weight:g}"


def column_name(name: str, weight: float) -> str:
    """Column-safe form of :func:`metric_name` (no dots)."""
    return metric_name(name, weight).replace(".", "_")


def scaled(reward: Column, weight: float, name: str) -> Column:
    """``float(r) * w`` under the weighted name."""
    return (reward.cast("double") * F.lit(float(weight))).alias(column_name(name, weight))


REGISTRY: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "format": ((), r_format),
    "combined_format": ((), r_combined_format),
    "rationale_format": ((), r_rationale_present),
    "move_format": ((), r_move_present),
    "token_penalty": ((), r_token_penalty),
    "rationale_length": ((), r_conciseness),
    "legality": (("legal_moves",), r_legality),
    "correctness": (("correct_move",), r_correct),
    "stockfish_eval": (("legal_moves", "cp_pred", "cp_ref"), r_quality),
}
