"""Prompt and response text (G1-G4, G16) as Column expressions.

A template is rendered with ``concat`` over its literal pieces and slot columns (``str.format``
semantics: a slot value is never re-scanned for placeholders). A NULL slot gives a NULL prompt,
which P7 drops.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.functions.text import col_of


def template_pieces(template: str) -> list[tuple[str, str | None]]:
    """[(literal, slot or None)] in order, with ``{{``/``}}`` unescaped."""
    return [(lit, field) for lit, field, _spec, _conv in string.Formatter().parse(template)]


def render(template: str, **slots: Column | str) -> Column:
    """Fill the named slots of ``template`` with columns."""
    parts: list[Column] = []
    for literal, field in template_pieces(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in slots:
                raise KeyError(f"template slot {field!r} has no column")
            parts.append(col_of(slots[field]))
    return F.concat(*parts)


def render_prompt(fen: Column | str, side: Column | str, candidates: Column | str,
                  template: str = fixed.PROMPT_BEST_MOVE) -> Column:
    """G1: the move prompt; candidates is an array, joined by spaces."""
    return render(template, FEN=fen, side_to_move=side, legal_moves_uci=F.array_join(col_of(candidates), " "))


def render_prompt_variant(fen: Column | str, side: Column | str, candidates: Column | str) -> Column:
    """The continuation-line prompt."""
    return render_prompt(fen, side, candidates, fixed.PROMPT_PV_LINE)


def render_response(window: Column | str, move: Column | str) -> Column:
    """``<rationale>{window joined}</rationale><uci_move>{move}</uci_move>``, no separator."""
    return F.concat(F.lit(fixed.RATIONALE_OPEN), F.array_join(col_of(window), " "), F.lit(fixed.RATIONALE_CLOSE),
                    F.lit(fixed.MOVE_OPEN), col_of(move), F.lit(fixed.MOVE_CLOSE))


def user_message(content: Column | str) -> Column:
    """A one-message conversation for G4."""
    return F.array(F.struct(F.lit("user").alias("role"), col_of(content).alias("content")))


def plain_example(fen: Column | str, side: Column | str, candidates: Column | str) -> Column:
    """The plain demo training text."""
    return render(fixed.PLAIN_EXAMPLE, fen=fen, side=side, moves=F.array_join(col_of(candidates), " "))


def drop_null_prompt(df: DataFrame, col: str = "prompt") -> DataFrame:
    """Rows whose render failed are dropped."""
    return df.where(F.col(col).isNotNull())
