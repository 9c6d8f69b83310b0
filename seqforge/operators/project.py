"""Projections, defaults, predicates and small labels (P1-P4, P9-P15). DataFrame/Column in, same out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import fixed
from seqforge.functions.text import col_of, ws_split

CORRUPT = "_corrupt_record"    # the readers' column for a row that does not fit the schema


def _rating() -> Column:
    r = F.col("Rating")
    return F.when(r.isNull() | (r == ""), F.lit(0)).otherwise(F.expr("try_cast(Rating AS INT)"))


def parse_error(raw: DataFrame) -> Column:
    """True for an error row: a rating that is not a number, or missing moves or themes.

    The CSV reader gives NULL for an empty field as for a missing one, but marks a row that has too few
    fields; so with its mark at hand only marked rows can miss a field, and an empty one means no moves or
    no themes."""
    missing = F.col("Moves").isNull() | F.col("Themes").isNull()
    if CORRUPT in raw.columns:
        missing = missing & F.col(CORRUPT).isNotNull()
    return _rating().isNull() | missing


def type_puzzles(raw: DataFrame) -> DataFrame:
    """P1+P2: CSV strings (M1) -> typed puzzles (M2) with a ``parse_error`` flag.

    Only the rating and the tags have a default: empty rating -> 0, absent or empty tags -> [].
    """
    rating, tags = _rating(), F.col("OpeningTags")
    return raw.select(
        F.col("PuzzleId").alias("puzzle_id"), F.col("FEN").alias("fen"),
        ws_split(F.coalesce(F.col("Moves"), F.lit(""))).alias("moves"),
        rating.alias("rating"),
        ws_split(F.coalesce(F.col("Themes"), F.lit(""))).alias("themes"),
        F.col("GameUrl").alias("game_url"),
        F.when(tags.isNull() | (tags == ""), F.array().cast("array<string>")).otherwise(ws_split(tags)).alias("opening_tags"),
        parse_error(raw).alias("parse_error"))


def good_rows(typed: DataFrame) -> DataFrame:
    return typed.where(~F.col("parse_error")).drop("parse_error")


def bad_rows(typed: DataFrame) -> DataFrame:
    return typed.where(F.col("parse_error"))


def rating_filter(df: DataFrame, min_rating: int = 1000, max_rating: int = 2500, enabled: bool = False,
                  col: str = "rating") -> DataFrame:
    """Inclusive range filter behind a switch (off by default, as shipped)."""
    return df.where(F.col(col).between(min_rating, max_rating)) if enabled else df


def rating_skipped(df: DataFrame, min_rating: int = 1000, max_rating: int = 2500, col: str = "rating") -> Column:
    """Aggregate: rows the range filter would skip."""
    return F.count_if(~F.col(col).between(min_rating, max_rating))


def limit_matched(df: DataFrame, n: int | None, order_by: list[str]) -> DataFrame:
    """First ``n`` rows on a stable key after filtering; None/0 means no limit."""
    return df.orderBy(*order_by).limit(n) if n else df


def score_label(cp: Column | str, mate: Column | str) -> tuple[Column, Column]:
    """(kind, value): 'cp' if cp present else 'mate'; value cp, else mate, else 'N/A'."""
    cp, mate = col_of(cp), col_of(mate)
    kind = F.when(cp.isNotNull(), F.lit("cp")).otherwise(F.lit("mate"))
    value = F.coalesce(cp.cast("string"), mate.cast("string"), F.lit("N/A"))
    return kind, value


def position_fields(fen: Column | str) -> Column:
    """Struct of the six position fields; the four-field form defaults to halfmove 0, fullmove 1."""
    parts = F.split(col_of(fen), " ")
    g = lambda i: F.get(parts, i)  # noqa: E731 - null-safe index under ANSI
    return F.struct(g(0).alias("board"), g(1).alias("side"), g(2).alias("castling"), g(3).alias("en_passant"),
                    F.coalesce(g(4), F.lit("0")).alias("halfmove"), F.coalesce(g(5), F.lit("1")).alias("fullmove"))


def side_label(side_letter: Column | str, plies: Column | int = 0) -> Column:
    """P13: 'White'/'Black' for the side to move after ``plies`` more plies."""
    white_now = col_of(side_letter) == "w"
    flip = F.pmod(F.lit(plies) if isinstance(plies, int) else plies, F.lit(2)) == 1
    is_white = white_now != flip
    return F.when(is_white, F.lit("White")).otherwise(F.lit("Black"))


def complexity_bucket(n_candidates: Column | str) -> Column:
    """>30 High, >20 Medium, else Low."""
    n = col_of(n_candidates)
    return F.when(n > 30, F.lit("High")).when(n > 20, F.lit("Medium")).otherwise(F.lit("Low"))


def theme_rationale(themes: Column | str) -> Column:
    """Whole-theme match: 'fork' first, then 'mate', else the generic text."""
    t = col_of(themes)
    return (F.when(F.coalesce(F.array_contains(t, "fork"), F.lit(False)), F.lit(fixed.THEME_RATIONALE_FORK))
            .when(F.coalesce(F.array_contains(t, "mate"), F.lit(False)), F.lit(fixed.THEME_RATIONALE_MATE))
            .otherwise(F.lit(fixed.THEME_RATIONALE_OTHER)))


def position_examples(plies: DataFrame) -> DataFrame:
    """P10: nested example rows (M6) from ply rows of :func:`sequences.ply_expand`."""
    return plies.select(
        F.struct("fen", "legal_moves", "side_to_move").alias("input"),
        F.struct("move", "solution").alias("output"),
        F.struct("puzzle_id", "rating", "themes", "game_url", "opening_tags", "move_number",
                 "total_moves").alias("metadata"))


def flatten_example(examples: DataFrame) -> DataFrame:
    """M6 -> prompt row fields (M7)."""
    return examples.select(F.col("input.fen").alias("fen"), F.col("output.move").alias("correct_move"),
                           F.col("input.legal_moves").alias("legal_moves"),
                           F.col("input.side_to_move").alias("side_to_move"),
                           F.col("metadata.puzzle_id").alias("puzzle_id"), F.col("metadata.rating").alias("rating"),
                           F.col("metadata.themes").alias("themes"))
