"""Completion parsing (Column -> Column), Java regex with Python ``re`` semantics.

Patterns carry (?s) for DOTALL and (?U) so that \\s means Unicode whitespace as in Python.
A regex miss in ``regexp_extract`` returns '' (not NULL), so presence is tested with ``rlike`` first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqforge.functions.fixed import MOVE_CLOSE, MOVE_OPEN, RATIONALE_CLOSE, RATIONALE_NAME, RATIONALE_OPEN
from seqforge.functions.text import PY_WS, col_of, ustrip

S = PY_WS   # Python's \s
RATIONALE_RE = rf"(?sU){RATIONALE_OPEN}{S}*(.+?){S}*{RATIONALE_CLOSE}"
MOVE_RE = rf"(?sU){MOVE_OPEN}{S}*(.+?){S}*{MOVE_CLOSE}"
# Strict joint form. Possessive quantifiers: same matches as the plain form (the group can never
# swallow the closing tag), but no catastrophic backtracking on long runs of '<'.
JOINT_STRICT_RE = (rf"(?sU){RATIONALE_OPEN}([^<]*+(?:<(?!/?{RATIONALE_NAME}>)[^<]*+)*+){RATIONALE_CLOSE}"
                   rf"{S}*{MOVE_OPEN}([^<]+){MOVE_CLOSE}")
JOINT_LOOSE_RE = rf"(?sU){RATIONALE_OPEN}{S}*(.+?){S}*{RATIONALE_CLOSE}.*?{MOVE_OPEN}{S}*(.+?){S}*{MOVE_CLOSE}"


def _extract(c: Column, pattern: str, group: int) -> Column:
    return F.when(c.rlike(pattern), ustrip(F.regexp_extract(c, pattern, group)))


def extract_rationale(text: Column | str) -> Column:
    """First rationale tag pair, stripped; NULL when absent (whitespace-only inside gives '')."""
    return _extract(col_of(text), RATIONALE_RE, 1)


def extract_move(text: Column | str) -> Column:
    """First move tag pair, stripped; NULL when absent."""
    return _extract(col_of(text), MOVE_RE, 1)


def parse_joint(text: Column | str) -> Column:
    """struct<rationale, move, has_format> - strict form, else loose form, else (NULL, NULL, false)."""
    c = col_of(text)
    strict, loose = c.rlike(JOINT_STRICT_RE), c.rlike(JOINT_LOOSE_RE)

    def pick(g: int) -> Column:
        return (F.when(strict, ustrip(F.regexp_extract(c, JOINT_STRICT_RE, g)))
                .when(loose, ustrip(F.regexp_extract(c, JOINT_LOOSE_RE, g))))

    return F.struct(pick(1).alias("rationale"), pick(2).alias("move"),
                    F.coalesce(strict | loose, F.lit(False)).alias("has_format"))
