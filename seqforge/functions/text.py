"""Column -> Column text helpers with Python string semantics (Unicode whitespace), all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/str.strip() treat every Unicode space as whitespace; Java's \s does not unless
# UNICODE_CHARACTER_CLASS (?U) is on.
# Python also counts the separators U+001C-U+001F as whitespace.
PY_WS = r"[\s\x1c-\x1f]"
WS_RUN = rf"(?U){PY_WS}+"
EDGE_WS = rf"(?U)^{PY_WS}+|{PY_WS}+$"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """Python ``str.strip()``. ``trim`` would only drop ASCII spaces."""
    return F.regexp_replace(col_of(c), EDGE_WS, "")


def ws_split(c: Column | str) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens; '' gives [].

    (A filter of the empty edge tokens measured faster than stripping whole texts with a regex.)"""
    return F.filter(F.split(col_of(c), WS_RUN), lambda x: x != "")


def ws_count(c: Column | str) -> Column:
    return F.size(ws_split(c))


def hash32(salt: str, c: Column | str) -> Column:
    """Deterministic 32-bit hash: first 8 hex digits of md5(salt || ':' || value) as bigint.

    Equal in DuckDB as ``('0x' || substr(md5(salt || ':' || v), 1, 8))::BIGINT``.
    """
    digest = F.md5(F.concat(F.lit(salt), F.lit(":"), col_of(c).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def joined(arr: Column | str, sep: str = " ") -> Column:
    """Text form of an array (for display, JSON sinks and oracle comparison); a bulk cast."""
    return F.array_join(col_of(arr).cast("array<string>"), sep)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst inlines a projected alias into the lambda of a higher-order function, so an array
    computed in one ``select`` and read inside ``transform`` in the next is recomputed per element.
    Arguments of a higher-order function are evaluated once: ``aggregate`` over a one-element array
    with ``value`` as its start value binds it, and the finish function uses it freely.
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _x: acc, body)
