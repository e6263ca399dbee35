"""Splitting command strings (F1, F2) without leaving the JVM.

Word lists are carried as one string in which every word is followed by a separator; option
grammars then become anchored patterns over that string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.paths import strip, strip_quotes
from riskspark.functions.regex import SEP

_SEGMENT = (
    r"\G((?:[^'\";&|\n]++|'[^']*+'?|\"[^\"]*+\"?|&(?!&)|\|(?!\|)|;(?=;))*+)(?:\n|&&|\|\||;(?!;))"
)
_WORD_GAP = r"(?U)\G((?:[^\s'\"\x1c-\x1f]++|'[^']*+'?|\"[^\"]*+\"?)*+)([\s\x1c-\x1f]++)"
_UNQUOTE = r"'([^']*+)'?|\"([^\"]*+)\"?"
_LEX = r"\"[^\"]*\"|'[^']*'|[^ \t\r\n'\"][^ \t\r\n]*"


def split_segments(command: Column) -> Column:
    """Commands between unquoted line feeds, ``;``, ``&&`` and ``||``, trimmed, empties dropped."""
    parts = F.split(F.regexp_replace(command, _SEGMENT, "$1" + SEP), SEP)
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def joined_words(command: Column) -> Column:
    """Quote-aware words, each followed by the separator."""
    stripped = strip(command)
    gapped = F.regexp_replace(stripped, _WORD_GAP, "$1" + SEP)
    return F.when(stripped == "", F.lit("")).otherwise(
        F.concat(F.regexp_replace(gapped, _UNQUOTE, "$1$2"), F.lit(SEP))
    )


def words_of(joined: Column) -> Column:
    """Array form of a separator-terminated word list."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(joined, SEP + r"\z", ""), SEP)
    )


def split_words(command: Column) -> Column:
    return words_of(joined_words(command))


def lex_words(command: Column, drop_empty: bool = True) -> Column:
    """Shell-style tokens with outer quotes removed.

    A quote only groups at the start of a token. A command whose quotes do not balance falls back
    to plain whitespace splitting.
    """
    unbalanced = F.regexp_replace(command, _LEX, "").rlike("['\"]")
    stripped = strip(command)
    plain = F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, r"(?U)[\s\x1c-\x1f]+")
    )
    tokens = F.when(unbalanced, plain).otherwise(F.regexp_extract_all(command, F.lit(_LEX), 0))
    cleaned = F.transform(tokens, strip_quotes)
    return F.filter(cleaned, lambda t: t != "") if drop_empty else cleaned


def lex_joined(command: Column) -> Column:
    tokens = lex_words(command)
    return F.when(F.size(tokens) == 0, F.lit("")).otherwise(F.concat(F.array_join(tokens, SEP), F.lit(SEP)))
