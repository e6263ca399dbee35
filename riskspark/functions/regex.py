"""Regular expressions with the matching rules the catalogue was written for.

``(?d)``: only a line feed ends a line. ``(?U)``: word, space and boundary classes are Unicode.
"""

from __future__ import annotations

SEP = "\u0001"


def jre(pattern: str, flags: str = "") -> str:
    return f"(?dU{flags}){pattern}"


def any_word(words) -> str:
    """Alternation of literal words for use inside a pattern."""
    return "|".join(w.replace("\\", "\\\\").replace(".", "\\.").replace("+", "\\+") for w in words)
