"""Line numbers, snippets, comments and string masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.paths import strip

EVIDENCE_LENGTH = 160
# Every break a line splitter honours; F5 counts line feeds only.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def line_number(text: Column, needle: Column, lowered: Column | None = None) -> Column:
    """1 + line feeds before the first case-insensitive occurrence; 1 when there is none."""
    low = F.lower(text) if lowered is None else lowered
    at = F.position(F.lower(needle), low)
    before = F.substring(text, F.lit(1), at - 1)
    feeds = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when(at > 0, feeds + 1).otherwise(F.lit(1)).cast("int")


def truncate_evidence(value: Column, size: int = EVIDENCE_LENGTH) -> Column:
    return F.substring(value, 1, size)


def ellipsize(value: Column, size: int) -> Column:
    return F.when(F.length(value) > size, F.concat(F.substring(value, 1, size - 3), F.lit("..."))).otherwise(value)


def collapse_ws(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+", " "))


def redact(value: Column) -> Column:
    """Fixed mask plus length: enough to tell findings apart, never the secret."""
    return F.concat(F.lit("[redacted:"), F.length(value).cast("string"), F.lit("]"))


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


_RUBY_CODE = (
    r"^((?:[^#'\"]|'(?:\\.|[^'\\])*+(?:'|\\?$)|\"(?:\\.|[^\"\\])*+(?:\"|\\?$))*+)"
)
_RUBY_TOKENS = r"'(?:\\.|[^'\\])*+(?:'|\\?$)|\"(?:\\.|[^\"\\])*+(?:\"|\\?$)|[^'\"]+"


def strip_comment(line: Column) -> Column:
    """The part of a line before a ``#`` that is outside quotes."""
    return F.regexp_extract(line, _RUBY_CODE, 1)


def _blank(token: Column, keep_delimiters: bool) -> Column:
    if not keep_delimiters:
        return F.repeat(F.lit(" "), F.length(token))
    closed = (F.length(token) > 1) & (F.substring(token, 1, 1) == F.substring(token, -1, 1)) & ~token.rlike(
        r"^.(?:[^\\]|\\.)*\\.$"
    )
    body = F.length(token) - F.when(closed, F.lit(2)).otherwise(F.lit(1))
    return F.concat(
        F.substring(token, 1, 1),
        F.repeat(F.lit(" "), body),
        F.when(closed, F.substring(token, -1, 1)).otherwise(F.lit("")),
    )


def mask_strings(line: Column, keep_delimiters: bool = False) -> Column:
    """Blank quoted text in a line, keeping its length."""
    tokens = F.regexp_extract_all(line, F.lit(_RUBY_TOKENS), 0)
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t.rlike("^['\"]"), _blank(t, keep_delimiters)).otherwise(t),
        ),
        "",
    )


_GRADLE_TOKENS = (
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
    r"|\"(?:\\[\s\S]|[^\"\\])*+(?:\"|\\?\z)|'(?:\\[\s\S]|[^'\\])*+(?:'|\\?\z)"
    r"|[^/\"']+|/"
)


def mask_gradle(text: Column) -> Column:
    """Blank comments and strings of Gradle code, keeping length and line feeds."""
    tokens = F.regexp_extract_all(text, F.lit(_GRADLE_TOKENS), 0)
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t.rlike(r"^(?://|/\*|[\"'])"), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t),
        ),
        "",
    )


def is_json_object(text: Column) -> Column:
    """Whether a text is one whole JSON object; repeated names and ``NaN`` pass, single quotes and anything behind it do not.

    A reader that stops behind the first value would take a text with a rest for whole. Inside two kinds of brackets only a
    text that is exactly one value leaves both of them closed where they should be.
    """
    strict = {"allowSingleQuotes": "false"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("\n]")), "array<string>", strict)
    named = F.from_json(F.concat(F.lit('{"v":'), text, F.lit('\n,"end":1}')), "v string, end int", strict)
    starts = F.ltrim(F.translate(text, "\t\r\n", "   ")).startswith("{")
    return F.coalesce(starts & (F.size(listed) == 1) & (named.getField("end") == 1), F.lit(False))
