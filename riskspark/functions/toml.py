"""Key paths of TOML texts.

A text is cut into tokens by one pattern without repeated groups; an automaton then folds over the tokens. Its state names strings by
token numbers, so no step copies text. Spark copies the state at each step, so only names below the roots asked for are kept in it:
time grows with tokens times these names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"\n|[ \t]+|\"+|'+|[\\\[\]{}=,.#]|[^\n \t\"'\\\[\]{}=,.#]+"
_CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
_ESCAPE = r"^(?:[btnfr]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|U(?:0000(?![dD][89a-fA-F])|000[1-9a-fA-F]|0010)[0-9a-fA-F]{4})"
_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"
_SCALAR = (
    r"^(?:true|false|[+-]?(?:inf|nan)|0x[0-9a-fA-F][0-9a-fA-F_]*|0o[0-7][0-7_]*|0b[01][01_]*"
    r"|[+-]?(?:0|[1-9][0-9_]*)(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9][0-9_]*)?"
    rf"|{_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?)?|{_TIME})$"
)
_UNDERSCORE = r"_(?:[^0-9a-fA-F]|$)|\._|[eE][+-]?_"
_PIECE = r"\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[ \t]*\n[ \t\n]*|\\[\s\S]|[^\\]+"
# Deeper arrays and inline tables count as malformed.
MAX_NESTING = 200
_JOIN = "\u0001"

# Where the automaton is.
_LINE, _COMMENT, _KEY, _AFTER_KEY, _FIRST_KEY, _LIST_OPEN, _LIST_CLOSE, _END = range(8)
_VALUE, _SCALAR_ON, _AFTER_VALUE, _BASIC, _LONG_BASIC, _LITERAL, _LONG_LITERAL, _KEY_BASIC, _KEY_LITERAL = range(8, 17)
# What a key is for.
_PAIR, _HEADER, _LIST_HEADER, _INLINE = range(4)

_EVENT = "struct<kind:string,path:array<string>,base:int,own:array<int>,mode:int,s:int,e:int,lead:int,trail:int>"
_STATE = (
    "struct<m:int,ret:int,i:int,s:int,lead:int,esc:boolean,h:int,bad:boolean,parts:array<string>,table:array<string>,"
    f"path:array<string>,stack:array<struct<t:string,n:int>>,found:array<{_EVENT}>>"
)
_FIELDS = ("m", "ret", "i", "s", "lead", "esc", "h", "bad", "parts", "table", "path", "stack", "found")
_STRINGS = "array<string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; what it gives is copied, so never a whole state."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decode(raw: Column) -> Column:
    """Escapes of a basic string."""

    def piece(p: Column) -> Column:
        kind = F.substring(p, 2, 1)
        named = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r"}
        chain = F.when(~p.startswith("\\"), p).when(
            kind.isin("u", "U"), F.decode(F.unhex(F.lpad(F.substring(p, 3, 8), 8, "0")), "UTF-32")
        )
        for letter, value in named.items():
            chain = chain.when(kind == letter, F.lit(value))
        return chain.when(kind.isin("\n", " ", "\t"), F.lit("")).otherwise(kind)

    return F.when(
        F.contains(raw, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(_PIECE), 0), piece), "")
    ).otherwise(raw)


def _joined(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens from ``start`` (from 1) to before ``end``."""
    return F.array_join(F.slice(tokens, start, end - start), "")


def _step(tokens: Column, state: Column, t: Column, roots) -> Column:
    st = {name: state.getField(name) for name in _FIELDS}
    here = st["i"] + 1

    def go(m, **changes) -> Column:
        values = {**st, "i": here, "m": F.lit(m) if isinstance(m, int) else m, **changes}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in values.items()])

    def event(kind: str, path: Column, mode=0, s=0, e=0, lead=0, trail=0) -> dict:
        """Adds an event, unless it lies in an array or below a name not asked for."""
        found = F.struct(
            F.lit(kind).alias("kind"), path.alias("path"), base.alias("base"),
            F.transform(F.filter(st["stack"], lambda x: x.getField("t") == "i"), lambda x: x.getField("n")).alias("own"),
            *[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in (("mode", mode), ("s", s), ("e", e), ("lead", lead), ("trail", trail))],
        )
        skipped = F.exists(st["stack"], lambda x: x.getField("t") == "a")
        if roots is not None:
            skipped = skipped | ~F.get(path, F.lit(0)).isin(*roots)
        return {"found": F.when(skipped, st["found"]).otherwise(F.concat(st["found"], F.array(found)))}

    bad = go(_LINE, bad=True)
    mode, blank, feed, size = st["m"], t.startswith(" ") | t.startswith("\t"), t == "\n", F.length(t)
    double, single = t.startswith('"'), t.startswith("'")
    top = F.get(st["stack"], F.size(st["stack"]) - 1)
    kind, left = F.coalesce(top.getField("t"), F.lit("")), F.slice(st["stack"], 1, F.size(st["stack"]) - 1)
    following = F.coalesce(F.get(tokens, here), F.lit(""))
    # Where the names of a key start: at the table, or at the inline table that holds it.
    base = F.when(st["h"] == _INLINE, F.coalesce(top.getField("n"), F.lit(0))).otherwise(F.size(st["table"]))
    prefix = F.when(st["h"] == _INLINE, F.slice(st["path"], 1, base)).otherwise(st["table"])
    full = F.concat(prefix, st["parts"])
    same = go(mode)

    def key(start: dict) -> Column:
        """A part of a key begins."""
        parts = start.get("parts", st["parts"])
        return (
            F.when(t.rlike(r"^[A-Za-z0-9_-]+$"), go(_AFTER_KEY, **{**start, "parts": F.concat(parts, F.array(t))}))
            .when((double | single) & (size == 2), go(_AFTER_KEY, **{**start, "parts": F.concat(parts, F.array(F.lit("")))}))
            .when(double & (size == 1), go(_KEY_BASIC, **start, s=here + 1))
            .when(single & (size == 1), go(_KEY_LITERAL, **start, s=here + 1))
            .otherwise(bad)
        )

    none = F.array().cast(_STRINGS)
    line = (
        F.when(blank | feed, same)
        .when(t == "#", go(_COMMENT, ret=_LINE))
        .when((t == "[") & (following == "["), go(_LIST_OPEN))
        .when(t == "[", go(_KEY, h=_HEADER, parts=none))
        .otherwise(key({"h": F.lit(_PAIR), "parts": none}))
    )
    after_key = (
        F.when(blank, same)
        .when(t == ".", go(_KEY))
        .when((t == "=") & st["h"].isin(_PAIR, _INLINE), go(_VALUE, path=full, **event("k", full)))
        .when((t == "]") & (st["h"] == _HEADER), go(_END, table=st["parts"], **event("t", st["parts"])))
        .when((t == "]") & (st["h"] == _LIST_HEADER) & (following == "]"), go(_LIST_CLOSE, table=st["parts"], **event("a", st["parts"])))
        .otherwise(bad)
    )
    fits = F.size(st["stack"]) < MAX_NESTING

    def pushed(letter: str) -> Column:
        return F.concat(st["stack"], F.array(F.struct(F.lit(letter).alias("t"), F.size(st["path"]).alias("n"))))

    def quoted(long: int, one: int) -> Column:
        """A string begins, or is there as a whole."""
        whole = lambda quotes: go(_AFTER_VALUE, **event("v", st["path"], mode=long, s=here, e=here, lead=quotes))
        return (
            F.when(size == 1, go(one, s=here + 1, esc=False))
            .when(size == 2, whole(0))
            .when(size <= 5, go(long, s=here + 1, lead=size - 3, esc=False))
            .when(size <= 8, whole(size - 6))
            .otherwise(bad)
        )

    value = (
        F.when(blank | (feed & (kind == "a")), same)
        .when((t == "#") & (kind == "a"), go(_COMMENT, ret=_VALUE))
        .when((t == "]") & (kind == "a"), go(_AFTER_VALUE, stack=left))
        .when((t == "[") & fits, go(_VALUE, stack=pushed("a")))
        .when((t == "{") & fits, go(_FIRST_KEY, stack=pushed("i"), h=_INLINE, parts=none))
        .when(double, quoted(_LONG_BASIC, _BASIC))
        .when(single, quoted(_LONG_LITERAL, _LITERAL))
        .when(~t.rlike(r"^[\n\[\]{}=,.#\\]"), go(_SCALAR_ON, s=here))
        .otherwise(bad)
    )
    scalar = F.rtrim(_joined(tokens, st["s"], here))
    broken = (mode == _SCALAR_ON) & ((here - st["s"] > 8) | ~_let(scalar, lambda v: v.rlike(_SCALAR) & ~v.rlike(_UNDERSCORE)))
    after_value = (
        F.when((mode == _SCALAR_ON) & (blank | t.rlike(r"^(?:\.|[^\n\[\]{}=,#\"'\\])")), same)
        .when(broken, bad)
        .when(blank | (feed & (kind == "a")), go(_AFTER_VALUE))
        .when(feed & (kind == ""), go(_LINE))
        .when((t == "#") & (kind != "i"), go(_COMMENT, ret=F.when(kind == "a", _AFTER_VALUE).otherwise(_LINE)))
        .when((t == ",") & (kind == "a"), go(_VALUE))
        .when((t == ",") & (kind == "i"), go(_KEY, h=_INLINE, parts=none, path=F.slice(st["path"], 1, top.getField("n"))))
        .when(((t == "]") & (kind == "a")) | ((t == "}") & (kind == "i")), go(_AFTER_VALUE, stack=left, path=F.slice(st["path"], 1, top.getField("n"))))
        .otherwise(bad)
    )

    def ended(trail) -> Column:
        return go(_AFTER_VALUE, esc=False, **event("v", st["path"], mode=mode, s=st["s"], e=here, lead=F.when(mode.isin(_LONG_BASIC, _LONG_LITERAL), st["lead"]).otherwise(0), trail=trail))

    # An escaped quote is not one of those that end a string.
    quotes = F.when((mode.isin(_BASIC, _LONG_BASIC, _KEY_BASIC) & double) | (mode.isin(_LITERAL, _LONG_LITERAL, _KEY_LITERAL) & single), size).otherwise(0) - F.when(st["esc"] & double, 1).otherwise(0)
    long = mode.isin(_LONG_BASIC, _LONG_LITERAL)
    escapes = mode.isin(_BASIC, _LONG_BASIC, _KEY_BASIC)
    # A backslash may end a line of a long string, with blanks behind it.
    line_end = (mode == _LONG_BASIC) & (feed | (blank & (following == "\n")))
    name = _joined(tokens, st["s"], here)
    string = (
        F.when(st["esc"] & ~(double | (t == "\\") | t.rlike(_ESCAPE) | line_end), bad)
        .when((quotes >= 3) & (quotes <= 5) & long, ended(quotes - 3 + F.when(st["esc"], 1).otherwise(0)))
        .when((quotes > 5) & long, bad)
        .when(long | (quotes == 0), F.when(feed & ~long, bad).otherwise(go(mode, esc=escapes & (t == "\\") & ~st["esc"])))
        .when(quotes > 1, bad)
        .when(mode.isin(_BASIC, _LITERAL), ended(F.when(st["esc"], 1).otherwise(0)))
        .otherwise(
            go(
                _AFTER_KEY, esc=False,
                parts=F.concat(
                    st["parts"],
                    F.array(F.when(mode == _KEY_BASIC, _decode(F.concat(name, F.when(st["esc"], '"').otherwise("")))).otherwise(name)),
                ),
            )
        )
    )
    return (
        F.when(st["bad"], state)
        .when(mode >= _BASIC, string)
        .when(mode == _COMMENT, F.when(feed, go(st["ret"])).otherwise(same))
        .when(mode.isin(_SCALAR_ON, _AFTER_VALUE), after_value)
        .when(mode == _LINE, line)
        .when(mode == _AFTER_KEY, after_key)
        .when(mode == _VALUE, value)
        .when(mode == _KEY, F.when(blank, same).otherwise(key({"esc": F.lit(False)})))
        .when(mode == _FIRST_KEY, F.when(blank, same).when(t == "}", go(_AFTER_VALUE, stack=left, path=F.slice(st["path"], 1, top.getField("n")))).otherwise(key({"esc": F.lit(False)})))
        .when(mode == _LIST_OPEN, go(_KEY, h=_LIST_HEADER, parts=none))
        .when(mode == _LIST_CLOSE, go(_END))
        .otherwise(F.when(blank, same).when(feed, go(_LINE)).when(t == "#", go(_COMMENT, ret=_LINE)).otherwise(bad))
    )


def _named(paths: Column) -> Column:
    return F.transform(paths, lambda p: F.array_join(p, _JOIN))


def _parts_of(events: Column, kind: str) -> Column:
    return F.filter(events, lambda e: e.getField("kind") == kind)


def _prefixes(event: Column, low: Column) -> Column:
    """Paths that hold an event's path, from ``low`` names on, but for the inline tables it lies in."""
    path = event.getField("path")
    lengths = F.when(F.size(path) - 1 >= low, F.sequence(low, F.size(path) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array_except(lengths, event.getField("own")), lambda n: F.array_join(F.slice(path, 1, n), _JOIN))


def _clash(events: Column) -> Column:
    """Whether a name is given twice: as value, as table, as list of tables, or as table within a value.

    Each table of a list has names of its own, so names below lists are not compared.
    """
    lists = F.array_distinct(_named(F.transform(_parts_of(events, "a"), lambda e: e.getField("path"))))
    single = _let(lists, lambda a: F.filter(
        events,
        lambda e: (e.getField("kind") == "a") | (F.size(a) == 0) | (F.size(e.getField("path")) == 1) | ~F.arrays_overlap(
            a, F.transform(F.sequence(F.lit(1), F.size(e.getField("path")) - 1), lambda n: F.array_join(F.slice(e.getField("path"), 1, n), _JOIN))
        ),
    ))

    def judged(found: Column) -> Column:
        def names(kind: str) -> Column:
            return _named(F.transform(_parts_of(found, kind), lambda e: e.getField("path")))

        values, tables, lists = names("k"), names("t"), names("a")
        dotted = F.flatten(F.transform(_parts_of(found, "k"), lambda e: _prefixes(e, e.getField("base") + 1)))
        holders = F.flatten(F.transform(F.filter(found, lambda e: e.getField("kind") != "v"), lambda e: _prefixes(e, F.lit(1))))
        return reduce(
            or_,
            (
                F.size(F.array_distinct(values)) < F.size(values), F.size(F.array_distinct(tables)) < F.size(tables),
                F.arrays_overlap(values, F.concat(tables, lists, dotted, holders)), F.arrays_overlap(tables, F.concat(lists, dotted)),
                F.arrays_overlap(lists, dotted),
            ),
        )

    return _let(single, judged)


def toml_strings(text: Column, roots: tuple[str, ...] | None = None) -> Column:
    """Names and string values of a TOML text, in order: array of (path, value); value is null for tables and other values.

    With ``roots``, only paths that start with one of them. Null for a null or malformed text. Values in arrays and in lists of tables
    are left out. Names given twice make a text malformed where they are below ``roots``, outside lists of tables and outside arrays;
    others are not compared. Days are not checked against their month.
    """

    def value(tokens: Column, e: Column) -> Column:
        mode, kind = e.getField("mode"), e.getField("kind")
        quote = F.when(mode.isin(_BASIC, _LONG_BASIC), '"').otherwise("'")
        raw = F.concat(
            F.repeat(quote, e.getField("lead")), _joined(tokens, e.getField("s"), e.getField("e")), F.repeat(quote, e.getField("trail"))
        )
        cut = F.when(mode.isin(_LONG_BASIC, _LONG_LITERAL), F.regexp_replace(raw, r"\A\n", "")).otherwise(raw)
        return F.when(kind == "v", F.when(mode.isin(_BASIC, _LONG_BASIC), _decode(cut)).otherwise(cut))

    def read(tokens: Column) -> Column:
        zero = F.from_json(
            F.lit('{"m":0,"ret":0,"i":0,"s":0,"lead":0,"esc":false,"h":0,"bad":false,"parts":[],"table":[],"path":[],"stack":[],"found":[]}'),
            _STATE,
        )
        return _let(
            F.aggregate(tokens, zero, lambda state, t: _step(tokens, state, t, roots)),
            lambda end: F.when(
                ~end.getField("bad") & (end.getField("m") == _LINE),
                _let(
                    end.getField("found"),
                    lambda events: F.when(~_clash(events), _let(
                        F.array_distinct(F.transform(_parts_of(events, "a"), lambda a: a.getField("path"))),
                        lambda lists: F.transform(
                            F.filter(events, lambda e: ~F.exists(lists, lambda a: F.slice(e.getField("path"), 1, F.size(a)) == a)),
                            lambda e: F.struct(e.getField("path").alias("path"), value(tokens, e).alias("value")),
                        ),
                    )),
                ),
            ),
        )

    unified = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return _let(
        unified,
        lambda u: F.when(
            ~u.rlike(_CONTROL), _let(F.regexp_extract_all(F.concat(u, F.lit("\n")), F.lit(_TOKEN), 0), read)
        ),
    )
