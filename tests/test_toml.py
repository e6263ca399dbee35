"""Names and values of TOML texts, held against the standard library's reader, and the Cargo rules that use them."""

import random
import tomllib

from pyspark.sql import functions as F

from riskspark.functions.toml import MAX_NESTING, toml_strings
from riskspark.operators.scan import scan_config_sections

TEXTS = [
    '[package]\nname = "p"\nbuild = "b.rs"\n', "package = { name = \"x\", build = 'b.rs' }\n", 'package.build = "b.rs" # c\n',
    'a = """\nx ""y"" \\\n   z"""\n', "k = '''a'b''c'''''\n", '[[bin]]\nname="a"\n[[bin]]\nname="b"\n[bin.x]\ny="1"\n',
    "[a]\nb=1\n[a]\nc=2\n", '[a.b]\nx=1\n[a]\ny="2"\n', 'a.b="1"\n[a]\n', 'a={b="1"}\n[a.c]\n', "a=[]\n[[a]]\n", "a=1\na=2\n",
    'x=[1, "a", # c\n [2,3,],\n {q="1"}]\ny="z"\n', '"q\\u00e9.k"."" = "\\U0001F600\\t\\"x\\"\\\\"\n', "u=1__0\n", "u=_1\n", "u=01\n",
    "d=1979-05-27 07:32:00.5Z\nt=07:32:00\nf=6.626_1e-34\nh=0xdead_beef\nn=+inf\n", "[a]]\n", "[[a]\n", 'a="x\ny"\n', 'a="\\q"\n',
    "a=\n", "a=1 b=2\n", "a={}\nb=[]\n", "a={x=1,}\n", "a={x=1\n}\n", "", '# only\r\n\r\na="b"\r\n', 'a="b"\rc=1', 's=""""x"""""\n',
    "e=\"\"\nf=''\ng=\"\"\"\"\"\"\nh=''''''\n", '[source]\nx={replace-with="m"}\n[source.y]\nregistry="r"\n[alias]\nb="build"\nt=["a"]\n',
    'a."b.c".d = "1"\n[ a2 . "b" ]\nk="v"\n', "a=true\nb = false# c\nc=truex\n", "[a]\nb.c=1\n[a.b]\n", "[[a]]\n[a]\n", "[a]\n[[a]]\n",
    'a={b={c="d",e="f"},g="h"}\ni="j"\n', 'a."x\\u0041"="1"\naX=1\n', 'a={b.c="1",b.d="2"}\n', "a={b=1,b.c=2}\n", "=1\n", ".a=1\n",
    "a.=1\n", "a..b=1\n", "[]\n", "'a'='b'\n", '"""a"""="b"\n', 'a="b"c\n', 'a="\\ud800"\n', "a=1.\n", 'a="é"\né="x"\n',
    "a='\\'\nb='c'\n", 'a="""\\"""x"""\n', 'a="""x\\""""\n', 'a="x\\""\n"k\\""="v"\n', 'a="\\\\" #\n', 'a=1 # "\nb="2"\n',
]
PIECES = [
    "a", "b", ".", "=", '"', '"""', "'", "'''", "[", "]", "[[", "{", "}", ",", "#", "\n", " ", "1", "true", "\\", '"x"', "'y'",
    'a="x"\n', "[a]\n", 'b.c="1"\n', "u0041", "x = {", "\t", "[[l]]\n", 'n="v"\n',
]
FILE = "repo_id string, snapshot_id string, path string, text string"


def _plain(text):
    try:
        tree = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return None
    found, open_ = {}, [((), tree)]
    while open_:
        path, table = open_.pop()
        for name, value in table.items():
            if isinstance(value, dict):
                open_.append(((*path, name), value))
            elif isinstance(value, str):
                found[(*path, name)] = value
    return found


def _read(spark, texts, roots=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    found = {r.i: r.e for r in rows.select("i", toml_strings(F.col("t"), roots).alias("e")).collect()}
    return [
        None if found[i] is None else {tuple(e.path): e.value for e in found[i] if e.value is not None} for i in range(len(texts))
    ]


def test_as_the_standard_library_reads_them(spark):
    draw, texts = random.Random(11), list(TEXTS)
    for _ in range(600):
        text = "".join(draw.sample(TEXTS, draw.randint(1, 2)) if draw.random() < 0.6 else draw.choices(PIECES, k=draw.randint(1, 12)))
        for _ in range(draw.randint(0, 2)):
            at = draw.randint(0, len(text))
            text = text[:at] + draw.choice(PIECES) + text[at + draw.randint(0, 2):]
        texts.append(text)
    expected = [_plain(t) for t in texts]
    assert sum(e is not None for e in expected) > 60
    assert [(t, g) for t, g, e in zip(texts, _read(spark, texts), expected) if g != e] == []


def test_long_deep_and_missing_texts(spark):
    many = "".join(f'[t{i}]\nk{i} = "v{i}" # c\n' for i in range(20_000)) + '[package]\nbuild = "b.rs"\n'
    long = 'package.build = """' + 'x\\"y ' * 50_000 + '"""\n'
    deep, deeper = ("package.x = " + "[" * n + "]" * n + '\npackage.build = "b"\n' for n in (MAX_NESTING, MAX_NESTING + 1))
    got = _read(spark, [many, long, deep, deeper, None], ("package",))
    assert got == [
        {("package", "build"): "b.rs"}, {("package", "build"): 'x"y ' * 50_000}, {("package", "build"): "b"}, None, None,
    ]


def test_cargo_rules(spark):
    files = {
        "inline": ("Cargo.toml", 'package = { name = "p", build = "b.rs" }\n'),
        "dotted": ("sub/Cargo.toml", "package.build = 'b.rs'\r\n"),
        "in a string": ("Cargo.toml", 'description = """\n[package]\nbuild = "b.rs"\n"""\n'),
        "list of tables": ("Cargo.toml", '[[package]]\nbuild = "b.rs"\n'),
        "malformed": ("Cargo.toml", '[package]\nbuild = "b.rs"\nname = \n'),
        "given twice": ("Cargo.toml", '[package]\nbuild = "b.rs"\n[package]\n'),
        "not a string": ("Cargo.toml", "[package]\nbuild = false\n"),
        "empty": ("Cargo.toml", ""),
        "null": ("Cargo.toml", None),
        "configuration": (
            ".cargo/config.toml",
            '[source]\nb = { registry = "r", replace-with = "m" }\n[source.a]\ndirectory = "d"\n[source.c]\nx = 1\n'
            '[alias]\n"q r" = "build \\"x\\""\nlist = ["run"]\n',
        ),
        "malformed configuration": (".cargo/config.toml", '[alias]\nb = "build"\nc = "x\n'),
    }
    rows = spark.createDataFrame([(repo, "s", path, text) for repo, (path, text) in files.items()], FILE)
    found = {}
    for r in scan_config_sections(rows).orderBy("repo_id", "rule_ord", "match_ord").collect():
        found.setdefault(r.repo_id, []).append((r.rule_id, r.line, r.evidence))
    assert found == {
        "inline": [("RUST_BUILD_SCRIPT", 1, 'package.build = "b.rs"')],
        "dotted": [("RUST_BUILD_SCRIPT", 1, 'package.build = "b.rs"')],
        "configuration": [
            ("RUST_CARGO_SOURCE_REPLACEMENT", 1, "source.b: replace-with=m"),
            ("RUST_CARGO_SOURCE_REPLACEMENT", 1, "source.a: directory=d"),
            ("RUST_CARGO_ALIAS", 8, 'q r: build "x"'),
        ],
    }
