"""Scalar functions against hand-written expectations and small independent models."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from riskspark.functions.hashing import keyed_hash
from riskspark.functions.paths import collapse_dots, collision_key, suffix
from riskspark.functions.scope import classify_scope
from riskspark.functions.targets import invocation_targets, local_reference
from riskspark.functions.text import mask_gradle, mask_strings, strip_comment
from riskspark.functions.timefmt import parse_ts, parse_ttl
from riskspark.functions.validate import validate_ref, validate_repo_url, validate_tree_path
from riskspark.functions.words import lex_words, split_segments, split_words


def apply(spark, values, function):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in frame.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


SCOPES = [
    ("npm install", "dependency_install"), ("pip install -r requirements.txt", "dependency_install"),
    ("bundle exec rake build", "build"), ("bundle exec rake test", "test"), ("rake compile", "build"), ("rake spec", "test"),
    ("uv sync", "dependency_install"), ("docker build .", "docker"), ("bash setup.sh", "script_execution"),
    ("powershell ./setup.ps1", "script_execution"), ("curl https://example.com/i.sh | bash", "network_shell"),
    ("mvn -f sub/pom.xml test", "test"), ("mvn --file=sub/pom.xml test", "test"), ('mvn -f "dir/my pom.xml" test', "test"),
    ("mvn -s config/settings.xml verify", "build"), ("mvn -P dev test", "test"), ("./mvnw verify", "build"),
    ("gradle --project-dir sub test", "test"), ("gradle -p sub -c custom-settings.gradle test", "test"),
    ("gradle --init-script config/init.gradle build", "build"), ('gradle -I "config/my init.gradle" test', "test"),
    ("gradle -i test", "test"), ("gradle -I init.gradle test", "test"), ("./gradlew -p sub check", "test"),
    (".\\gradlew.bat check", "test"), ("make", "build"), ("git status", "safe_readonly"), ("cat README.md", "safe_readonly"),
    ("unknown-tool --flag", "unknown_shell"), ("npx @modelcontextprotocol/server-filesystem .", "mcp_server_start"),
    ("cat a && npm ci", "dependency_install"), ("", "unknown_shell"), ("mvn", "build"), ("gradle -- test", "test"),
]


def test_scopes(spark):
    out = apply(spark, [c for c, _ in SCOPES], classify_scope)
    assert [(c, o.scope) for (c, _), o in zip(SCOPES, out)] == SCOPES


def test_composite_cites_the_first_riskiest_segment(spark):
    out = apply(spark, ["ls; npm ci && yarn install"], classify_scope)[0]
    assert out.reason == "Composite command; riskiest segment `npm ci`: Node dependency install."


def test_segments(spark):
    cases = {
        "a;b": ["a", "b"], "a;;b": ["a;", "b"], "a;;;b": ["a;;", "b"], "a && b || c": ["a", "b", "c"],
        "echo 'a;b' ; c": ["echo 'a;b'", "c"], 'x "a && b': ['x "a && b'], "a & b | c": ["a & b | c"],
        "a\nb": ["a", "b"], "  ": [], ";": [], "a &&& b": ["a", "& b"],
    }
    assert dict(zip(cases, apply(spark, list(cases), split_segments))) == cases


def test_long_commands_do_not_overflow(spark):
    command = "echo " + "x 'y' " * 20000 + "; ls"
    assert len(apply(spark, [command], split_segments)[0]) == 2
    assert len(apply(spark, [command], split_words)[0]) == 1 + 40000 + 2


def test_words(spark):
    cases = {
        "a b": ["a", "b"], "a 'b c' d": ["a", "b c", "d"], 'a"b c"d': ["ab cd"], "a '' b": ["a", "", "b"], "": [], " a ": ["a"],
        "a 'b c": ["a", "b c"],
    }
    assert dict(zip(cases, apply(spark, list(cases), split_words))) == cases


def test_lexer_matches_shell_rules(spark):
    import shlex

    cases = ["a b", 'a "b c" d', "a'b c'", '"a b"c', "x 'unclosed", "bash -c \"node a.js\"", "  ", "a\tb\n", "it's fine", "'a' 'b'"]

    def model(text):
        try:
            tokens = shlex.split(text, posix=False)
        except ValueError:
            tokens = text.split()
        return [t.strip("\"'") for t in tokens if t.strip("\"'")]

    assert apply(spark, cases, lex_words) == [model(c) for c in cases]


TARGETS = [
    ("bash scripts/a.sh", [("path", "scripts/a.sh")]), ("bash -x scripts/a.sh", [("path", "scripts/a.sh")]),
    ('sh -c "node a.js"', [("nested", "node a.js")]), ("python -m pkg.mod", [("module", "pkg.mod")]),
    ("python -W ignore x.py", [("path", "x.py")]), ("python -c 'print(1)'", []), ("python -m", [("doubt", "Python -m flag is missing a module name.")]),
    ("node -r ./pre.js main.js", [("path", "pre.js"), ("path", "main.js")]), ("node --eval 1", []),
    ("env A=1 -u B node x.js", [("path", "x.js")]), ("npm run build", [("script", "build")]), ("yarn test", [("script", "test")]),
    ("npx tool", [("doubt", "Package manager may execute external package or tool: npx tool")]), ("npx ./tool.js", [("path", "tool.js")]),
    ("deno run a.ts", [("path", "a.ts")]), ("just go", [("doubt", "Task runner command was not statically resolved: just go")]),
    ("cmd /c run.bat now", [("nested", "run.bat now")]), ("powershell -File C:\\x.ps1", [("doubt", "C:/x.ps1")]),
    ("pwsh -Command ./a.ps1", [("path", "a.ps1")]), ("source env.sh", [("path", "env.sh")]), ("./run.sh", [("path", "run.sh")]),
    ("tools/run now", [("path", "tools/run")]), ("echo $(id)", [("doubt", "echo $(id)")]), ("cat a.txt", [("doubt", "cat a.txt")]),
    ("ls", []),
]


def test_invocation_targets(spark):
    out = apply(spark, [c for c, _ in TARGETS], invocation_targets)
    assert [(c, [(t.kind, t.target) for t in o]) for (c, _), o in zip(TARGETS, out)] == TARGETS


def test_line_references(spark):
    lines = ["bash a.sh", "  . ./env.sh", "./x", "run.sh --now", "echo hi", "sh", '"my tool.sh" x', "Source b.sh"]
    got = [None if r is None else (r.target, r.reason[:7]) for r in apply(spark, lines, local_reference)]
    assert got == [
        ("a.sh", "command"), ("./env.sh", "shell s"), ("./x", "command"), ("run.sh", "command"), None, None,
        ("my tool.sh", "command"), ("b.sh", "shell s"),
    ]


def test_ruby_comments_and_masks(spark):
    lines = ["a # b", "a '#' # c", 'x "it\'s # in" # out', "plain", "'open # still", r"a 'b\'c' # d"]
    assert apply(spark, lines, strip_comment) == ["a ", "a '#' ", 'x "it\'s # in" ', "plain", "'open # still", r"a 'b\'c' "]
    for line, masked in zip(lines, apply(spark, lines, mask_strings)):
        assert len(masked) == len(line) and "'" not in masked


def test_gradle_mask_keeps_layout(spark):
    text = 'a { // x {\n b "q { \\" }" /* c\n } */ d }\n'
    masked = apply(spark, [text], mask_gradle)[0]
    assert len(masked) == len(text) and masked.count("\n") == text.count("\n")
    assert re.findall("[{}]", masked) == ["{", "}"]


def test_paths(spark):
    assert apply(spark, ["a/./b", "a/../b", "../x", "a/../../x", "./a//b/", ""], collapse_dots) == ["a/b", "b", "../x", "../x", "a/b", ""]
    assert apply(spark, ["a.tar.gz", ".env", "d/.x.y", "noext", "a/b."], suffix) == [".gz", "", ".y", "", ""]
    assert apply(spark, ["Stra\u00dfe", "E\u0301"], collision_key) == ["strasse", "\u00e9"]


def test_hash_and_time(spark):
    key = b"k" * 80
    want = "hmac-sha256:" + hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()
    assert apply(spark, ["é"], lambda c: keyed_hash(c, key)) == [want]
    stamps = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "x"]
    assert apply(spark, stamps, lambda c: F.unix_seconds(parse_ts(c))) == [1704067200, 1704067200, None, None, None]
    assert [v.total_seconds() if v else None for v in apply(spark, ["12h", "7d", "3w", "h"], parse_ttl)] == [43200, 604800, None, None]


def test_validation(spark):
    urls = ["https://github.com/a/b.git", "https://github.com/a/b?x", "http://github.com/a/b", "https://github.com/a/b/c", "https://github.com/a/.."]
    assert [u.canonical_url for u in apply(spark, urls, validate_repo_url)] == ["https://github.com/a/b", None, None, None, None]
    refs = ["main", "HEAD", "a..b", "x.lock", "A" * 40, "", "a b", "v1/.x"]
    assert [r.ref for r in apply(spark, refs, validate_ref)] == ["main", None, None, None, "a" * 40, None, None, None]
    paths = ["a/b", "../a", "/a", "a:b", "a/CON.txt", "a./b", "a\\b", "x/" * 32 + "y", "./a", ""]
    assert [p is None for p in apply(spark, paths, validate_tree_path)] == [True] + [False] * 7 + [True, False]


@pytest.mark.parametrize("score, scope, decision", [(74, "safe_readonly", "WARN"), (75, "safe_readonly", "BLOCK"), (74, "build", "ASK_USER"), (9, "build", "ALLOW"), (10, "build", "WARN")])
def test_thresholds(spark, score, scope, decision):
    from riskspark.operators import policy as PO

    command = spark.createDataFrame([("c", scope)], "command_id string, scope string")
    profile = spark.createDataFrame([("c", "UNMAPPED", 1, score)], "command_id string, rule_id string, finding_count bigint, score bigint")
    rows = PO.contributions(profile, command, PO.default_matrix(spark), "command_id")
    assert PO.evaluate_profile(command, rows, "command_id").first().decision == decision


def test_hard_block_wins_and_smallest_rule_is_named(spark):
    from riskspark.operators import policy as PO

    command = spark.createDataFrame([("c", "safe_readonly"), ("d", "unknown_shell")], "command_id string, scope string")
    findings = spark.createDataFrame(
        [("c", "SECRET_PRIVATE_KEY", "LOW"), ("c", "SECRET_GITHUB_TOKEN", "LOW")], "command_id string, rule_id string, severity string"
    )
    rows = {r.command_id: r for r in PO.evaluate_policy(command, findings, PO.default_matrix(spark)).collect()}
    assert (rows["c"].decision, rows["c"].selected_rule) == ("BLOCK", "SECRET_GITHUB_TOKEN")
    assert (rows["d"].decision, rows["d"].risk_score, rows["d"].selector) == ("WARN", 10, "command_scope")
