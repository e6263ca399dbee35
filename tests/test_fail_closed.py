"""Files that cannot be read or parsed, and one node budget for scripts and files."""

import pytest
from pyspark.sql import functions as F

from riskspark.functions.text import is_json_object
from riskspark.plans.assess import assess

FILE = "repo_id string, snapshot_id string, path string, mode string, size_bytes long, content binary"
COMMAND = "command_id string, repo_id string, snapshot_id string, command string"


def _assessed(spark, repos, commands, **limits):
    files = [(r, "s", p, "100644", len(c), bytearray(c)) for r, tree in repos.items() for p, c in tree.items()]
    table = spark.createDataFrame([(str(i), r, "s", c) for i, (r, c) in enumerate(commands)], COMMAND)
    analysis = assess(spark.createDataFrame(files, FILE), table, **limits)
    rows = analysis.per_command(table).select("repo_id", "command", "decision").collect()
    owner = {r.plan_id: (r.repo_id, r.command) for r in analysis.plans.collect()}
    doubts = {}
    for r in analysis.graph.uncertainties.collect():
        doubts.setdefault(owner[r.plan_id], set()).add((r.rule_id, r.file, r.reason))
    nodes = {}
    for r in analysis.graph.nodes.collect():
        nodes.setdefault(owner[r.plan_id], []).append(r.label)
    return {(r.repo_id, r.command): r.decision for r in rows}, doubts, nodes


def test_json_objects(spark):
    texts = {
        '{"a": 1}': True, ' \n\t{"a": [1, {"b": "}"}]}\n': True, '{"a": 1, "a": 2}': True, '{"a": NaN}': True, "{}": True,
        '{"a": 1} x': False, '{"a": 1}{"b": 2}': False, '{"a": 1}, {"b": 2}': False, '{"a": 1}] x': False, '{"a": 1}} x': False,
        '1,"end":1} x': False, '{"a": 1},"end":1} x': False, '{"a": 1': False, "": False, "[1]": False, '"x"': False, "null": False, "{'a': 1}": False,
        '{"a": "x\ty"}': False, "{bad json": False, '{"a": 1,}': False, "// c\n{}": False, "{} // c": False, '{"a": "😀 "}'.encode("utf-16", "surrogatepass").decode("utf-16"): True,
    }
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", is_json_object(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in rows} == {**texts, None: False}


@pytest.fixture(scope="module")
def outcome(spark):
    binary = b"\x00\x01 not text"
    repos = {
        "broken": {"package.json": b"{bad json"},
        "rest": {"package.json": b'{"scripts": {"build": "tsc"}} trailing', "README.md": b"x"},
        "binary": {"package.json": binary},
        "deep": {"package.json": b'{"scripts": {"go": "echo x"}}', "pkg/a/package.json": b"{", "node_modules/b/package.json": b"{", "fix/.scan-fixtures": b"", "fix/package.json": b"{"},
        "sound": {"package.json": b'{"name": "x"}'},
        "cargo": {"Cargo.toml": binary, "build.rs": b"fn main() {}"},
        "ruby": {"Gemfile": binary}, "maven": {"pom.xml": binary}, "gomod": {"go.mod": binary},
    }
    installs = [(r, "npm install") for r in ("broken", "rest", "binary", "deep", "sound")]
    builds = [("broken", "npm run build"), ("rest", "npm test"), ("deep", "npm run go"), ("sound", "npm run build"), ("deep", 'sh -c "npm run go"')]
    tools = [("cargo", "cargo build"), ("ruby", "bundle install"), ("maven", "mvn test"), ("gomod", "go test ./..."), ("broken", "git status")]
    return _assessed(spark, repos, installs + builds + tools)


def test_broken_manifests_ask_the_user(outcome):
    decisions, doubts, _nodes = outcome
    parse = lambda path, what="parse": ("SCRIPT_PARSE_UNCERTAIN", path, f"Could not {what} package.json.")
    for key, path, what in (
        (("broken", "npm install"), "package.json", "parse"), (("rest", "npm install"), "package.json", "parse"), (("binary", "npm install"), "package.json", "read"),
        (("broken", "npm run build"), "package.json", "parse"), (("rest", "npm test"), "package.json", "parse"),
        (("deep", "npm install"), "pkg/a/package.json", "parse"), (("deep", "npm run go"), "pkg/a/package.json", "parse"),
    ):
        assert parse(path, what) in doubts[key], key
        assert decisions[key] == "ASK_USER", key
    # directories that are skipped or marked raise nothing, nor do sound files and commands that read none
    assert {d[1] for d in doubts[("deep", "npm install")]} == {"pkg/a/package.json"}
    assert ("sound", "npm install") not in doubts and ("broken", "git status") not in doubts
    assert decisions[("sound", "npm install")] != "ASK_USER"


def test_unreadable_project_files_are_doubts(outcome):
    _decisions, doubts, _nodes = outcome
    for key, path in (
        (("cargo", "cargo build"), "Cargo.toml"), (("ruby", "bundle install"), "Gemfile"), (("maven", "mvn test"), "pom.xml"), (("gomod", "go test ./..."), "go.mod"),
    ):
        assert ("SCRIPT_PARSE_UNCERTAIN", path, "Could not read ecosystem file.") in doubts[key], key


@pytest.mark.parametrize("limit", [4, None])
def test_scripts_and_files_share_one_budget(spark, limit):
    scripts = {f"s{i}": f"npm run s{i + 1}" for i in range(8)} | {"s8": "sh -c '" + " && ".join(f"bash f{i}.sh" for i in range(6)) + "'"}
    body = "{\"scripts\": {" + ", ".join(f'"{n}": "{c}"' for n, c in scripts.items()) + "}}"
    tree = {"package.json": body.encode()} | {f"f{i}.sh": b"echo x\n" for i in range(6)}
    _decisions, doubts, nodes = _assessed(spark, {"r": tree}, [("r", "npm run s0")], max_nodes=limit)
    key = ("r", "npm run s0")
    over = [d for d in doubts.get(key, ()) if d[0] == "SCRIPT_NODE_BUDGET_EXCEEDED"]
    if limit is None:
        assert len(nodes[key]) == 1 + 9 + 6 and not over
    else:
        assert len(nodes[key]) == limit and len(over) == 1 and f"({limit}/{limit})" in over[0][2]
