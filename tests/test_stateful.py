"""Ledgers over streams: states that run empty."""

from workload.q_streaming import settle, stream_of
from workload.registry import Tables

from riskspark.streaming.stateful import stream_approvals, stream_state_machine

CHALLENGE = "manager string, event_id long, challenge_id string, action string, ts timestamp"


def _challenges(spark, folder, rows):
    events = spark.createDataFrame(rows, "event_id long, manager string, challenge_id string, action string, second long")
    events = events.selectExpr("manager", "event_id", "challenge_id", "action", "timestamp_seconds(1700000000 + second) AS ts")
    events.write.parquet(f"file://{folder}/events")
    stored = spark.read.schema(CHALLENGE).parquet(f"file://{folder}/events")
    return {r.event_id: (r.outcome, r.live) for r in settle(Tables(spark, "none"), stream_state_machine(stream_of(Tables(spark, "none"), stored))).collect()}


def test_a_ledger_without_recent_issues_goes_on(spark, tmp_path):
    rows = [
        (1, "a", "x", "issue", 0), (2, "a", "x", "consume", 100),  # the issue is out of the rate window
        (3, "b", "y", "consume", 0),  # never issued
        (4, "c", "z", "issue", 0), (5, "c", "z", "consume", 400),  # expired: nothing is live either
    ]
    assert _challenges(spark, tmp_path, rows) == {
        1: ("issued", 1), 2: ("consumed", 1), 3: ("unknown", 0), 4: ("issued", 1), 5: ("expired", 0),
    }


def test_events_without_a_time_change_nothing(spark, tmp_path):
    rows = [(1, "a", "x", "issue", None), (2, "a", "x", "consume", 5), (3, "a", "x", "issue", 6), (4, "a", "x", "consume", None), (5, "a", "x", "consume", 7)]
    assert _challenges(spark, tmp_path, rows) == {
        1: ("undated", 0), 2: ("unknown", 0), 3: ("issued", 1), 4: ("undated", 0), 5: ("consumed", 1),
    }


def test_approvals_keep_time_order_across_keys(spark, tmp_path):
    rows = [
        (3, "k", "e", "approve", 20, 5, 1), (1, "k", "e", "approve", 0, 10, 1), (2, "k", "e", "approve", 5, 10, 1),
        (4, "k", "e", "revoke", 21, 5, 2), (5, "k", "e", "revoke", 22, 5, 1), (6, "k", "e", "revoke", 23, 5, 1),
        (7, "j", "e", "revoke", 1, 5, 1), (8, None, "e", "approve", 1, 5, 1), (9, None, "f", "revoke", 2, 5, 1),
    ]
    events = spark.createDataFrame(rows, "event_id long, approval_key string, entry_id string, action string, second long, life long, expected_version long")
    events = events.selectExpr("*", "timestamp_seconds(1700000000 + second) AS ts", "timestamp_seconds(1700000000 + second + life) AS expires_at")
    events.write.parquet(f"file://{tmp_path}/events")
    tables = Tables(spark, "none")
    out = settle(tables, stream_approvals(stream_of(tables, spark.read.parquet(f"file://{tmp_path}/events")))).collect()
    assert {r.event_id: r.outcome for r in out} == {
        1: "approved", 2: "already-approved", 3: "approved", 4: "version-conflict", 5: "revoked", 6: "not-found", 7: "not-found",
        8: "approved", 9: "not-found",
    }
    assert all((r.ts.timestamp() - 1700000000) == {x[0]: x[4] for x in rows}[r.event_id] for r in out)
