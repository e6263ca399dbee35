"""Reading approvals: entries without an identifier are not gathered, and repeated identifiers are still refused."""

import json

from pyspark.sql import functions as F

from riskspark.sources import approvals as SA


def _entry(number, entry_id=None):
    made = {name: f"{name}-{number}" for name in SA.APPROVAL_FIELDS} | {
        "remoteUrl": None, "headCommit": None, "criticalFingerprint": "sha256:" + "a" * 64, "commandScope": "build", "decision": "USER_APPROVED",
        "approvedAt": "2026-01-01T00:00:00Z", "expiresAt": "2026-02-01T00:00:00Z", "approvedBy": "local-user",
    }
    if entry_id:
        made |= {"entryId": entry_id, "entryVersion": 1, "provenance": {
            "schema": SA.SCHEMA, "source": "cli-trust-approve", "migrationVersion": SA.MIGRATION_VERSION, "createdAt": "2026-01-01T00:00:00Z"}}
    return json.dumps(made)


def test_entries_without_an_identifier_stay_spread(spark):
    name = "{:08d}-0000-4000-a000-000000000000".format
    values = [_entry(i) for i in range(400)] + [_entry(i, name(i % 30)) for i in range(400, 431)] + [None, "no json"]
    lines = spark.createDataFrame([(v,) for v in values], "value string").repartition(8)
    put, kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}, {}
    for key, value in put.items():
        kept[key] = spark.conf.get(key)
        spark.conf.set(key, value)
    try:
        good, bad = SA.parse_approvals(lines)
        spread = good.where("entry_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in spread) == 400 and max(r["count"] for r in spread) < 200
        assert sorted(r.entry_id for r in good.where("entry_id IS NOT NULL").collect()) == sorted(name(i) for i in range(30) if i != 10)
        assert sorted((r.error_code, r.entry is None) for r in bad.collect()) == [("corrupt", False)] * 3 + [("corrupt", True)]
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
