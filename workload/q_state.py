"""Stored state: S1, S6-S8, S10, S11, A10, A13-A16, A19, J4, J13, J16, K1-K3, P6, P14, U2, W4-W6."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.functions.hashing import canonical_json
from riskspark.operators import approvals as AP
from riskspark.operators import audit as AU
from riskspark.operators import files as FS
from riskspark.session import cut, scratch_path
from riskspark.sources import approvals as SA
from riskspark.sources import audit as SAU
from riskspark.sources import repo as RS
from riskspark.sources import results as RE
from workload.q_commands import KEY
from workload.registry import Tables, define, query

NOW = "2024-01-20 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def micros(column: str):
    return F.unix_micros(column)


@query("s1_read_repo_files", "SELECT repo_id, path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS digest FROM files")
def s1(t: Tables):
    """Files laid out as a tree by tasks in the shared folder, then read back level by level."""
    root = scratch_path(t.spark, "tree").removeprefix("file://").removeprefix("file:")

    def lay_out(rows):
        import os

        for row in rows:
            target = f"{root}/{row.repo_id}/{row.path}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as out:
                out.write(row.content)

    t.raw_files.select("repo_id", "path", "content").foreachPartition(lay_out)
    return RS.read_repo_files(t.spark, root).select(
        "repo_id", "path", "size_bytes", F.sha2("content", 256).alias("digest")
    )


@query("k1_order_files", "SELECT repo_id, path FROM files ORDER BY repo_id, path")
def k1(t: Tables):
    return FS.order_files(t.files).select("repo_id", "path")


@query("u2_union_files", "SELECT DISTINCT repo_id, path FROM files WHERE starts_with(path, 'scripts/') OR ends_with(path, '.sh')")
def u2(t: Tables):
    listed = t.files.select("repo_id", "path")
    return FS.union_files(listed.where(F.col("path").startswith("scripts/")), listed.where(F.col("path").endswith(".sh")))


@query("a10_fingerprint", """
  SELECT repo_id, snapshot_id, 'sha256:' || sha256(string_agg(path || ':' || sha256(text), chr(10) ORDER BY path)) AS fingerprint,
         NULL AS error_code FROM files GROUP BY repo_id, snapshot_id""")
def a10(t: Tables):
    return FS.fingerprint(t.raw_files)


@query("a10_fingerprint_limit", """
  SELECT source AS repo_id, 's' AS snapshot_id, CASE WHEN count(*) <= 60 THEN 'sha256:' || sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) END AS fingerprint,
         CASE WHEN count(*) > 60 THEN 'limit-exceeded' END AS error_code FROM documents GROUP BY source""")
def a10_limit(t: Tables):
    rows = t.given("documents").select(
        F.col("source").alias("repo_id"), F.lit("s").alias("snapshot_id"), F.col("doc_id").cast("string").alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return FS.fingerprint(rows, max_files=60)


define("kinds", """
  SELECT *, CASE WHEN mode = '160000' THEN 'submodule' WHEN mode = '120000' THEN 'symlink' WHEN starts_with(head, 'version https') THEN 'lfs' ELSE 'regular' END AS kind FROM manifest""")


@query("a13_snapshot_usage", """
  SELECT repo_id, snapshot_id, CAST(sum(CASE WHEN kind IN ('regular', 'lfs') THEN size_bytes ELSE 0 END) AS BIGINT) AS materialized_bytes,
         count(*) FILTER (kind IN ('regular', 'lfs')) AS materialized_files, CAST(max(len(string_split(path, '/'))) AS INTEGER) AS max_path_depth,
         count(*) FILTER (kind = 'symlink') AS skipped_symlinks, count(*) FILTER (kind = 'submodule') AS skipped_submodules,
         count(*) FILTER (kind = 'lfs') AS skipped_lfs_pointers FROM kinds GROUP BY repo_id, snapshot_id""")
def a13(t: Tables):
    return FS.snapshot_usage(t.manifest)


@query("a14_path_collisions", """
  SELECT repo_id, lower(path) AS collision_key, count(*) AS paths, min(path) AS first_path, max(path) AS last_path FROM manifest GROUP BY repo_id, lower(path) HAVING count(*) > 1""")
def a14(t: Tables):
    return FS.path_collisions(t.manifest).drop("snapshot_id")


@query("a15_limit_breaches", """
  SELECT repo_id, limit_name, value, maximum FROM (
    SELECT repo_id, unnest(['files', 'total_bytes', 'file_bytes']) AS limit_name,
           unnest([count(*), CAST(sum(CASE WHEN mode IN ('100644', '100755') THEN size_bytes ELSE 0 END) AS BIGINT), max(CASE WHEN mode IN ('100644', '100755') THEN size_bytes ELSE 0 END)]) AS value,
           unnest([CAST(5000 AS BIGINT), 33554432, 1048576]) AS maximum FROM manifest GROUP BY repo_id) WHERE value > maximum""")
def a15(t: Tables):
    return FS.limit_breaches(t.manifest).drop("snapshot_id")


@query("s11_read_snapshot_manifest", """
  SELECT mode, object_type, object_id, CASE WHEN mode <> '160000' THEN size_bytes END AS size_bytes, path, NULL AS error_code FROM manifest WHERE NOT starts_with(path, '../')
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'MCP_REMOTE_TREE_UNSAFE' FROM manifest WHERE starts_with(path, '../')""")
def s11(t: Tables):
    """Listings written with NUL separators, one per tree, and parsed; some lines are damaged."""
    path = scratch_path(t.spark, "listing")
    size = F.when(F.col("mode") == "160000", F.lit("-")).otherwise(F.col("size_bytes").cast("string"))
    separator = F.when(F.col("path").startswith("../"), F.lit(" ")).otherwise(F.lit("\t"))
    line = F.concat(F.concat_ws(" ", "mode", "object_type", "object_id", size), separator, "path")
    t.manifest.select(line.alias("value"), "repo_id").write.option("lineSep", "\0").partitionBy("repo_id").text(path)
    good, bad = RS.read_snapshot_manifest(t.spark, path)
    columns = ["mode", "object_type", "object_id", "size_bytes", "path"]
    return good.select(*columns, F.lit(None).cast("string").alias("error_code")).unionByName(
        bad.select("error_code"), allowMissingColumns=True
    )


# ---- approvals ------------------------------------------------------------------------------


def _entry(t: Tables):
    """Stored form of derived approvals; some rows are damaged or legacy on purpose."""
    zulu = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    legacy = F.col("event_id") % 5 == 0
    provenance = F.struct(
        F.col("provenance.schema").alias("schema"), F.lit("cli-trust-approve").alias("source"),
        F.col("provenance.migration_version").alias("migrationVersion"), zulu("approved_at").alias("createdAt"),
    )
    common = dict(
        repoId="repo_id", path="path", remoteUrl="remote_url", headCommit="head_commit", criticalFingerprint="critical_fingerprint",
        approvedCommand="approved_command", approvedBy="approved_by", policyVersion="policy_version", rulesetVersion="ruleset_version",
    )
    fields = [F.col(v).alias(k) for k, v in common.items()] + [
        F.when(F.col("event_id") % 7 == 0, F.lit("everything")).otherwise(F.col("command_scope")).alias("commandScope"),
        F.col("decision"), zulu("approved_at").alias("approvedAt"), zulu("expires_at").alias("expiresAt"),
    ]
    version = F.when(F.col("event_id") % 11 == 0, F.lit(2)).otherwise(F.lit(1)).alias("entryVersion")
    options = {"ignoreNullFields": "false"}
    full = F.to_json(F.struct(*fields, F.col("entry_id").alias("entryId"), version, provenance.alias("provenance")), options)
    return t.approvals.select("event_id", F.when(legacy, F.to_json(F.struct(*fields), options)).otherwise(full).alias("value"))


@query("s6_read_approvals", """
  SELECT CASE WHEN mod(event_id, 7) = 0 THEN 'corrupt' WHEN mod(event_id, 5) <> 0 AND mod(event_id, 11) = 0 THEN 'unsupported-schema' END AS error_code,
         CASE WHEN mod(event_id, 7) <> 0 AND NOT (mod(event_id, 5) <> 0 AND mod(event_id, 11) = 0) THEN repo_id END AS repo_id, count(*) AS n FROM approvals GROUP BY ALL""")
def s6(t: Tables):
    path = scratch_path(t.spark, "approvals")
    _entry(t).select("value").write.text(path)
    good, bad = SA.read_approvals(t.spark, path)
    rows = good.select(F.lit(None).cast("string").alias("error_code"), "repo_id").unionByName(
        bad.select("error_code", F.lit(None).cast("string").alias("repo_id"))
    )
    return rows.groupBy("error_code", "repo_id").agg(F.count("*").alias("n"))


@query("s10_migrate_approvals", """
  SELECT repo_id, true AS all_uuid4, true AS stable, count(*) FILTER (mod(event_id, 5) = 0) AS migrated, count(*) AS n
  FROM approvals WHERE mod(event_id, 7) <> 0 AND NOT (mod(event_id, 5) <> 0 AND mod(event_id, 11) = 0) GROUP BY repo_id""")
def s10(t: Tables):
    from riskspark.functions.validate import is_uuid4

    good, _bad = SA.parse_approvals(_entry(t).select("value"))
    once = cut(SA.migrate_approvals(cut(good), now()))
    twice = SA.migrate_approvals(once.withColumn("first_id", F.col("entry_id")), now())
    return twice.groupBy("repo_id").agg(
        F.bool_and(is_uuid4(F.col("entry_id"))).alias("all_uuid4"),
        F.bool_and(F.col("first_id") == F.col("entry_id")).alias("stable"),
        F.count_if(F.col("provenance.source") == "legacy-migration").alias("migrated"),
        F.count("*").alias("n"),
    )


@query("p6_filter_approvals", "SELECT event_id FROM approvals WHERE repo_id = 'repo-1' AND command_scope = 'build'")
def p6(t: Tables):
    return AP.filter_approvals(t.approvals, "repo-1", "build").select("event_id")


_HMAC = (
    f"'hmac-sha256:' || sha256(unhex('{bytes(b ^ 0x5C for b in KEY.ljust(64, bytes(1))).hex()}') || "
    f"unhex(sha256(unhex('{bytes(b ^ 0x36 for b in KEY.ljust(64, bytes(1))).hex()}') || encode({{}}))))"
)
define("public", f"""
  SELECT entry_id, epoch_us(expires_at) AS expires, {_HMAC.format('repo_id')} AS repo_id_hash, remote_url IS NOT NULL AS has_remote_url,
         CASE WHEN remote_url IS NOT NULL THEN {_HMAC.format('remote_url')} END AS remote_url_hash, command_scope, policy_version, ruleset_version, critical_fingerprint,
         mod(event_id, 3) = 0 AS migrated FROM approvals""")


@query("p14_redact_public", "SELECT entry_id, expires, repo_id_hash, has_remote_url, remote_url_hash, command_scope, migrated FROM public")
def p14(t: Tables):
    return AP.redact_public(t.approvals, KEY).select(
        "entry_id", micros("expires_at").alias("expires"), "repo_id_hash", "has_remote_url", "remote_url_hash", "command_scope",
        F.col("provenance.migrated").alias("migrated"),
    )


_ORDER = "expires, repo_id_hash, command_scope, policy_version, ruleset_version, critical_fingerprint, entry_id"


@query("k2_order_approvals", f"SELECT entry_id, expires FROM public ORDER BY {_ORDER}")
def k2(t: Tables):
    return AP.order_approvals(AP.redact_public(t.approvals, KEY)).select("entry_id", micros("expires_at").alias("expires"))


@query("k3_page_approvals", f"SELECT entry_id, expires, false AS complete FROM public ORDER BY {_ORDER} LIMIT 50 OFFSET 50")
def k3(t: Tables):
    """The second page: the one after the last row of the first."""
    public = AP.redact_public(t.approvals, KEY)
    first = AP.page_approvals(public, limit=50)
    last = first.orderBy(*[F.desc(c) for c in AP.LISTING_ORDER]).first()
    return AP.page_approvals(public, after=last.asDict(), limit=50).select(
        "entry_id", micros("expires_at").alias("expires"), "complete"
    )


@query("a16_snapshot_digest")
def a16(t: Tables):
    rows = t.approvals.select("entry_id", "repo_id", "command_scope", micros("expires_at").alias("expires"))
    return AP.snapshot_digest(rows, KEY)


@query("a19_revoke_count", f"SELECT count(*) AS removed FROM approvals WHERE repo_id = 'repo-1' AND expires_at > TIMESTAMP '{NOW}'")
def a19(t: Tables):
    return AP.revoke_count(t.approvals, "repo-1", now())


# ---- stored results -------------------------------------------------------------------------

_KEYS = ", ".join(schemas.RESULT_KEY)
define("newest", f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY created_at DESC) AS rn FROM results WHERE decision IN ('ALLOW', 'WARN')) WHERE rn = 1""")


def _stored(t: Tables):
    path = scratch_path(t.spark, "results")
    early = F.col("created_at") < now()
    RE.write_scan_results(t.results.where(early), path)
    RE.write_scan_results(t.results.where(~early), path)
    return t.spark.read.parquet(path)


@query("s8_write_scan_results", "SELECT event_id, repo_id, head_commit, command_scope, decision FROM newest")
def s8(t: Tables):
    return _stored(t).select("event_id", "repo_id", "head_commit", "command_scope", "decision")


@query("j4_lookup_scan_result", f"""
  SELECT k.event_id, n.event_id AS hit FROM results k LEFT JOIN newest n ON n.repo_id = k.repo_id AND n.head_commit IS NOT DISTINCT FROM k.head_commit
   AND n.critical_fingerprint = k.critical_fingerprint AND n.command_scope = k.command_scope""")
def j4(t: Tables):
    keys = t.results.select(F.col("event_id").alias("asked"), *schemas.RESULT_KEY)
    hits, misses = RE.lookup_scan_result(keys, t.results)
    return hits.select(F.col("asked").alias("event_id"), F.col("event_id").alias("hit")).unionByName(
        misses.select(F.col("asked").alias("event_id"), F.lit(None).cast("bigint").alias("hit"))
    )


@query("w4_latest_result", f"""
  SELECT event_id, repo_id FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY created_at DESC) AS rn FROM results
   WHERE created_at + INTERVAL 10 DAY > TIMESTAMP '2024-01-30 00:00:00') WHERE rn = 1""")
def w4(t: Tables):
    at = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return RE.latest_result(t.results, at, ttl_seconds=10 * 86400).select("event_id", "repo_id")


@query("w5_retain_results", """
  SELECT command_scope, event_id, CAST(running AS BIGINT) AS running_bytes FROM (
    SELECT *, sum(size_bytes) OVER (PARTITION BY command_scope ORDER BY created_at DESC ROWS UNBOUNDED PRECEDING) AS running FROM (
      SELECT *, row_number() OVER (PARTITION BY command_scope ORDER BY created_at DESC) AS rn FROM results) WHERE rn <= 64) WHERE running <= 1000000""")
def w5(t: Tables):
    return RE.retain_results(t.results, max_bytes=1_000_000, by=["command_scope"]).select(
        "command_scope", "event_id", "running_bytes"
    )


# ---- audit ----------------------------------------------------------------------------------


def _prepared(t: Tables):
    """Audit rows in event form; a completion names the prepare seven events wide that it closes."""
    return t.audit.withColumn("event_id", F.col("prepared_id"))


@query("j13_unmatched_prepares", """
  SELECT event_id FROM audit WHERE event = 'mutation_prepared' AND prepared_id NOT IN (SELECT prepared_event_id FROM audit WHERE event = 'mutation_committed')""")
def j13(t: Tables):
    return AU.unmatched_prepares(_prepared(t)).select(F.regexp_extract("event_id", r"(\d+)$", 1).cast("bigint").alias("event_id"))


_DIGESTS = """SELECT o_orderkey, concat('e', CAST(o_custkey AS STRING)) AS entry_id, md5(o_orderstatus) AS before_digest, md5(CASE WHEN o_orderkey < 100 THEN o_orderstatus ELSE o_orderpriority END) AS after_digest FROM orders"""
_STATE = """SELECT concat('e', CAST(c_custkey AS STRING)) AS entry_id, md5(CASE WHEN c_acctbal > 5000 THEN '5-LOW' ELSE 'F' END) AS digest FROM customer"""


@query("j16_recovery_status", f"""
  SELECT o_orderkey, CASE WHEN before_digest = after_digest OR digest IS NULL THEN 'needs_review' WHEN digest = after_digest THEN 'recovery_committed'
         WHEN digest = before_digest THEN 'recovery_aborted' ELSE 'needs_review' END AS status FROM ({_DIGESTS}) LEFT JOIN ({_STATE}) USING (entry_id)""")
def j16(t: Tables):
    return AU.recovery_status(t.sql(_DIGESTS), t.sql(_STATE)).select("o_orderkey", "status")


def _segments(t: Tables):
    """Audit logs as JSON-lines segments: one log per 50 users, one segment per day."""
    rows = t.audit.select(
        F.concat(F.lit("log-"), F.floor(F.col("user_id") / 50).cast("string")).alias("log"),
        F.date_format("ts", "yyyyMMdd").alias("segment"), F.col("event_id"), "ts", "event", "outcome", "error_code",
        "operation_id", "challenge_id",
    )
    return rows.withColumn("line", F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), "ts", "event", "outcome", "error_code", "operation_id", "challenge_id",
    )))


def write_segments(t: Tables, path: str) -> None:
    ordered = _segments(t).groupBy("log", "segment").agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x.getField("line")), "\n")
    ordered.select(text.alias("value"), "log", "segment").write.partitionBy("log", "segment").text(path)


@query("s7_read_audit", "SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) // 1000 AS millis, event, outcome, error_code, false AS malformed FROM audit")
def s7(t: Tables):
    path = scratch_path(t.spark, "audit")
    write_segments(t, path)
    return SAU.read_audit(t.spark, path).select(
        "event_id", F.unix_millis("ts").alias("millis"), "event", "outcome", "error_code", "malformed"
    )


@query("w6_verify_chain", """
  SELECT log, event_id, place = 1 OR mod(event_id, 50) <> 13 AS link_ok, mod(event_id, 77) <> 5 AS mac_ok
  FROM (SELECT 'log-' || user_id AS log, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM audit)""")
def w6(t: Tables):
    """One log per user and one segment per day, with some links and some MACs broken."""
    return AU.verify_chain(t.stored("chain", lambda: _chain(t)), KEY).select(
        "log", F.col("event_id").cast("bigint").alias("event_id"), "link_ok", "mac_ok"
    )


def _chain(t: Tables):
    """Sample logs with real MACs. A chain can only be built in order, so each small log is one group."""
    rows = t.audit.select(
        F.concat(F.lit("log-"), F.col("user_id").cast("string")).alias("log"), F.date_format("ts", "yyyyMMdd").alias("segment"),
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("event_id"), "ts", "event", "outcome", "error_code",
        "operation_id", "challenge_id", "entry_id", F.lit(None).cast("string").alias("operation"), "prepared_event_id",
        F.lit(None).cast("string").alias("before_digest"), F.lit(None).cast("string").alias("after_digest"),
    )
    fields = {name: F.col(name) if name != "previous_mac" else F.lit("@") for name in AU.SIGNED_FIELDS}
    signed = rows.withColumn("payload", canonical_json(fields))

    def sign(group):
        group = group.sort_values("seq")
        previous, out = "0" * 64, []
        for record in group.itertuples(index=False):
            link = "f" * 64 if record.seq % 50 == 13 else previous
            message = AU.MAC_DOMAIN + record.payload.replace('"@"', f'"{link}"').encode()
            mac = hmac.new(KEY, message, hashlib.sha256).hexdigest()
            previous = mac[::-1] if record.seq % 77 == 5 else mac
            out.append((record.seq, link, previous))
        return pd.DataFrame(out, columns=["seq", "previous_mac", "record_mac"])

    macs = signed.select("log", "seq", "payload").groupBy("log").applyInPandas(
        sign, "seq bigint, previous_mac string, record_mac string"
    )
    place = Window.partitionBy("log", "segment").orderBy("seq")
    return rows.withColumn("line_no", F.row_number().over(place)).join(macs, "seq")
