"""Stored approvals: reading, checking and migrating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.timefmt import parse_ts
from riskspark.functions.validate import bounded_field, is_commit, is_fingerprint, is_uuid4
from riskspark.session import cut

# Fixed values.
APPROVAL_FIELDS = (
    "repoId", "path", "remoteUrl", "headCommit", "criticalFingerprint", "commandScope", "approvedCommand",
    "decision", "approvedAt", "expiresAt", "approvedBy", "policyVersion", "rulesetVersion",
)
METADATA_FIELDS = ("entryId", "entryVersion", "provenance")
SCOPES = (
    "dependency_install", "script_execution", "build", "test", "docker", "network_shell", "mcp_server_start",
    "unknown_shell",
)
ENTRY_VERSION = 1
SCHEMA = "trust-cache-array-v2"
MIGRATION_VERSION = "v0.3.3-trust-read-foundation"
MUTATION_VERSION = "v0.3.4-trust-mutation"
PROVENANCE_FIELDS = {
    "legacy-migration": ("schema", "source", "migrationVersion", "migratedAt"),
    "cli-trust-approve": ("schema", "source", "migrationVersion", "createdAt"),
    "mcp-trust-approve": (
        "schema", "source", "migrationVersion", "createdAt", "approvalReason", "mutationAuditEventId",
    ),
}
BOUNDED = ("repoId", "path", "approvedCommand", "decision", "approvedBy", "policyVersion", "rulesetVersion")


def _same(keys: Column, expected) -> Column:
    wanted = F.array(*[F.lit(k) for k in sorted(expected)])
    return F.coalesce(F.array_sort(keys) == wanted, F.lit(False))


def _within(keys: Column, allowed) -> Column:
    return F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) == 0, F.lit(False))


def _text(value: Column, path: str) -> Column:
    node = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(value, path, "string"))


def _null_or(value: Column, path: str, ok: Column) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.coalesce(kind == "VOID", F.lit(False)) | ok


def _parsed(lines: DataFrame) -> DataFrame:
    """Parse each entry once; the checks read the parsed columns."""
    return lines.withColumns(
        {
            "_v": F.try_parse_json("value"),
            "_keys": F.json_object_keys("value"),
            "_provenance": F.json_object_keys(F.get_json_object("value", "$.provenance")),
        }
    )


def check_approval() -> Column:
    """Error code of one parsed entry: corrupt, unsupported-schema or null."""
    v, keys, provenance_keys = F.col("_v"), F.col("_keys"), F.col("_provenance")
    full = APPROVAL_FIELDS + METADATA_FIELDS
    legacy, migrated = _same(keys, APPROVAL_FIELDS), _same(keys, full)
    version = F.try_variant_get(v, "$.entryVersion", "variant")
    version_ok = F.coalesce(
        (F.schema_of_variant(version) == "BIGINT") & (F.try_variant_get(v, "$.entryVersion", "int") == ENTRY_VERSION),
        F.lit(False),
    )
    fields_ok = (
        F.lit(True)
        & _null_or(v, "$.remoteUrl", bounded_field(_text(v, "$.remoteUrl")))
        & F.coalesce(_text(v, "$.decision") == "USER_APPROVED", F.lit(False))
        & F.coalesce(_text(v, "$.approvedBy") == "local-user", F.lit(False))
        & _null_or(v, "$.headCommit", is_commit(_text(v, "$.headCommit")))
        & is_fingerprint(_text(v, "$.criticalFingerprint"))
        & F.coalesce(_text(v, "$.commandScope").isin(*SCOPES), F.lit(False))
        & parse_ts(_text(v, "$.approvedAt")).isNotNull()
        & parse_ts(_text(v, "$.expiresAt")).isNotNull()
    )
    for name in BOUNDED:
        fields_ok = fields_ok & bounded_field(_text(v, f"$.{name}"))
    source = _text(v, "$.provenance.source")
    shape_ok, stamp_ok = F.lit(False), F.lit(False)
    for name, wanted in PROVENANCE_FIELDS.items():
        stamp = "migratedAt" if name == "legacy-migration" else "createdAt"
        shape_ok = shape_ok | ((source == name) & _same(provenance_keys, wanted))
        stamp_ok = stamp_ok | ((source == name) & parse_ts(_text(v, f"$.provenance.{stamp}")).isNotNull())
    expected_version = F.when(source == "mcp-trust-approve", F.lit(MUTATION_VERSION)).otherwise(F.lit(MIGRATION_VERSION))
    schema_ok = F.coalesce(
        (_text(v, "$.provenance.schema") == SCHEMA) & (_text(v, "$.provenance.migrationVersion") == expected_version),
        F.lit(False),
    )
    zulu = F.lit(True)
    for name in ("approvedAt", "expiresAt", "provenance.createdAt"):
        zulu = zulu & F.coalesce(_text(v, f"$.{name}").endswith("Z"), F.lit(False))
    mutation_ok = (F.coalesce(source != "mcp-trust-approve", F.lit(True))) | (
        zulu
        & bounded_field(_text(v, "$.provenance.approvalReason"), 512)
        & is_uuid4(_text(v, "$.provenance.mutationAuditEventId"))
    )
    return (
        F.when(v.isNull() | keys.isNull(), F.lit("corrupt"))
        .when(legacy, F.when(~fields_ok, F.lit("corrupt")))
        .when(
            ~migrated,
            F.when(~_within(keys, full) | (F.array_contains(keys, "entryVersion") & ~version_ok), F.lit("unsupported-schema"))
            .otherwise(F.lit("corrupt")),
        )
        .when(~fields_ok, F.lit("corrupt"))
        .when(~version_ok, F.lit("unsupported-schema"))
        .when(~is_uuid4(_text(v, "$.entryId")) | ~F.coalesce(shape_ok, F.lit(False)), F.lit("corrupt"))
        .when(~schema_ok, F.lit("unsupported-schema"))
        .when(~F.coalesce(stamp_ok, F.lit(False)) | ~mutation_ok, F.lit("corrupt"))
    )


def parse_approvals(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split entries (column ``value``) into typed approvals and rejected ones.

    Identifiers must be unique: all entries that share one are rejected. Repeats are found by a
    partial count per identifier, not by gathering entries. ``store_ord`` is the order entries
    were approved in, which is the order an append-only store holds them.
    """
    v = F.col("_v")
    # Stored before any filter: a filter would repeat the whole check for every pushed condition.
    checked = cut(
        _parsed(lines).select(*lines.columns, check_approval().alias("error_code"), _text(v, "$.entryId").alias("entry_id"))
    )
    repeated = (
        checked.where("error_code IS NULL AND entry_id IS NOT NULL").groupBy("entry_id").agg(F.count("*").alias("n")).where("n > 1")
    )
    # Entries without an identifier repeat none; in the join they would all come to one task.
    named = checked.where("entry_id IS NOT NULL").join(repeated.select("entry_id", F.lit("corrupt").alias("repeat")), "entry_id", "left")
    named = named.withColumn("error_code", F.coalesce("error_code", "repeat")).drop("repeat")
    marked = named.unionByName(checked.where("entry_id IS NULL"))
    good = marked.where("error_code IS NULL").withColumn("_v", F.try_parse_json("value"))
    p = "$.provenance."
    typed = good.select(
        F.col("entry_id"),
        F.try_variant_get(v, "$.entryVersion", "int").alias("entry_version"),
        _text(v, "$.repoId").alias("repo_id"),
        _text(v, "$.path").alias("path"),
        _text(v, "$.remoteUrl").alias("remote_url"),
        _text(v, "$.headCommit").alias("head_commit"),
        _text(v, "$.criticalFingerprint").alias("critical_fingerprint"),
        _text(v, "$.commandScope").alias("command_scope"),
        _text(v, "$.approvedCommand").alias("approved_command"),
        _text(v, "$.decision").alias("decision"),
        parse_ts(_text(v, "$.approvedAt")).alias("approved_at"),
        parse_ts(_text(v, "$.expiresAt")).alias("expires_at"),
        _text(v, "$.approvedBy").alias("approved_by"),
        _text(v, "$.policyVersion").alias("policy_version"),
        _text(v, "$.rulesetVersion").alias("ruleset_version"),
        F.when(
            F.try_variant_get(v, "$.provenance", "variant").isNotNull(),
            F.struct(
                _text(v, p + "schema").alias("schema"),
                _text(v, p + "source").alias("source"),
                _text(v, p + "migrationVersion").alias("migration_version"),
                parse_ts(_text(v, p + "createdAt")).alias("created_at"),
                parse_ts(_text(v, p + "migratedAt")).alias("migrated_at"),
                _text(v, p + "approvalReason").alias("approval_reason"),
                _text(v, p + "mutationAuditEventId").alias("mutation_audit_event_id"),
            ),
        ).alias("provenance"),
    ).withColumn("store_ord", F.struct("approved_at", F.coalesce("entry_id", F.lit("")).alias("entry_id")))
    return typed, marked.where("error_code IS NOT NULL").select(F.col("value").alias("entry"), "error_code")


def read_approvals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S6. Approvals kept as JSON lines."""
    return parse_approvals(spark.read.text(path).where("trim(value) <> ''"))


def migrate_approvals(approvals: DataFrame, now: Column) -> DataFrame:
    """S10. Give legacy rows an identifier, version and provenance; a second run changes nothing.

    The identifier derives from the approval itself, so a re-run task or a second reader sees the
    same one. It is shaped as a version 4 UUID.
    """
    fields = [
        "repo_id", "path", "remote_url", "head_commit", "critical_fingerprint", "command_scope", "approved_command",
        "approved_at", "expires_at", "policy_version", "ruleset_version",
    ]
    digest = F.col("_digest")
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    made = F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
    legacy = F.col("entry_id").isNull()
    approvals = approvals.withColumn("_digest", F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))
    none = F.lit(None)
    provenance = F.struct(
        F.lit(SCHEMA).alias("schema"),
        F.lit("legacy-migration").alias("source"),
        F.lit(MIGRATION_VERSION).alias("migration_version"),
        none.cast("timestamp").alias("created_at"),
        now.cast("timestamp").alias("migrated_at"),
        none.cast("string").alias("approval_reason"),
        none.cast("string").alias("mutation_audit_event_id"),
    )
    return approvals.withColumns(
        {
            "entry_id": F.when(legacy, made).otherwise(F.col("entry_id")),
            "entry_version": F.when(legacy, F.lit(ENTRY_VERSION)).otherwise(F.col("entry_version")),
            "provenance": F.when(legacy, provenance).otherwise(F.col("provenance")),
        }
    ).drop("_digest")
