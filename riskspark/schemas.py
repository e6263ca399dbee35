"""Schemas of stored tables and documents."""

CASES = (
    "id string, title string, category string, command string, expected_decision string, "
    "expected_rules array<string>, description string, safety_note string"
)
BATCH_ENTRY = "name string, url string, ref string, command string, expected string"
AUDIT_EVENT = (
    "event_id string, ts timestamp, event string, operation string, operation_id string, challenge_id string, "
    "entry_id string, outcome string, error_code string, prepared_event_id string, before_digest string, "
    "after_digest string, previous_mac string, record_mac string"
)
APPROVAL = (
    "entry_id string, entry_version int, repo_id string, path string, remote_url string, head_commit string, "
    "critical_fingerprint string, command_scope string, approved_command string, decision string, "
    "approved_at timestamp, expires_at timestamp, approved_by string, policy_version string, ruleset_version string, "
    "provenance struct<schema:string,source:string,migration_version:string,created_at:timestamp,"
    "migrated_at:timestamp,approval_reason:string,mutation_audit_event_id:string>"
)
RESULT_KEY = (
    "repo_id", "head_commit", "critical_fingerprint", "command_scope", "policy_version", "ruleset_version",
    "report_format_version",
)
