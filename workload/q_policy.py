"""Policy: J1-J3, J12, A1-A9, W1, U1, F16, X4."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.catalogue import policy as P
from riskspark.operators import commands as C
from riskspark.operators import policy as PO
from riskspark.operators import reach as X
from riskspark.operators import scan as S
from workload.registry import Tables, define, query

FAMILIES = ("agent", "docker", "workflows", "mcp", "shell", "python_setup")
SNAP = ["repo_id", "snapshot_id"]
NOW = "2024-01-20 00:00:00"


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


define("policy", "SELECT * FROM (VALUES " + ", ".join(
    f"({_text(rule)}, {_text(minimum)}, {str(hard).lower()}, {_text(why)}, {_text(scopes.get('safe_readonly'))})"
    for rule, minimum, hard, why, scopes in P.POLICY_ROWS
) + ") v(rule_id, default_minimum, hard_block, rationale, readonly_minimum)")
define("severities", "SELECT * FROM (VALUES " + ", ".join(f"({_text(s)}, {score}, {rank})" for s, score, rank in P.SEVERITIES) + ") v(severity, score, rank)")
define("decisions", "SELECT * FROM (VALUES " + ", ".join(f"({_text(d)}, {rank}, {_text(i)})" for d, rank, _c, i in P.DECISIONS) + ") v(decision, rank, instruction)")

define("repo_rows", "SELECT DISTINCT repo_id, rule_id, file, severity FROM scan_rows")
define("profile", """
  SELECT repo_id, rule_id, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM repo_rows JOIN severities USING (severity) GROUP BY repo_id, rule_id""")
define("contributed", """
  SELECT x.command_id, s.scope, x.rule_id, x.n, x.score, p.hard_block, p.rationale,
         CASE WHEN s.scope = 'safe_readonly' THEN coalesce(p.readonly_minimum, p.default_minimum) ELSE p.default_minimum END AS minimum
  FROM (SELECT c.command_id, p.rule_id, p.n, p.score FROM commands c JOIN profile p ON p.repo_id = c.repo_id
        UNION ALL SELECT command_id, rule_id, 1, score FROM command_rows JOIN severities USING (severity)) x
  JOIN scoped s USING (command_id) LEFT JOIN policy p USING (rule_id)""")
define("totals", """
  SELECT s.command_id, s.scope, CAST(coalesce(sum(c.score), 0) AS BIGINT) AS score, count(c.rule_id) AS rules,
         coalesce(max(d.rank), 0) AS matrix_rank, min(CASE WHEN c.hard_block THEN c.rule_id END) AS hard_rule
  FROM scoped s LEFT JOIN contributed c USING (command_id) LEFT JOIN decisions d ON d.decision = c.minimum GROUP BY s.command_id, s.scope""")
define("ranked", """
  SELECT *, CASE WHEN score <= 9 THEN 0 WHEN score <= 24 THEN 1 WHEN score <= 74 THEN 2 ELSE 3 END AS threshold,
         CASE WHEN hard_rule IS NOT NULL THEN 'hard' WHEN rules = 0 AND scope = 'unknown_shell' THEN 'unknown'
              WHEN scope = 'safe_readonly' AND greatest(matrix_rank, CASE WHEN score <= 9 THEN 0 WHEN score <= 24 THEN 1 WHEN score <= 74 THEN 2 ELSE 3 END) = 2 THEN 'readonly'
              ELSE 'plain' END AS branch FROM totals""")
define("verdicts", f"""
  SELECT r.command_id, r.scope, d.decision, CASE WHEN branch = 'unknown' THEN greatest(r.score, 10) ELSE r.score END AS risk_score,
         CASE branch WHEN 'hard' THEN {_text(P.REASON_HARD_BLOCK)} WHEN 'unknown' THEN {_text(P.REASON_UNKNOWN_COMMAND)} WHEN 'readonly' THEN {_text(P.REASON_DOWNGRADED)}
           ELSE CASE WHEN r.matrix_rank > 0 AND r.matrix_rank >= threshold THEN {_text(P.REASON_MATRIX)}
                     WHEN threshold > 0 THEN {_text(P.REASON_THRESHOLD)} ELSE {_text(P.REASON_DEFAULT[0])} END END AS reason,
         d.instruction AS agent_instruction,
         CASE branch WHEN 'hard' THEN 'hard_block_rule' WHEN 'unknown' THEN 'command_scope' WHEN 'readonly' THEN 'scope_adjustment'
           ELSE CASE WHEN r.matrix_rank > 0 AND r.matrix_rank >= threshold THEN 'policy_matrix' WHEN threshold > 0 THEN 'risk_score' ELSE 'no_gate' END END AS selector,
         r.hard_rule, r.matrix_rank, threshold, branch
  FROM ranked r JOIN decisions d ON d.rank = CASE branch WHEN 'hard' THEN 3 WHEN 'unknown' THEN 1 WHEN 'readonly' THEN 1 ELSE greatest(r.matrix_rank, threshold) END""")


def repo_findings(t: Tables):
    rows = S.scan(t.files, FAMILIES).withColumn("order_path", F.col("file"))
    return t.stored("repo_findings", lambda: PO.dedupe_findings(rows, SNAP))


def plans(t: Tables):
    return t.stored("plans", lambda: C.distinct_plans(t.commands))


def contributed(t: Tables):
    """Rule profiles of plans: repository profiles joined once per snapshot, plus command rules."""

    def build():
        shared = plans(t).select("plan_id", *SNAP).join(PO.profile(repo_findings(t), SNAP), SNAP).drop(*SNAP)
        own = PO.profile(C.scan_commands(plans(t).select("plan_id", "command")), ["plan_id"])
        return PO.contributions(shared.unionByName(own), plans(t), PO.default_matrix(t.spark), "plan_id")

    return t.stored("contributed", build)


def verdicts(t: Tables):
    return PO.evaluate_profile(plans(t), contributed(t), "plan_id")


def per_command(t: Tables, frame):
    """Plan rows for every command that plans it."""
    keyed = t.commands.select("command_id", C.plan_id().alias("plan_id"))
    return keyed.join(frame, "plan_id").drop("plan_id")


@query("w1_dedupe_findings", """
  SELECT repo_id, rule_id, folder, severity, min(file) AS file, count(*) AS merged
  FROM (SELECT *, regexp_replace(file, '/?[^/]*$', '') AS folder FROM scan_rows) GROUP BY repo_id, rule_id, folder, severity""")
def w1(t: Tables):
    # Folders stand in for files so that there is something to merge.
    rows = S.scan(t.files, FAMILIES).withColumn("order_path", F.col("file")).withColumn("path", F.col("file"))
    rows = rows.withColumn("file", F.regexp_replace("file", "/?[^/]*$", ""))
    kept = PO.dedupe_findings(rows, ["repo_id", "severity"])
    merged = rows.groupBy("repo_id", "severity", "rule_id", "file").agg(F.count("*").alias("merged"))
    return kept.join(merged, ["repo_id", "severity", "rule_id", "file"]).select(
        "repo_id", "rule_id", F.col("file").alias("folder"), "severity", F.col("path").alias("file"), "merged"
    )


@query("u1_union_findings", """
  SELECT 0 AS phase, command_id AS owner, rule_id, file FROM command_rows
  UNION ALL SELECT 1, repo_id, rule_id, file FROM scan_rows""")
def u1(t: Tables):
    own = C.scan_commands(t.commands.select("command_id", "command")).withColumnRenamed("command_id", "owner")
    scanned = S.scan(t.files, FAMILIES).withColumnRenamed("repo_id", "owner")
    return PO.union_findings(own, scanned).select("phase", "owner", "rule_id", "file")


@query("j1_join_policy", "SELECT command_id, rule_id, scope, minimum, coalesce(hard_block, false) AS hard_block, rationale FROM contributed")
def j1(t: Tables):
    return per_command(t, contributed(t)).select(
        "command_id", "rule_id", "scope", "minimum", F.coalesce("hard_block", F.lit(False)).alias("hard_block"), "rationale"
    )


@query("j2_join_severity", "SELECT repo_id, file, rule_id, score, rank FROM scan_rows JOIN severities USING (severity)")
def j2(t: Tables):
    return PO.join_severity(S.scan(t.files, FAMILIES), P.severity_dim(t.spark)).select(
        "repo_id", "file", "rule_id", "score", "rank"
    )


@query("j12_drop_subsumed", r"""
  SELECT repo_id, path AS file FROM files f WHERE regexp_matches(text, '(?i)(^|[^\pL\pN_])(curl|wget)($|[^\pL\pN_])')
  AND NOT regexp_matches(path, '\.(js|mjs|cjs|ts|tsx|py)$|(^|/)(Dockerfile|docker-compose.yml)$')
  AND NOT EXISTS (SELECT 1 FROM scan_rows s WHERE s.repo_id = f.repo_id AND s.file = f.path AND s.rule_id IN ('SHELL_CURL_PIPE_BASH', 'SHELL_WGET_PIPE_SH'))""")
def j12(t: Tables):
    rows = X.scan_capabilities(t.files.select(*SNAP, "path", "text"), ("shell",))
    downloads = rows.where("rule_id = 'SHELL_DOWNLOAD_CAPABILITY'")
    return PO.drop_subsumed(downloads, SNAP, direct=repo_findings(t)).select("repo_id", "file")


@query("a1_severity_summary", """
  SELECT r.repo_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
         count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info
  FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN repo_rows f USING (repo_id) GROUP BY r.repo_id""")
def a1(t: Tables):
    return PO.severity_summary(repo_findings(t), ["repo_id"], everyone=t.files)


@query("a2_a3_a4_aggregates", """
  SELECT repo_id, CAST(sum(score) AS BIGINT) AS risk_score, bool_or(hard_block) AS hard_block, d.decision AS minimum FROM (
    SELECT repo_id, sum(score) AS score, bool_or(coalesce(hard_block, false)) AS hard_block, max(d.rank) AS top
    FROM repo_rows JOIN severities USING (severity) LEFT JOIN policy USING (rule_id) LEFT JOIN decisions d ON d.decision = default_minimum
    GROUP BY repo_id) JOIN decisions d ON d.rank = coalesce(top, 0) GROUP BY repo_id, d.decision""")
def a234(t: Tables):
    joined = PO.join_policy(repo_findings(t), PO.default_matrix(t.spark), F.lit("build"))
    return joined.groupBy("repo_id").agg(
        PO.risk_score().cast("bigint").alias("risk_score"), PO.has_hard_block().alias("hard_block"),
        PO.matrix_minimum().alias("minimum"),
    )


@query("a5_evaluate_policy", "SELECT command_id, scope, decision, risk_score, reason, agent_instruction FROM verdicts")
def a5(t: Tables):
    return per_command(t, verdicts(t)).select(
        "command_id", "scope", "decision", "risk_score", "reason", "agent_instruction"
    )


@query("a5_by_source", """
  SELECT d.source, v.decision, count(*) AS repos, CAST(sum(v.score) AS BIGINT) AS score FROM (
    SELECT repo_id, sum(score) AS score, CASE WHEN bool_or(coalesce(hard_block, false)) THEN 'BLOCK' WHEN sum(score) >= 75 THEN 'BLOCK'
           WHEN sum(score) >= 25 OR max(d.rank) = 2 THEN 'ASK_USER' WHEN sum(score) >= 10 OR max(d.rank) = 1 THEN 'WARN' ELSE 'ALLOW' END AS decision
    FROM repo_rows JOIN severities USING (severity) LEFT JOIN policy USING (rule_id) LEFT JOIN decisions d ON d.decision = default_minimum GROUP BY repo_id) v
  JOIN (SELECT DISTINCT source, concat('repo-', CAST(floor(doc_id / 40) AS BIGINT)) AS repo_id FROM documents) d USING (repo_id)
  GROUP BY d.source, v.decision""")
def a5_by_source(t: Tables):
    repos = repo_findings(t).select("repo_id").distinct().withColumn("scope", F.lit("build"))
    judged = PO.evaluate_policy(repos, repo_findings(t), PO.default_matrix(t.spark), "repo_id")
    sources = t.given("documents").select(
        "source", F.concat(F.lit("repo-"), F.floor(F.col("doc_id") / 40).cast("string")).alias("repo_id")
    ).distinct()
    return sources.join(judged, "repo_id").groupBy("source", "decision").agg(
        F.count("*").alias("repos"), F.sum("risk_score").alias("score")
    )


@query("a6_explain_rules", """
  SELECT c.command_id, c.rule_id, CAST(c.n AS BIGINT) AS finding_count, CAST(c.score AS BIGINT) AS risk_score, c.rationale IS NOT NULL AS matrix_matched,
         c.minimum AS minimum_decision, coalesce(c.hard_block, false) AS hard_block,
         CASE v.selector WHEN 'hard_block_rule' THEN coalesce(c.hard_block, false) WHEN 'policy_matrix' THEN coalesce(c.minimum = v.decision, false)
              WHEN 'risk_score' THEN c.score > 0 WHEN 'scope_adjustment' THEN c.score > 0 OR coalesce(c.minimum <> 'ALLOW', false) ELSE false END AS affected_final_gate
  FROM contributed c JOIN verdicts v USING (command_id)""")
def a6(t: Tables):
    return per_command(t, PO.explain_rules(verdicts(t), contributed(t), "plan_id")).select(
        "command_id", "rule_id", "finding_count", "risk_score", "matrix_matched", "minimum_decision", "hard_block", "affected_final_gate"
    )


@query("a7_explain_selection", """
  SELECT v.command_id, v.selector AS type, v.decision, CASE v.selector WHEN 'hard_block_rule' THEN v.hard_rule
         WHEN 'policy_matrix' THEN (SELECT min(c.rule_id) FROM contributed c WHERE c.command_id = v.command_id AND c.minimum = v.decision) END AS rule_id
  FROM verdicts v""")
def a7(t: Tables):
    return per_command(t, PO.explain_selection(verdicts(t), "plan_id"))


@query("a8_command_contribution", """
  SELECT v.command_id, v.risk_score, d.decision AS minimum_decision, v.selector IN ('command_scope', 'risk_score', 'scope_adjustment') AS affected_final_gate
  FROM verdicts v JOIN decisions d ON d.rank = CASE WHEN v.risk_score <= 9 THEN 0 WHEN v.risk_score <= 24 THEN 1 WHEN v.risk_score <= 74 THEN 2 ELSE 3 END""")
def a8(t: Tables):
    return per_command(t, PO.command_contribution(verdicts(t), "plan_id"))


# A command is approved for the identity its event names.
_SAME = "a.repo_id = w.repo_id AND a.head_commit IS NOT DISTINCT FROM w.head_commit AND a.critical_fingerprint = w.critical_fingerprint AND a.command_scope = w.command_scope AND a.ruleset_version = w.ruleset_version"
define("wanted", "SELECT event_id, concat('c', event_id) AS command_id, repo_id, head_commit, critical_fingerprint, command_scope, policy_version, '2026.07.13.2' AS ruleset_version FROM approvals")
define("matched", f"""
  SELECT w.command_id, a.entry_id FROM wanted w LEFT JOIN (
    SELECT repo_id, head_commit, critical_fingerprint, command_scope, ruleset_version, arg_min(entry_id, event_id) AS entry_id
    FROM approvals WHERE expires_at > TIMESTAMP '{NOW}' GROUP BY ALL) a ON {_SAME}""")


def wanted(t: Tables):
    return t.approvals.select(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("command_id"), "repo_id", "head_commit",
        "critical_fingerprint", "command_scope", "policy_version", F.lit(P.RULESET_VERSION).alias("ruleset_version"),
    )


@query("j3_match_approval", "SELECT command_id, entry_id FROM matched")
def j3(t: Tables):
    now = F.lit(NOW).cast("timestamp")
    return PO.match_approval(wanted(t), t.approvals, now).select("command_id", "entry_id")


@query("a9_trust_override", f"""
  SELECT v.command_id, CASE WHEN m.entry_id IS NULL THEN v.decision ELSE 'ALLOW' END AS decision, v.risk_score,
         CASE WHEN m.entry_id IS NULL THEN v.reason ELSE {_text(P.REASON_TRUSTED)} END AS reason,
         CASE WHEN m.entry_id IS NULL THEN v.selector ELSE 'trust_approval' END AS selector
  FROM verdicts v JOIN matched m USING (command_id)""")
def a9(t: Tables):
    now = F.lit(NOW).cast("timestamp")
    matches = PO.match_approval(wanted(t), t.approvals, now)
    return PO.trust_override(per_command(t, verdicts(t)), matches).select(
        "command_id", "decision", "risk_score", "reason", "selector"
    )


@query("f16_max_decision", """
  SELECT command_id, CASE greatest(CASE WHEN branch = 'hard' THEN 3 ELSE matrix_rank END, threshold) WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'WARN' WHEN 2 THEN 'ASK_USER' ELSE 'BLOCK' END AS decision
  FROM verdicts""")
def f16(t: Tables):
    worst = contributed(t).groupBy("plan_id").agg(PO.matrix_minimum().alias("minimum"), F.sum("score").alias("score"))
    rows = plans(t).select("plan_id").join(worst, "plan_id", "left")
    by_score = PO.decision_of(PO.threshold_rank(F.coalesce("score", F.lit(0))))
    return per_command(t, rows.select("plan_id", PO.max_decision(F.col("minimum"), by_score).alias("decision")))


@query("x4_user_policy", """
  SELECT r.rule_id, CASE WHEN r.rule_id = 'GHA_SELF_HOSTED_RUNNER' THEN 'BLOCK' WHEN r.rule_id = 'USER_RULE' THEN 'WARN' ELSE p.default_minimum END AS minimum, count(*) AS n
  FROM (SELECT rule_id FROM scan_rows UNION ALL SELECT 'USER_RULE' FROM events WHERE event_type = 'error') r LEFT JOIN policy p USING (rule_id) GROUP BY ALL""")
def x4(t: Tables):
    rows = t.spark.createDataFrame(
        [("GHA_SELF_HOSTED_RUNNER", "BLOCK", True, "ours", {}), ("USER_RULE", "WARN", False, "ours", {})], P.POLICY_SCHEMA
    )
    matrix = P.with_user_policy(PO.default_matrix(t.spark), rows)
    users = t.given("events").where("event_type = 'error'").select(F.lit("USER_RULE").alias("rule_id"))
    found = S.scan(t.files, FAMILIES).select("rule_id").unionByName(users)
    return PO.join_policy(found, matrix, F.lit("build")).groupBy("rule_id", "minimum").agg(F.count("*").alias("n"))
