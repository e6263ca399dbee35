"""Policy: findings to verdicts and their explanation.

A command is judged on a profile of (rule, count, score) rows, not on its findings. Repository
findings are profiled once per snapshot, so a command joins at most one row per rule however many
files or findings its repository has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.catalogue import policy as P

ORDER = ["phase", "order_path", "ord", "rule_ord", "match_ord"]


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])


def decision_rank(decision: Column) -> Column:
    return F.element_at(_map((d, rank) for d, rank, _code, _text in P.DECISIONS), decision)


def decision_of(rank: Column) -> Column:
    return F.element_at(_map((rank_, d) for d, rank_, _code, _text in P.DECISIONS), rank)


def instruction_of(rank: Column) -> Column:
    return F.element_at(_map((rank_, text) for _d, rank_, _code, text in P.DECISIONS), rank)


def severity_score(severity: Column) -> Column:
    return F.element_at(_map((s, score) for s, score, _rank in P.SEVERITIES), severity)


def severity_rank(severity: Column) -> Column:
    return F.element_at(_map((s, rank) for s, _score, rank in P.SEVERITIES), severity)


def max_decision(*decisions: Column) -> Column:
    """F16. ``ALLOW`` when nothing is given."""
    if not decisions:
        return F.lit("ALLOW")
    ranks = [F.coalesce(decision_rank(d), F.lit(0)) for d in decisions]
    return decision_of(ranks[0] if len(ranks) == 1 else F.greatest(*ranks))


def threshold_rank(score: Column) -> Column:
    allow, warn, ask = P.SCORE_LIMITS
    return F.when(score <= allow, 0).when(score <= warn, 1).when(score <= ask, 2).otherwise(3)


# ---- findings -------------------------------------------------------------------------------


def union_findings(*frames: DataFrame) -> DataFrame:
    """U1. Frames in phase order; missing order columns become their first value."""
    filled = []
    for phase, frame in enumerate(frames):
        for name, value in (
            ("phase", F.lit(phase)), ("order_path", F.col("file")), ("ord", F.array().cast("array<int>")),
            ("rule_ord", F.lit(0)), ("match_ord", F.lit(0)),
        ):
            if name not in frame.columns:
                frame = frame.withColumn(name, value)
        filled.append(frame)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), filled)


def drop_subsumed(findings: DataFrame, keys: list[str], direct: DataFrame | None = None) -> DataFrame:
    """J12. A download capability says nothing new where the file pipes a download to a shell.

    ``direct`` may hold such findings from elsewhere (the repository scan); by default they are
    taken from ``findings`` itself.
    """
    source = (findings if direct is None else direct).where(
        F.col("rule_id").isin("SHELL_CURL_PIPE_BASH", "SHELL_WGET_PIPE_SH")
    )
    files = source.select(*keys, "file").distinct().withColumn("rule_id", F.lit("SHELL_DOWNLOAD_CAPABILITY"))
    return findings.join(files, [*keys, "file", "rule_id"], "left_anti").select(*findings.columns)


def dedupe_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """W1. First finding per rule and file. A partial aggregate: no group is gathered."""
    order = [c for c in ORDER if c in findings.columns]
    rest = [c for c in findings.columns if c not in (*keys, "rule_id", "file")]
    first = findings.groupBy(*keys, "rule_id", "file").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("f")
    )
    return first.select(*keys, "rule_id", "file", *[F.col(f"f.{c}").alias(c) for c in rest]).select(*findings.columns)


def severity_summary(findings: DataFrame, keys: list[str], everyone: DataFrame | None = None) -> DataFrame:
    """A1. Counts of all five severities; ``everyone`` adds keys without findings."""
    counts = findings.groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s, _score, _rank in P.SEVERITIES]
    )
    if everyone is None:
        return counts
    return everyone.select(*keys).distinct().join(counts, keys, "left").na.fill(0)


def risk_score(severity: Column | None = None) -> Column:
    """A2. Aggregate: sum of severity scores."""
    return F.coalesce(F.sum(severity_score(F.col("severity") if severity is None else severity)), F.lit(0))


def has_hard_block() -> Column:
    """A3. Aggregate over rows joined to the policy."""
    return F.coalesce(F.bool_or(F.col("hard_block")), F.lit(False))


def matrix_minimum() -> Column:
    """A4. Aggregate: highest minimum decision."""
    return decision_of(F.coalesce(F.max(decision_rank(F.col("minimum"))), F.lit(0)))


def join_policy(findings: DataFrame, matrix: DataFrame, scope: Column) -> DataFrame:
    """J1. Minimum decision for the scope, hard block and rationale; unmatched stay null.

    The matrix has a row per rule, and users add rows; Spark measures it and picks the join.
    """
    joined = findings.join(matrix, "rule_id", "left")
    minimum = F.coalesce(F.element_at("scope_minimums", scope), F.col("default_minimum"))
    return joined.withColumn("minimum", minimum).drop("scope_minimums", "default_minimum")


def join_severity(findings: DataFrame, dim: DataFrame) -> DataFrame:
    """J2. Score and rank of each severity."""
    return findings.join(F.broadcast(dim), "severity")


# ---- verdicts -------------------------------------------------------------------------------


def profile(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings as one row per rule: count and score."""
    return findings.groupBy(*keys, "rule_id").agg(
        F.count("*").alias("finding_count"), F.sum(severity_score(F.col("severity"))).cast("bigint").alias("score")
    )


def contributions(profiles: DataFrame, scopes: DataFrame, matrix: DataFrame, key: str) -> DataFrame:
    """Profile rows with what the policy says about each rule in the scope of its command."""
    scoped = profiles.join(scopes.select(key, "scope"), key)
    return join_policy(scoped, matrix, F.col("scope"))


def evaluate_profile(commands: DataFrame, contributed: DataFrame, key: str) -> DataFrame:
    """A5 with the inputs of A6-A8. Starts from commands, so one without findings has a verdict."""
    rank = decision_rank(F.col("minimum"))
    totals = contributed.groupBy(key).agg(
        F.sum("score").alias("score"),
        F.sum("finding_count").alias("findings"),
        F.max(rank).alias("matrix_rank"),
        F.min(F.when(F.col("hard_block"), F.col("rule_id"))).alias("hard_rule"),
        F.min(F.when(rank.isNotNull(), F.struct((-rank).alias("r"), F.col("rule_id").alias("rule")))).alias("top"),
    )
    base = commands.select(key, "scope").join(totals, key, "left").select(
        key,
        "scope",
        F.coalesce("score", F.lit(0)).cast("bigint").alias("score"),
        F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"),
        F.coalesce("matrix_rank", F.lit(0)).alias("matrix_rank"),
        "hard_rule",
        F.col("top.rule").alias("matrix_rule"),
    )
    threshold = threshold_rank(F.col("score"))
    hard = F.col("hard_rule").isNotNull()
    unknown = (F.col("findings") == 0) & (F.col("scope") == "unknown_shell")
    preliminary = F.greatest(threshold, F.col("matrix_rank"))
    downgraded = (F.col("scope") == "safe_readonly") & (preliminary == 2)
    decided = base.withColumns(
        {
            "downgraded": ~hard & ~unknown & downgraded,
            "unknown": ~hard & unknown,
            "rank": F.when(hard, 3).when(unknown, 1).when(downgraded, 1).otherwise(preliminary),
            "risk_score": F.when(~hard & unknown, F.greatest(F.col("score"), F.lit(P.UNKNOWN_COMMAND_SCORE))).otherwise(
                F.col("score")
            ).cast("bigint"),
            "threshold": threshold,
        }
    )
    by_matrix = (F.col("rank") == F.col("matrix_rank")) & (F.col("matrix_rank") > 0)
    by_score = (F.col("rank") == F.col("threshold")) & (F.col("threshold") > 0)
    reason = (
        F.when(F.col("hard_rule").isNotNull(), P.REASON_HARD_BLOCK)
        .when(F.col("unknown"), P.REASON_UNKNOWN_COMMAND)
        .when(F.col("downgraded"), P.REASON_DOWNGRADED)
        .when(by_matrix, P.REASON_MATRIX)
        .when(by_score, P.REASON_THRESHOLD)
        .otherwise(F.element_at(_map(enumerate(P.REASON_DEFAULT)), F.col("rank")))
    )
    selector = (
        F.when(F.col("hard_rule").isNotNull(), "hard_block_rule")
        .when(F.col("unknown"), "command_scope")
        .when(F.col("downgraded"), "scope_adjustment")
        .when(by_matrix, "policy_matrix")
        .when(by_score, "risk_score")
        .otherwise("no_gate")
    )
    return decided.withColumn("selector", selector).select(
        key,
        "scope",
        decision_of(F.col("rank")).alias("decision"),
        "risk_score",
        reason.alias("reason"),
        instruction_of(F.col("rank")).alias("agent_instruction"),
        "selector",
        F.when(F.col("selector") == "hard_block_rule", F.col("hard_rule"))
        .when(F.col("selector") == "policy_matrix", F.col("matrix_rule"))
        .alias("selected_rule"),
        decision_of(threshold_rank(F.col("risk_score"))).alias("threshold_decision"),
    )


def evaluate_policy(commands: DataFrame, findings: DataFrame, matrix: DataFrame, key: str = "command_id") -> DataFrame:
    """A5 from plain findings keyed like ``commands``, which carry their scope."""
    return evaluate_profile(commands, contributions(profile(findings, [key]), commands, matrix, key), key)


def explain_selection(verdicts: DataFrame, key: str = "command_id") -> DataFrame:
    """A7. Which of the selectors decided, and by which rule."""
    return verdicts.select(key, F.col("selector").alias("type"), "decision", F.col("selected_rule").alias("rule_id"))


def command_contribution(verdicts: DataFrame, key: str = "command_id") -> DataFrame:
    """A8. What the command's score alone amounts to."""
    return verdicts.select(
        key,
        "risk_score",
        F.col("threshold_decision").alias("minimum_decision"),
        F.col("selector").isin("command_scope", "risk_score", "scope_adjustment").alias("affected_final_gate"),
    )


def explain_rules(verdicts: DataFrame, contributed: DataFrame, key: str = "command_id") -> DataFrame:
    """A6. Per command and rule: what it contributed and whether that moved the gate."""
    joined = contributed.drop("scope").join(verdicts.select(key, "decision", "selector"), key)
    matched = F.col("rationale").isNotNull()
    hard = F.coalesce("hard_block", F.lit(False))
    rank = decision_rank(F.col("minimum"))
    affected = F.coalesce(
        F.when(F.col("selector") == "hard_block_rule", hard)
        .when(F.col("selector") == "policy_matrix", F.col("minimum") == F.col("decision"))
        .when(F.col("selector") == "risk_score", F.col("score") > 0)
        .when(F.col("selector") == "scope_adjustment", (F.col("score") > 0) | F.coalesce(rank >= 1, F.lit(False)))
        .otherwise(F.lit(False)),
        F.lit(False),
    )
    return joined.select(
        key,
        "rule_id",
        "finding_count",
        F.col("score").alias("risk_score"),
        matched.alias("matrix_matched"),
        F.col("minimum").alias("minimum_decision"),
        hard.alias("hard_block"),
        "rationale",
        affected.alias("affected_final_gate"),
        (~affected).alias("report_only"),
    )


# ---- approvals ------------------------------------------------------------------------------

APPROVAL_KEYS = (
    "repo_id", "head_commit", "critical_fingerprint", "command_scope", "policy_version", "ruleset_version",
)


def match_approval(commands: DataFrame, approvals: DataFrame, now: Column) -> DataFrame:
    """J3. First stored live approval with the same six keys; ``now`` is a constant parameter.

    Approvals are reduced to one per key before the join, so a key with many approvals neither
    multiplies commands nor gathers in one task. ``store_ord`` is the order of the store.
    """
    live = (
        approvals.where(F.col("expires_at") > now)
        .groupBy(*APPROVAL_KEYS)
        .agg(F.min_by("entry_id", "store_ord").alias("entry_id"))
    )
    renamed = live.select(*[F.col(k).alias(f"_{k}") for k in APPROVAL_KEYS], "entry_id")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in APPROVAL_KEYS])
    return commands.join(renamed, same, "left").drop(*[f"_{k}" for k in APPROVAL_KEYS])


def trust_override(verdicts: DataFrame, matches: DataFrame, key: str = "command_id") -> DataFrame:
    """A9. A matching approval allows the command; its score stays."""
    approved = matches.select(key, "entry_id")
    trusted = F.col("entry_id").isNotNull()
    joined = verdicts.join(approved, key, "left")
    return joined.withColumns(
        {
            "decision": F.when(trusted, F.lit("ALLOW")).otherwise(F.col("decision")),
            "reason": F.when(trusted, F.lit(P.REASON_TRUSTED)).otherwise(F.col("reason")),
            "agent_instruction": F.when(trusted, F.lit(P.INSTRUCTION_TRUSTED)).otherwise(F.col("agent_instruction")),
            "selector": F.when(trusted, F.lit("trust_approval")).otherwise(F.col("selector")),
            "selected_rule": F.when(~trusted, F.col("selected_rule")),
        }
    )


def uncovered_rules(catalogue: DataFrame, matrix: DataFrame) -> DataFrame:
    """U5. Catalogue rules without a policy row; must be empty."""
    return catalogue.select("rule_id").subtract(matrix.select("rule_id"))


def default_matrix(spark: SparkSession) -> DataFrame:
    return P.policy_matrix(spark)
