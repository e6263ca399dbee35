"""Every corpus case end to end: decision, ordered rules, scores, reports."""

import corpus_cases as K
import pytest
from pyspark.sql import functions as F

from riskspark.operators import corpus as CO
from riskspark.operators import policy as PO
from riskspark.plans.assess import approve, assess


@pytest.fixture(scope="module")
def result(spark):
    files = spark.createDataFrame(K.file_rows(), K.FILE_SCHEMA)
    commands = spark.createDataFrame(K.command_rows(), K.COMMAND_SCHEMA)
    return assess(files, commands), commands


def test_cases_match(spark, result):
    analysis, commands = result
    verdicts = {row.repo_id: row for row in analysis.per_command(commands).collect()}
    owner = {row.plan_id: row.repo_id for row in analysis.plans.collect()}
    rules = {}
    for row in analysis.capped_findings()[0].orderBy("plan_id", "position").collect():
        rules.setdefault(owner[row.plan_id], []).append(row.rule_id)
    for case, spec in K.CASES.items():
        assert verdicts[case].decision == spec["decision"], case
        assert rules.get(case, []) == spec["rules"], case
        assert spec.get("score", verdicts[case].risk_score) == verdicts[case].risk_score, case
        assert spec.get("scope", verdicts[case].scope) == verdicts[case].scope, case


def test_corpus_scoring(spark, result):
    analysis, commands = result
    cases = spark.createDataFrame(
        [(c, s["category"], s["decision"], s["rules"]) for c, s in K.CASES.items()],
        "id string, category string, expected_decision string, expected_rules array<string>",
    )
    found = analysis.capped_findings()[0].join(analysis.plans.select("plan_id", "repo_id"), "plan_id")
    ordered = found.groupBy("repo_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "rule_id"))), lambda x: x.getField("rule_id")).alias("r")
    )
    results = analysis.per_command(commands).join(ordered, "repo_id", "left").select(
        F.col("repo_id").alias("id"), F.col("decision").alias("actual_decision"),
        F.coalesce("r", F.array().cast("array<string>")).alias("actual_rules"),
    )
    scored = CO.score_cases(cases, results)
    assert CO.overall_passed(scored).first().passed
    negative = CO.category_summary(scored).where("category = 'go'").first()
    assert (negative.negative_controls, negative.case_count) == (3, 5)


def test_reports_are_complete(spark, result):
    analysis, _commands = result
    rows = {r.report.repo.path: r.report for r in analysis.reports().collect()}
    assert set(rows) == set(K.CASES)
    report = rows["wide-fanout"]
    assert report.schemaVersion == "1.0" and report.decision == "ASK_USER"
    assert len(report.executionGraph.nodes) == 100
    assert [u.ruleId for u in report.executionGraph.uncertainties] == ["SCRIPT_NODE_BUDGET_EXCEEDED"]
    secret = rows["leaked-secret"].findings[0]
    assert secret.evidenceSource == "redacted-secret" and "PRIVATE" not in secret.evidence
    assert rows["leaked-secret"].policyExplanation.selectedBy.type == "hard_block_rule"
    assert rows["golden-injection"].summary.high == 2 and rows["golden-injection"].summary.medium == 1


def test_approval_overrides_hard_block(spark, result):
    analysis, _commands = result
    plan = analysis.plans.where("repo_id = 'npm-remote'").first()
    identity = spark.createDataFrame([("npm-remote", "s1", None, "f")], "repo_id string, snapshot_id string, head_commit string, critical_fingerprint string")
    approvals = spark.createDataFrame(
        [("e1", "npm-remote", None, "f", plan.scope, "default-v1", "2026.07.13.2", "2030-01-01 00:00:00", 1)],
        "entry_id string, repo_id string, head_commit string, critical_fingerprint string, command_scope string, "
        "policy_version string, ruleset_version string, expires_at string, store_ord int",
    ).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    before = F.lit("2029-01-01 00:00:00").cast("timestamp")
    after = F.lit("2030-01-01 00:00:00").cast("timestamp")
    live = approve(analysis, identity, approvals, before).where(F.col("plan_id") == plan.plan_id).first()
    expired = approve(analysis, identity, approvals, after).where(F.col("plan_id") == plan.plan_id).first()
    assert (live.decision, live.selector, live.risk_score) == ("ALLOW", "trust_approval", 50)
    assert (expired.decision, expired.selector) == ("BLOCK", "hard_block_rule")


def test_summary_counts_equal_findings(spark, result):
    analysis, _commands = result
    names = ["critical", "high", "medium", "low", "info"]
    total = analysis.summary().select(sum(F.col(n) for n in names).alias("n")).agg(F.sum("n").alias("n")).first().n
    assert total == analysis.contributions.agg(F.sum("finding_count").alias("n")).first().n


def test_no_rule_is_uncovered(spark):
    from riskspark.catalogue.rules import rule_catalogue

    assert PO.uncovered_rules(rule_catalogue(spark), PO.default_matrix(spark)).count() == 0
